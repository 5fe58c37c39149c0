"""Vector bin packing of tokenised documents into training sequences.

Every example is a demand vector (tokens, segments, loss-bearing tokens) and every
sequence a bin with a limit in each dimension. An open bin takes, among the examples
that fit, the one whose demand has the largest dot product with the bin's residual
capacity, both scaled by the limits and weighted by the mean demand of the pool. When
nothing fits while tokens are still free, an example is cut to fill the rest, so that
only the last sequence of a task is padded.

Packing needs no shuffle: each task packs the documents of its own input split, pool
by pool, and hands an unfinished sequence on to its next pool. Memory is bounded by
the pool (``window`` examples) and the longest document.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from atrisk.llm.bpe import byte_letters
from atrisk.llm.common import small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class TextEncoder:
    """Ids of whole texts by a byte-level vocabulary in the tokenizers' JSON form.

    Ids follow merge order, so the vocabulary's ids serve as ranks for the faster of the
    installed libraries; the tests hold the result against the tokenizers library.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ordinary = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return array("I", self.ordinary(text)).tobytes()
        return b"".join(self.special.get(p) or array("I", self.ordinary(p)).tobytes() for p in self._special.split(text))


@functools.lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One per worker process, for all its tasks."""
    return TextEncoder(path)


class VectorPacker:
    """Packs a pool of examples into bins under several limits at once.

    An example is ``(tokens, loss)`` with a payload and counts as one segment; examples
    with the same demand are interchangeable, so the heuristic scores demand classes.
    ``cut(payload, at)`` splits an example's payload and returns both parts with their
    demands.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.cut = cut
        self.pool: dict[tuple[int, int], list] = defaultdict(list)
        self.size = 0

    def add(self, tokens: int, loss: int, payload) -> None:
        self.pool[tokens, loss].append(payload)
        self.size += 1

    def take(self, key: tuple[int, int]):
        payload = self.pool[key].pop()
        self.size -= 1
        if not self.pool[key]:
            del self.pool[key]
        return payload

    def bins(self) -> Iterator[list[tuple[int, int, object]]]:
        """Full bins, then at most one that is not full: lists of (tokens, loss, payload)."""
        while self.size:
            keys = sorted(self.pool)
            demand = np.array([(t, 1, x) for t, x in keys], float) / self.limits
            count = np.array([len(self.pool[k]) for k in keys], float)
            weight = (demand * count[:, None]).sum(0) / count.sum()
            # the classes stay as they are until a cut adds one
            while self.size:
                free, out, added = self.limits.copy(), [], False
                while free[0] >= 1 and free[1] >= 1 and self.size:
                    fits = (demand * self.limits <= free + 1e-9).all(1) & (count > 0)
                    if fits.any():
                        score = np.where(fits, demand @ (weight * free / self.limits), -1.0)
                        k = int(score.argmax())
                        (tokens, loss), payload = keys[k], self.take(keys[k])
                        count[k] -= 1
                        got = (tokens, loss, payload)
                    else:
                        k = int(np.where(count > 0, demand[:, 0], -1.0).argmax())
                        head, tail = self.cut(keys[k], self.pool[keys[k]][-1], int(min(free[0], free[2])))
                        if head is None or head[0] > free[0] or head[1] > free[2]:
                            break
                        self.take(keys[k])
                        count[k] -= 1
                        got = head
                        self.add(*tail)
                        at = (tail[0], tail[1])
                        if at in keys:
                            count[keys.index(at)] += 1
                        else:
                            added = True
                    out.append(got)
                    free -= np.array([got[0], 1, got[1]])
                yield out
                if added:
                    break


def _cut_piece(demand: tuple[int, int], payload: tuple, at: int):
    """A piece is (document, start, ids); its first id bears no loss at the document's start."""
    doc, start, ids = payload
    tokens = demand[0]
    if at < 1 or at >= tokens:
        return None, None
    head = (at, at - (start == 0), (doc, start, ids[: 4 * at]))
    tail = (tokens - at, tokens - at, (doc, start + at, ids[4 * at :]))
    return head, tail


def pack_documents(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = 1024, max_segments: int = 256, max_loss_tokens: int | None = None, window: int = 8192) -> DataFrame:
    """Packs every document (its ids, then id 0) into sequences; one row per piece.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null text is
    empty and gives the single id 0. A null doc_id is kept as null; repeated rows are
    separate documents. Every id lies in exactly one piece. ``loss_tokens`` counts the
    ids of a piece that something before them predicts: all but a document's first.
    """
    small_batches(docs.sparkSession)
    max_loss = max_tokens if max_loss_tokens is None else max_loss_tokens
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    full = min(max_tokens, max_loss)

    def run(batches):
        encoder = text_encoder(tokenizer_path)
        packer = VectorPacker(max_tokens, max_segments, max_loss, _cut_piece)
        first = TaskContext.get().partitionId() << 33
        sequence = 0
        rows: list[tuple] = []

        def place(pieces) -> None:
            nonlocal sequence
            offset = 0
            for tokens, loss, ((doc_id, total), start, ids) in pieces:
                rows.append((doc_id, start, tokens, zlib.crc32(ids), total, first + sequence, offset, loss))
                offset += tokens
            sequence += 1

        def flush(last: bool) -> None:
            held = None
            for pieces in packer.bins():
                if held:
                    place(held)
                held = pieces
            if held and (last or sum(p[0] for p in held) == max_tokens):
                place(held)
            elif held:
                for p in held:
                    packer.add(*p)

        def out():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + b"\0\0\0\0"
                total = len(ids) // 4
                doc = (doc_id, total)
                start = 0
                while total - start >= full and full == max_tokens:
                    place([(full, full - (start == 0), (doc, start, ids[4 * start : 4 * (start + full)]))])
                    start += full
                while total - start > full:
                    packer.add(full, full - (start == 0), (doc, start, ids[4 * start : 4 * (start + full)]))
                    start += full
                if start < total:
                    packer.add(total - start, total - start - (start == 0), (doc, start, ids[4 * start :]))
                if packer.size >= window:
                    flush(False)
            if rows:
                yield out()
        flush(True)
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
