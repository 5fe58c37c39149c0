"""Cross-tokenizer alignment by products of sparse incidence matrices.

Two tokenizers, A and B, cut the same bytes differently. Each gives a token-byte incidence
matrix in compressed sparse rows: row i has a one in each byte column that token i covers.
Gustavson's row products of A with the transpose of B give the overlap links and the bytes
that two tokens share. Where the last token that a token overlaps ends at its own end, both
tokenizers cut: there a group ends. The products of the token-group incidence matrices give
the links of tokens that share a group.

No token of either vocabulary reaches over a single blank, so texts are cut there and every
distinct unit is aligned once per worker while a bounded memo holds it; texts with white
space on both sides of a blank are one unit. Tasks gather their documents in blocks: a block
lists its distinct pairs of ids, documents refer to places in that list, and only the lists
are counted and joined over the corpus. A block is bounded by the length of its texts.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrisk.llm.common import small_batches, written
from atrisk.llm.packing import text_encoder

#: Characters of text in a block, and of the units aligned in one product.
BLOCK, CHUNK = 1 << 22, 1 << 18
#: Units that a worker remembers.
UNITS = 250_000
#: Non-zero products formed at once.
PRODUCTS = 1 << 21
#: A pair of ids is one number: so many bits for the id of A, then so many for that of B.
A_BITS, B_BITS = 20, 15
PAIR_BITS = A_BITS + B_BITS

BLOCKS = (
    "block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,n_overlaps:long,groups_sha256:string,entries:int>>, "
    "places binary, times binary, pairs array<struct<place:int,pair:long,docs:long>>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"


class Csr(NamedTuple):
    """A sparse matrix in compressed rows: row i has ``data[k]`` in column ``indices[k]`` for
    k from ``indptr[i]`` to ``indptr[i + 1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1


def incidence(ends: np.ndarray) -> Csr:
    """Of intervals that follow each other without a gap: interval by position."""
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(total), np.ones(total, np.int64), total)


def transposed(ends: np.ndarray) -> Csr:
    """The transpose of :func:`incidence`: position by interval, one in each row."""
    sizes = np.diff(ends, prepend=0)
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.arange(total + 1), np.repeat(np.arange(len(ends)), sizes), np.ones(total, np.int64), len(ends))


def gustavson(left: Csr, right: Csr, products: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product of two matrices by rows: row i of the result is the sum of the rows of
    ``right`` that row i of ``left`` names, each times the value there.

    Gives blocks of (row, column, value), by row and column. A block has whole rows; only a
    row of more than ``products`` products is larger.
    """
    taken = np.diff(right.indptr)[left.indices]
    before = np.concatenate([[0], np.cumsum(taken)])
    work = before[left.indptr]  # products before each row
    row = 0
    while row < left.rows:
        until = max(row + 1, int(np.searchsorted(work, work[row] + products, "right")) - 1)
        lo, hi = left.indptr[row], left.indptr[until]
        n = taken[lo:hi]
        at = np.arange(int(n.sum())) + np.repeat(right.indptr[left.indices[lo:hi]] - (before[lo:hi] - before[lo]), n)
        rows = np.repeat(np.repeat(np.arange(row, until), np.diff(left.indptr[row : until + 1])), n)
        key = rows * max(right.columns, 1) + right.indices[at]
        value = np.repeat(left.data[lo:hi], n) * right.data[at]
        if len(key):
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            yield key[first] // right.columns, key[first] % right.columns, np.add.reduceat(value, first)
        row = until


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray, overlaps) -> tuple[np.ndarray, int]:
    """For every token of A the last token of B that it overlaps, turned into whether both
    end together; and the number of overlap links."""
    last = np.zeros(len(a_ends), np.int64)
    links = 0
    for rows, columns, _ in overlaps:
        last[rows] = columns  # columns ascend within a row, so the last one stays
        links += len(rows)
    return b_ends[last] == a_ends, links


class Aligner:
    """Both tokenizers and what a worker remembers of the units it has aligned."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        coder = text_encoder(path_a)
        self.encode_a = coder.ordinary
        encoding = coder.ordinary.__self__
        self.bytes_a = [encoding.decode_single_token_bytes(i) for i in range(len(encoding._mergeable_ranks))]
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        piece, self.bytes_b = self.model.id_to_piece, []
        for i in range(self.model.get_piece_size()):
            self.bytes_b.append(bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode())
        if len(self.bytes_b) > 1 << B_BITS or len(self.bytes_a) > 1 << A_BITS:
            raise ValueError("the vocabularies are too large for this form of pairs")
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.shown = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.said: list[str] = []  # the groups of each unit
        self.sizes: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, n_overlaps, whole or not
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pairs a unit, pairs, times
        self.letters = 0

    @staticmethod
    def units(text: str) -> list[str]:
        """The text cut at single blanks, or whole where a blank doesn't separate."""
        if "  " in text or text[0] == " " or text[-1] == " " or (not text.isprintable() and re.search(r"\s \s", text)):
            return [text]
        return text.split(" ")

    def learn(self, units: list[str]) -> None:
        """Aligns units that are not known yet, so many at a time that the products are bounded."""
        start = size = 0
        for i, unit in enumerate(units):
            size += len(unit)
            if size >= CHUNK or i == len(units) - 1:
                self._learn(units[start : i + 1])
                start, size = i + 1, 0

    def _learn(self, units: list[str]) -> None:
        ids_a = [self.encode_a(" " + u) for u in units]
        ids_b = self.model.encode(units, num_threads=1)
        # a unit that either tokenizer changes has no tokens
        whole = np.zeros(len(units), bool)
        for i, u in enumerate(units):
            raw = b" " + u.encode()
            whole[i] = b"".join([self.bytes_b[x] for x in ids_b[i]]) == raw and b"".join([self.bytes_a[x] for x in ids_a[i]]) == raw
            if not whole[i]:
                ids_a[i] = ids_b[i] = []
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        a_ends, b_ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        closes = np.zeros(0, bool)
        overlaps = np.zeros(len(units), np.int64)
        unit_a = np.repeat(np.arange(len(units)), n_a)
        if len(a):
            blocks = []

            def counted():
                for rows, columns, shared in gustavson(incidence(a_ends), transposed(b_ends)):
                    blocks.append(np.bincount(unit_a[rows], minlength=len(units)))
                    yield rows, columns, shared

            closes, _ = group_ends(a_ends, b_ends, counted())
            overlaps = np.sum(blocks, axis=0)
        n_groups = np.bincount(unit_a[closes], minlength=len(units)) if len(a) else overlaps
        group_a = np.cumsum(closes) - closes
        edges = a_ends[closes] if len(a) else a_ends
        group_b = np.searchsorted(edges, b_ends, "left")
        groups = len(edges)
        size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        group_unit = unit_a[closes] if len(a) else unit_a
        n_links = np.zeros(len(units), np.int64)
        np.add.at(n_links, group_unit, size_a * size_b)
        by_token = Csr(np.arange(len(a) + 1), group_a, np.ones(len(a), np.int64), groups)
        of_group = Csr(np.concatenate([[0], np.cumsum(size_b)]).astype(np.int64), np.arange(len(b)), np.ones(len(b), np.int64), len(b))
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, columns, _ in gustavson(by_token, of_group):
            key, n = np.unique(unit_a[rows] << PAIR_BITS | a[rows] << B_BITS | b[columns], return_counts=True)
            keys.append(key)
            times.append(n)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(times), minlength=len(key)).astype(np.int64)
        self.found.append((np.bincount(key >> PAIR_BITS, minlength=len(units)), key & (1 << PAIR_BITS) - 1, n))
        self.sizes.append(np.stack([n_a, n_b, n_groups, n_links, overlaps, whole], 1))
        # the groups in decimal: a1,a2|b1;a3|b2,b3
        shown, at_a, at_b, a, b = self.shown, 0, 0, a.tolist(), b.tolist()
        said = []
        for x, y in zip(size_a.tolist(), size_b.tolist(), strict=True):
            if x == y == 1:
                said.append(f"{shown[a[at_a]]}|{shown[b[at_b]]}")
            else:
                said.append(",".join([shown[i] for i in a[at_a : at_a + x]]) + "|" + ",".join([shown[i] for i in b[at_b : at_b + y]]))
            at_a += x
            at_b += y
        at = 0
        for g in n_groups.tolist():
            self.said.append(";".join(said[at : at + g]))
            at += g
        for u in units:
            self.memo[u] = len(self.memo)
            self.letters += len(u)

    def block(self, number: int, docs: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
        """One block's row: its documents, the places of their pairs, and its distinct pairs."""
        if len(self.memo) > UNITS or self.letters > 16 * UNITS:
            self.forget()
        cut = [self.units(t) if t else [] for _, t in docs]
        every = list(chain.from_iterable(cut))
        new = set(every).difference(self.memo)
        if new:
            self.learn(list(new))
        unit = np.fromiter(map(self.memo.__getitem__, every), np.int64, len(every))
        ends = np.cumsum([len(c) for c in cut])
        starts = np.concatenate([[0], ends[:-1]])
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros((0, 6), np.int64)
        sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(sizes[unit], 0)])
        of_doc = sums[ends] - sums[starts]
        kept = (of_doc[:, 5] == ends - starts) & (ends > starts)
        of_doc[~kept] = 0
        per_unit, pairs, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*self.found, strict=True) if self.found else [[]] * 3))
        first = np.cumsum(per_unit) - per_unit
        doc = np.repeat(np.arange(len(docs)), ends - starts)
        live = kept[doc]
        unit, doc = unit[live], doc[live]
        n = per_unit[unit]
        at = np.arange(int(n.sum())) + np.repeat(first[unit] - (np.cumsum(n) - n), n)
        distinct, place = np.unique(pairs[at], return_inverse=True)
        key = np.repeat(doc, n) * max(len(distinct), 1) + place
        order = np.argsort(key, kind="stable")
        key, m = key[order], times[at][order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        m = np.add.reduceat(m, head) if len(head) else m
        doc, place = np.divmod(key[head], max(len(distinct), 1))
        entries = np.bincount(doc, minlength=len(docs))
        steps = np.diff(place, prepend=0)  # small within a document
        said = [hashlib.sha256(";".join([self.said[self.memo[u]] for u in c]).encode()).hexdigest() if k else "" for c, k in zip(cut, kept.tolist(), strict=True)]
        # columns of the documents and of the pairs, not rows as objects, which take far more memory
        columns = [pa.array([d for d, _ in docs], pa.int64()), *(pa.array(of_doc[:, i]) for i in range(5)), pa.array(said, pa.string()), pa.array(entries, pa.int32())]
        held = pa.StructArray.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "entries"])
        counted = pa.StructArray.from_arrays([pa.array(np.arange(len(distinct), dtype=np.int32)), pa.array(distinct), pa.array(np.bincount(place, minlength=len(distinct)))], names=["place", "pair", "docs"])
        blobs = (pa.array([pa.compress(x.astype(np.int32).tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (steps, m))
        lists = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (held, counted))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), next(lists), *blobs, next(lists)], names=["block", "docs", "places", "times", "pairs"])


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process, with what it remembers, for all its tasks."""
    return Aligner(path_a, path_b)


def _blocks(path_a: str, path_b: str):
    def run(batches):
        made = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((d, t))
                size += len(t or "") + 64
                if size >= BLOCK:
                    yield made.block(number, held)
                    number += 1
                    held, size = [], 0
        if held:
            yield made.block(number, held)

    return run


def _numbers(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)


def _scored(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block with their sums over the pairs' counts."""
    docs = pa.concat_arrays(blocks.column("docs").chunks).flatten()
    table = pa.Table.from_arrays(docs.flatten(), names=[f.name for f in docs.type])
    entries = table.column("entries").to_numpy()
    total = int(entries.sum())
    steps, times = (_numbers(blocks.column(c)[0].as_py(), total) for c in ("places", "times"))
    place = np.cumsum(steps.astype(np.int64))
    count, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    at = counts.column("place").to_numpy()
    count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    ends = np.cumsum(entries)

    def sums(x):
        c = np.concatenate([[0], np.cumsum(x)])
        return pa.array(c[ends] - c[ends - entries], pa.int64())

    table = table.append_column("n_best", sums(times * best[place])).append_column("count_sum", sums(times * count[place]))
    return table.select([c.split()[0] for c in RESULT.split(", ")])


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Aligns every text of ``doc_id, text`` as tokenized by A (a byte-level vocabulary in the
    tokenizers' JSON form) and B (a sentence-piece model), both over a blank and the text.

    Returns per row ``doc_id``, the numbers of tokens ``n_a``, ``n_b``, of groups and of links
    (token pairs that share a group) and ``n_overlaps`` (token pairs that share a byte);
    ``count_sum``: the sum over links of the number of documents that hold their pair of ids
    linked; ``n_best``: the links whose number is the highest of their A id; and the digest of
    the groups. A null or empty text, or one that a tokenizer changes, has zeros and an empty
    digest. A null doc_id stays null, repeated rows are counted as documents of their own,
    other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    blocks = written(docs.select("doc_id", "text").mapInArrow(_blocks(path_a, path_b), BLOCKS), "blocks")
    pairs = blocks.select("block", F.explode("pairs").alias("p")).select("block", "p.*")
    counts = written(pairs.groupBy("pair").agg(F.sum("docs").alias("count")), "pairs")
    # at most one row for each id of A's vocabulary
    best = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("count").alias("most"))
    scored = counts.join(F.broadcast(best), F.shiftright("pair", B_BITS) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    known = pairs.join(scored.hint("merge"), "pair").select(F.col("block").alias("of"), "place", "count", "best")
    return blocks.select("block", "docs", "places", "times").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_scored, RESULT)


def overlap_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The overlap links themselves: ``doc_id, a_at, b_at`` (places of the tokens in their
    sequences) and ``n_bytes`` they share; texts without tokens have none."""
    small_batches(docs.sparkSession)

    def run(batches):
        made = aligner(path_a, path_b)
        for batch in batches:
            for d, t in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = (np.array(x, np.int64) for x in (made.encode_a(" " + t), made.model.encode(t))) if t else (np.zeros(0, np.int64),) * 2
                raw = b" " + (t or "").encode()
                if not len(a) or b"".join(made.bytes_a[i] for i in a) != raw or b"".join(made.bytes_b[i] for i in b) != raw:
                    continue
                for rows, columns, shared in gustavson(incidence(np.cumsum(made.length_a[a])), transposed(np.cumsum(made.length_b[b]))):
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(rows), pa.int64()), pa.array(rows), pa.array(columns), pa.array(shared)], names=["doc_id", "a_at", "b_at", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a_at long, b_at long, n_bytes long")
