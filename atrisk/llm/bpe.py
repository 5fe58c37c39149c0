"""Exact BPE by backtracking over longest vocabulary matches.

An Aho-Corasick automaton over the vocabulary gives, for each position of a word, the
tokens that start there. The encoder takes the longest that is compatible with the
token before it and steps back where no token is. Two tokens are compatible when
merging their joint text gives just these two again; that is looked up in a table of
pairs, filled on demand by undoing the newest merge on either side of the boundary.
Positions that once led nowhere are never tried again, so the work is linear in the
word's length times the matches per position. Decoding is one gather from a byte blob
through an offset table.

Texts are cut at blanks and line feeds, over which no token reaches, and each distinct
chunk is encoded once per worker while a bounded cache holds it. There is no shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atrisk.llm.common import Remembered, small_batches

#: Chunks and words whose ids a worker remembers, and pairs in the compatibility table.
CACHE = 300_000
PAIRS = 1_000_000
END = "Ā"


def byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class WordBpe:
    """Encoder and decoder for a word-end BPE vocabulary in the tokenizers' JSON form."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        byte_of = {c: chr(b) for b, c in enumerate(byte_letters())}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = len(vocab) - len(merges)
        unit: dict[int, str] = {}
        for token, i in vocab.items():
            if i < self.base:
                unit[i] = byte_of[token] if len(token) == 1 else byte_of[token[0]] + END
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b, i = vocab[left], vocab[right], vocab[left + right]
            self.parts[i] = (a, b)
            self.pair[a, b] = i
            unit[i] = unit[a] + unit[b]
        self.automaton = ahocorasick.Automaton()
        for i, s in unit.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        id_of = {s: i for i, s in unit.items()}
        self.length = [len(unit[i]) for i in range(len(unit))]
        # the longest token that is a proper prefix, or -1
        self.shorter = [next((id_of[unit[i][:n]] for n in range(len(unit[i]) - 1, 0, -1) if unit[i][:n] in id_of), -1) for i in range(len(unit))]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: np.uint32(v).tobytes() for k, v in special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        self.ok = Remembered(lambda k: self._boundary_holds(k >> 20, k & 0xFFFFF), PAIRS)
        self.chunks = Remembered(self.chunk, CACHE)
        self.words = Remembered(lambda w: b"".join(map(self.packed.__getitem__, self.word(w.encode().decode("latin-1") + END))), CACHE)
        self.packed = [np.uint32(i).tobytes() for i in range(len(vocab))]
        shown = {i: t for t, i in (vocab | special).items()}
        assert suffix and len(shown) == max(shown) + 1
        pieces = [f"{shown[i]} ".encode() for i in range(len(shown))]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two tokens gives just these two again."""
        return self.ok[left << 20 | right]

    def _boundary_holds(self, left: int, right: int) -> bool:
        before = len(self.offsets)  # the pieces at the boundary live until this merge
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and joined < before:
                return False
            if left >= self.base and left > right:
                before, left = left, self.parts[left][1]
            elif right >= self.base:
                # of two equal merges the left one comes first
                before, right = right + 1, self.parts[right][0]
            else:
                return True

    def word(self, text: str) -> list[int]:
        """The ids of one pre-token given as one character per byte, END last."""
        n, length, shorter, ok = len(text), self.length, self.shorter, self.ok
        longest = [-1] * n
        for end, i in self.automaton.iter(text):
            longest[end + 1 - length[i]] = i  # of one start, longer matches end later
        dead = bytearray(n + 1)
        ids: list[int] = []
        pos, i = 0, longest[0]
        while True:
            if i < 0:  # no way on from here: the token before must be shorter
                dead[pos] = 1
                i = ids.pop()
                pos -= length[i]
                i = shorter[i]
                continue
            after = pos + length[i]
            if dead[after] or (ids and not ok[ids[-1] << 20 | i]):
                i = shorter[i]
                continue
            ids.append(i)
            if after == n:
                return ids
            pos, i = after, longest[after]

    def chunk(self, text: str) -> bytes:
        """The ids of any text, uncached: special strings, normal form, pre-tokens, words."""
        if text.isascii() and text.isalpha():
            return self.words[text.lower()]
        out = []
        for part in self._special.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                part = part.lower()
            else:  # letter by letter, without rules for a word's end
                part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
            out += map(self.words.__getitem__, [part] if part.isascii() and part.isalpha() else self._words.findall(part))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, ids: bytes, block: int = 1 << 20) -> bytes:
        """The UTF-8 text of encoded ids: token strings with a blank between them."""
        a = np.frombuffer(ids, "<u4")
        out = []
        for at in range(0, len(a), block):
            x = a[at : at + block]
            start, size = self.offsets[x], np.diff(self.offsets)[x]
            ends = np.cumsum(size)
            index = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            out.append(self.blob[index].tobytes())
        return b"".join(out)[:-1]


@functools.lru_cache(maxsize=2)
def coder(path: str) -> WordBpe:
    """One per worker process, with what it remembers, for all its tasks."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian 32-bit) and ``decoded`` (UTF-8) of every whole text.

    A null text is empty: no ids and an empty decoded text. A null doc_id stays null,
    repeated rows give repeated results, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_runner(tokenizer_path, False), "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """As :func:`encode_decode`, with counts and digests instead of the ids and texts."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_runner(tokenizer_path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _runner(path: str, digest: bool):
    def run(batches):
        bpe = coder(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            texts = [bpe.decode(x) for x in ids]
            doc_id = batch.column(0).cast(pa.int64())
            if digest:
                columns = [doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, texts))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns = [doc_id, pa.array(ids, pa.binary()), pa.array(texts, pa.binary())]
                names = ["doc_id", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
