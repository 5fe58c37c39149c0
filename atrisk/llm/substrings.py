"""Removal of long repeated substrings by suffix arrays.

A byte goes if a string of ``SIZE`` bytes that covers it also starts anywhere else. Each such
window chooses the smallest hash among the ``KEY``-byte strings inside it; equal windows choose
equal hashes, so they meet under one key. Successive windows with one choice form a run: its
key, its stretch of text, and a fingerprint of that. Keys that occur once are dropped without
moving any text. Runs with equal stretches are repeated as a whole; of each distinct stretch
under a key with several, one copy goes to a shard.

A shard builds the suffix array of its stretches by Larsson-Sadakane refinement, the common
prefixes by Kasai's scan, and marks the windows whose prefix with a neighbour reaches
``SIZE``. A key with more stretches than a shard takes is dealt over several; each then sends
the fingerprints of its windows in sorted order, by ranges, and ranges of different shards are
merged by binary search. What is marked is joined to the texts, each distinct text once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrisk.llm.common import small_batches, written

#: Bytes of a window and of the strings that choose its key.
SIZE, KEY = 400, 128
#: Stretches of one key in a shard, and bytes of stretches sorted together.
STRETCHES, SHARD = 1024, 1 << 21
#: Bytes of text scanned together, of a piece of a longer text, and digests of texts that a task remembers having scanned.
SCAN, PIECE, SEEN = 1 << 20, 1 << 21, 1 << 18

RUNS = "t1 long, t2 long, key long, print long, start int, end int, periodic boolean"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# ---- windows, keys and runs


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(n.bit_length()):  # each step doubles what is known
        m = 1 << i
        if m >= n:
            break
        out[m : 2 * m] = out[: min(m, n - m)] * np.uint64(pow(base, m, 1 << 64))
    return out


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


class Hashes:
    """Hashes of all substrings of some bytes by prefix sums of powers modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        n = 1 << max(SCAN.bit_length(), int(len(raw)).bit_length())
        # bytes first go through a table, so that low bits of hashes depend on all of a byte
        letters = _mixed(np.arange(1, 257, dtype=np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[raw] * _powers(BASE, n)[: len(raw)], dtype=np.uint64)])
        self.inverse = _powers(INVERSE, n)

    def __call__(self, start, end) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, size: int) -> np.ndarray:
        """Of all substrings of one size."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` successive values, from minima within blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the texts that ``raw`` joins, of at most 2**24 bytes: number of the text, key,
    fingerprint, first and last start (within the text), and whether the key occurs more than
    once in the run, so that its windows may repeat each other."""
    hashes = Hashes(raw)
    grams = hashes.every(KEY)
    place = np.uint64((1 << 24) - 1)
    least = sliding_minimum((grams & ~place) | np.arange(len(grams), dtype=np.uint64), SIZE - KEY + 1)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = np.maximum(np.diff(ends, prepend=0) - SIZE + 1, 0)
    text = np.repeat(np.arange(len(ends)), sizes)  # of each window inside a text
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    chosen = (least[at] & place).astype(np.int64)
    key = grams[chosen]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    moved = np.concatenate([[0], np.cumsum((chosen[1:] != chosen[:-1]) & ~new[1:])])
    lo, hi = at[first], at[last]
    return text[first], key[first].view(np.int64), hashes(lo, hi + SIZE).view(np.int64), lo - starts[text[first]], hi - starts[text[first]], moved[last] > moved[first]


def _digest(text: str | None) -> tuple[bytes, bytes]:
    raw = (text or "").encode()
    return raw, hashlib.sha256(raw).digest()


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(d[:16] for d in digests), "<i8").reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _first_seen(batches) -> Iterator[tuple[bytes, bytes]]:
    """Long enough texts of a task with their digests, repeats mostly left out: what a task
    remembers is bounded, and later steps take texts by digest."""
    seen: set[bytes] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text is None or 4 * len(text) < SIZE:
                continue
            raw, digest = _digest(text)
            if len(raw) < SIZE or digest[:16] in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(digest[:16])
            yield raw, digest


def _scan(batches):
    """Runs of a task's texts; a text longer than ``PIECE`` bytes is scanned in pieces."""

    def out(texts, digests, offsets):
        which, *columns = runs(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
        if not len(which):
            return
        halves = [h.take(pa.array(which)) for h in _halves(digests)]
        shift = np.array(offsets)[which]
        key, prints, lo, hi, periodic = columns
        yield pa.RecordBatch.from_arrays([*halves, pa.array(key), pa.array(prints), pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32)), pa.array(periodic)], names=[c.split()[0] for c in RUNS.split(", ")])

    held, digests, offsets, size = [], [], [], 0
    for raw, digest in _first_seen(batches):
        for at in range(0, max(len(raw) - SIZE + 1, 1), PIECE):
            part = raw[at : at + PIECE + SIZE - 1]  # windows of neighbouring pieces don't overlap
            if size + len(part) > SCAN and held:
                yield from out(held, digests, offsets)
                held, digests, offsets, size = [], [], [], 0
            held.append(part)
            digests.append(digest)
            offsets.append(at)
            size += len(part)
    if held:
        yield from out(held, digests, offsets)


# ---- suffix arrays


def suffix_array(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes of the texts that ``raw`` joins, sorted; a suffix ends with its text, and
    of equal ones that of the earlier text comes first.

    Larsson-Sadakane: suffixes are sorted by their first eight bytes; then groups that are
    still equal are refined by the rank of what follows, which doubles the sorted length
    each time. Suffixes that are alone in their group are not touched again.
    """
    n, text = len(raw), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    rest = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # bytes to the text's end
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | np.where(k < rest, padded[k : k + n], 0)
    # equal words that end differently differ by length: what is shorter comes first
    order = np.lexsort((np.minimum(rest, 8), word)) if (rest < 8).any() else np.argsort(word, kind="stable")
    differs = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (np.minimum(rest, 8)[order][1:] != np.minimum(rest, 8)[order][:-1])])
    first = np.flatnonzero(differs)
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(first, sizes)  # a group's number is the place of its first suffix
    h = 8
    open_groups = sizes > 1
    places = np.repeat(open_groups, sizes).nonzero()[0]
    while len(places):
        suffix = order[places]
        after = np.where(rest[suffix] > h, rank[np.minimum(suffix + h, n - 1)] + len(ends), text[suffix])
        group = rank[suffix]
        by = np.argsort(group << 32 | after, kind="stable")
        suffix, group, after = suffix[by], group[by], after[by]
        order[places] = suffix  # groups lie in order, so their suffixes only move within them
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(places)))
        rank[suffix] = np.repeat(places[first], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def kasai(raw: np.ndarray, ends: np.ndarray, order: np.ndarray, cap: int = SIZE) -> np.ndarray:
    """Of each place in a suffix array the common prefix with the suffix before it, up to ``cap``.

    Kasai: going through a text from left to right, the prefix shrinks by one at most with
    each step. Texts are gone through side by side, one step each at a time, eight bytes a look.
    """
    n = len(raw)
    start = np.concatenate([[0], ends[:-1]])
    rest = (np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)).astype(np.int32)
    padded = np.concatenate([raw, np.zeros(cap + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + cap + 8, 8), (1, 1))  # a view of eight bytes from every place
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, np.int32)
    at, until, h = start.copy(), ends.copy(), np.zeros(len(ends), np.int64)
    live = np.flatnonzero(until > at)
    at, until, h = at[live], until[live], h[live]
    while len(at):
        other = before[at]
        none = other < 0
        other = np.where(none, at, other)
        limit = np.minimum(np.minimum(rest[at], rest[other]), cap)
        limit[none] = 0
        h = np.minimum(h, limit)
        same = words[at + h] == words[other + h]
        full = same.all(1)
        step = np.where(full, 8, same.argmin(1))
        h = np.minimum(h + step, limit)
        done = ~full | (h >= limit)
        prefix[at[done]] = h[done]
        at = at + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        going = at < until
        if not going.all():
            at, until, h = at[going], until[going], h[going]
    return prefix[order]


def repeated_windows(raw: np.ndarray, ends: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For each place whether the window that starts there also starts at another one."""
    order = suffix_array(raw, ends)
    long = kasai(raw, ends, order, size) >= size
    out = np.zeros(len(raw), bool)
    out[order] = long | np.append(long[1:], False)
    return out


# ---- shards


SHARDED = "kind int, t1 long, t2 long, start int, end int, key long, bucket int, prints binary, places binary, owners binary"


def _spans(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _shards(batches):
    """Marks repeated windows of stretches that come by key and shard, many keys at a time.

    Rows of kind 0 are spans; of kind 1, for keys dealt over shards, sorted fingerprints of a
    shard's windows in one range of fingerprints, their places, and texts of those windows
    that the shard itself has no second copy of.
    """

    def out(rows):
        bodies = [r["body"] for r in rows]
        sizes = np.array([len(b) for b in bodies])
        ends = np.cumsum(sizes)
        first = ends - sizes
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        twice = repeated_windows(raw, ends)
        spans: list[tuple] = []
        for r, lo, n in zip(rows, first.tolist(), sizes.tolist(), strict=True):
            a, b = _spans(twice[lo : lo + n - SIZE + 1])
            if r["own"]:
                spans += [(r["t1"], r["t2"], r["start"] + x, r["start"] + y + SIZE) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        if spans:
            t1, t2, lo, hi = (np.array(c) for c in zip(*spans, strict=True))
            yield _sharded(len(spans), kind=np.zeros(len(spans), np.int32), t1=t1, t2=t2, start=lo.astype(np.int32), end=hi.astype(np.int32))
        split = [i for i, r in enumerate(rows) if r["shards"] > 1]
        if split:
            prints = Hashes(raw).every(SIZE)
            by_shard: dict[tuple[int, int], list[int]] = {}
            for i in split:
                by_shard.setdefault((rows[i]["key"], rows[i]["shards"]), []).append(i)
            for (key, shards), members in by_shard.items():
                at = np.concatenate([np.arange(first[i], ends[i] - SIZE + 1) for i in members])
                owner = np.repeat(members, [sizes[i] - SIZE + 1 for i in members])
                order = np.argsort(prints[at], kind="stable")
                at, owner = at[order], owner[order]
                value = prints[at]
                cuts = np.searchsorted(value, np.array([(b << 64) // shards for b in range(1, shards)], np.uint64))
                for bucket, part in enumerate(np.split(np.arange(len(at)), cuts)):
                    if not len(part):
                        continue
                    alone = np.flatnonzero(~twice[at[part]] & np.array([rows[i]["own"] for i in owner[part]]))
                    texts = [(rows[i]["t1"], rows[i]["t2"], rows[i]["start"] + p - first[i]) for i, p in zip(owner[part][alone].tolist(), at[part][alone].tolist(), strict=True)]
                    yield _sharded(1, kind=np.ones(1, np.int32), key=np.array([key]), bucket=np.array([bucket], np.int32), prints=[value[part].tobytes()], places=[alone.astype(np.int32).tobytes()], owners=[np.array(texts, np.int64).tobytes()])

    held, size = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            # a key's shard stays together: rows come sorted by key and shard
            if size >= SHARD and (r["key"], r["shard"]) != (held[-1]["key"], held[-1]["shard"]):
                yield from out(held)
                held, size = [], 0
            held.append(r)
            size += len(r["body"])
    if held:
        yield from out(held)


def _sharded(n: int, **columns) -> pa.RecordBatch:
    arrays, names = [], []
    for c in SHARDED.split(", "):
        name, kind = c.split()
        names.append(name)
        as_kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]
        arrays.append(pa.array(columns[name], as_kind) if name in columns else pa.nulls(n, as_kind))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _merge(t: pa.Table) -> pa.Table:
    """Windows of different shards of one key in one range of fingerprints: each shard's
    sorted ones are looked up in the others' by binary search."""
    lists = [np.frombuffer(b.as_py(), np.uint64) for b in t.column("prints")]
    lone = [np.frombuffer(b.as_py(), np.int32) for b in t.column("places")]
    texts = [np.frombuffer(b.as_py(), np.int64).reshape(-1, 3) for b in t.column("owners")]
    # shards' distinct values, merged in sorted order: a value that stays twice is in two shards
    merged = np.zeros(0, np.uint64)
    shared = np.zeros(0, np.uint64)
    for own in lists:
        own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        at = np.searchsorted(merged, own)
        hit = (at < len(merged)) & (merged[np.minimum(at, max(len(merged) - 1, 0))] == own) if len(merged) else np.zeros(len(own), bool)
        shared = np.concatenate([shared, own[hit]])
        merged = np.insert(merged, at[~hit], own[~hit])
    shared = np.unique(shared)
    found = []
    for own, places, owners in zip(lists, lone, texts, strict=True):
        value = own[places]
        at = np.minimum(np.searchsorted(shared, value), max(len(shared) - 1, 0))
        if len(shared):
            found.append(owners[shared[at] == value])
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # neighbouring starts of one text are one span
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(rows[:, 2]) != 1) | (np.diff(rows[:, :2], axis=0) != 0).any(1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(rows)) - 1 if len(rows) else head
    return pa.table({"t1": rows[head, 0], "t2": rows[head, 1], "start": rows[head, 2].astype(np.int32), "end": (rows[tail, 2] + SIZE).astype(np.int32)})


# ---- the whole job


def _cut(batches):
    """The stretches that texts are asked for, with their bytes."""
    out, size = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            raw = r["text"].encode()
            for x in r["asked"]:
                body = raw[x["start"] : x["end"] + SIZE]
                out.append({"t1": r["t1"], "t2": r["t2"], **{k: x[k] for k in ("key", "shard", "shards", "start", "own")}, "body": body})
                size += len(body)
                if size >= SCAN:
                    yield pa.RecordBatch.from_pylist(out, schema=_STRETCH)
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_STRETCH)


STRETCH = "t1 long, t2 long, key long, shard int, shards int, start int, own boolean, body binary"
_STRETCH = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]]) for c in STRETCH.split(", ")])


def _apply(batches):
    """What is left of each text without the union of its spans, with numbers and a digest."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            raw = r["text"].encode()
            kept, at, removed, spans, until = [], 0, 0, 0, -1
            for s in sorted((x["start"], x["end"]) for x in r["spans"]):
                if s[0] > until:
                    kept.append(raw[at : s[0]])
                    spans += 1
                    removed += s[1] - s[0]
                elif s[1] > until:
                    removed += s[1] - until
                at = until = max(until, s[1])
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append({"t1": r["t1"], "t2": r["t2"], "n_removed": removed, "n_spans": spans, "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))


def _distinct(batches):
    held, digests, size = [], [], 0

    def out():
        return pa.RecordBatch.from_arrays([*_halves(digests), pa.array(held, pa.string())], names=["t1", "t2", "text"])

    for raw, digest in _first_seen(batches):
        held.append(raw.decode())
        digests.append(digest)
        size += len(raw)
        if size >= SCAN:
            yield out()
            held, digests, size = [], [], 0
    if held:
        yield out()


def _named(batches):
    for batch in batches:
        found = [_digest(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *_halves([d for _, d in found]), pa.array([len(r) for r, _ in found], pa.int64()), pa.array([d.hex() for _, d in found], pa.string()), pa.array([r for r, _ in found], pa.binary())],
            names=["doc_id", "t1", "t2", "n_bytes", "sha256", "raw"],
        )


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of distinct texts (``t1, t2``: the digest's first 16 bytes) whose bytes repeat
    elsewhere in these or other distinct texts, ``start`` to ``end`` within the text's bytes; and
    those texts."""
    who = ["t1", "t2"]
    texts = docs.select("text")
    scanned = written(texts.mapInArrow(_scan, RUNS).dropDuplicates(), "runs")
    # distinct stretches: how many texts' runs have them, and one of these to stand for all
    stretch = scanned.groupBy("key", "print").agg(F.count("*").alias("n"), F.min(F.struct(*who, "start")).alias("one"), F.max("periodic").alias("periodic"))
    many = stretch.groupBy("key").agg(F.count("*").alias("distinct"), F.max("n").alias("most"), F.max("periodic").alias("periodic"))
    keys = written(many.filter((F.col("distinct") > 1) | (F.col("most") > 1) | F.col("periodic")).select("key", "distinct", F.col("periodic").alias("any_periodic")), "keys")
    kept = written(scanned.join(keys.hint("merge"), "key"), "kept")
    prints = written(kept.groupBy("key", "print").agg(F.count("*").alias("n"), F.min(F.struct(*who, "start")).alias("one")), "prints")
    known = kept.join(prints.hint("merge"), ["key", "print"])
    asks = ((F.col("distinct") > 1) | F.col("any_periodic")) & (F.col("one") == F.struct(*who, "start"))
    shards = F.ceil(F.col("distinct") / STRETCHES).cast("int")
    asked = F.when(asks, F.struct("key", F.pmod(F.xxhash64("print"), shards).cast("int").alias("shard"), shards.alias("shards"), "start", "end", (F.col("n") == 1).alias("own")))
    whole = F.when(F.col("n") > 1, F.struct("start", (F.col("end") + SIZE).alias("end")))
    # a text's runs are bounded by its length; collect_list leaves out what is null
    per_text = known.groupBy(*who).agg(F.collect_list(asked).alias("asked"), F.collect_list(whole).alias("whole"))

    once = texts.mapInArrow(_distinct, "t1 long, t2 long, text string").groupBy(*who).agg(F.first("text").alias("text"))
    held = written(once.join(per_text.hint("merge"), who), "texts")
    stretches = held.filter(F.size("asked") > 0).select(*who, "text", "asked").mapInArrow(_cut, STRETCH)
    dealt = stretches.repartition("key", "shard").sortWithinPartitions("key", "shard")
    sharded = written(dealt.mapInArrow(_shards, SHARDED), "shards")
    marked = sharded.filter("kind = 0").select(*who, "start", "end")
    merged = sharded.filter("kind = 1").select("key", "bucket", "prints", "places", "owners").groupBy("key", "bucket").applyInArrow(_merge, "t1 long, t2 long, start int, end int")
    full = held.select(*who, F.explode("whole").alias("s")).select(*who, "s.start", "s.end")
    return full.unionByName(marked).unionByName(merged), held.select(*who, "text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Removes from every text of ``doc_id, text``, as UTF-8, each byte that a string of
    ``SIZE`` bytes covers which also starts anywhere else, in the same text or another.

    Returns per row ``doc_id``, the numbers of bytes, of removed bytes and of removed runs, the
    digest of what is left, and ``kept``, these bytes: a cut may lie inside a character. A null text is empty; shorter texts stay as they are; each of
    several equal texts of ``SIZE`` bytes or more goes wholly. A null doc_id stays null,
    repeated rows are texts of their own, other columns are ignored; an empty table gives an
    empty result. Stretches are told apart by their key and a 64-bit fingerprint.
    """
    small_batches(docs.sparkSession, 128)
    who = ["t1", "t2"]
    spans, texts = repeated_spans(docs)
    gathered = spans.groupBy(*who).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    results = texts.join(gathered.hint("merge"), who).mapInArrow(_apply, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    named = docs.select("doc_id", "text").mapInArrow(_named, "doc_id long, t1 long, t2 long, n_bytes long, sha256 string, raw binary")
    copies = named.filter(F.col("n_bytes") >= SIZE).groupBy(*who).agg(F.count("*").alias("copies")).filter("copies > 1")
    changed = written(copies.join(results, who, "full").select(*who, "copies", "n_removed", "n_spans", "kept_sha256", "kept"), "changed")
    twice = F.col("copies").isNotNull()
    nothing = hashlib.sha256(b"").hexdigest()
    return named.join(changed.hint("merge"), who, "left").select(
        "doc_id", "n_bytes",
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(twice, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twice, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(twice, F.lit(b"")).otherwise(F.coalesce("kept", "raw")).alias("kept"),
    )
