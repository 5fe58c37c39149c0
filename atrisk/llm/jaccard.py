"""Exact Jaccard self-join of word shingles through parity sketches.

A document's set holds its distinct shingles as 64-bit hashes. A parity sketch has one
64-bit word per block of a size band; every shingle XORs its hash into one word. An
element of the symmetric difference changes at most one word, so the number of words in
which two sketches differ is at most the size of that difference, and a pair with
similarity s has at most (1 - s) / (1 + s) * (|A| + |B|) of them. By pigeonhole such a
pair shares one of the first d + 1 non-empty words of either sketch in a common order,
where d is the most a partner can differ. Words holding frequent shingles come last in
that order: shared passages then rarely serve as join keys. The order decides about
speed only, so the list of frequent shingles may be bounded without losing a pair.

Bands double twice; a document that may have partners in the next band joins there too.

Candidates are never all pairs of a group. Each member of a key's group first meets one
head, the one with which it shares most keys (in runs of few sets each other); verified links are merged into components.
Where a key's members stay in several components, each meets the heads of some of its keys
and keeps the nearest by sketches folded to 512 bits, in ``HEAD_ROUNDS`` rounds with other
heads. All this only joins components early: at the end every member outside its key's
largest component meets all members of other components, once for each pair (under the
smallest key both hold, as far as their ``LOWEST`` smallest tell), if the folded sketches allow
a link; that test is part of the join's condition. Before any text is fetched a pair is
tested on bit sketches (two bits or more a shingle), whose Hamming distance bounds the
symmetric difference from below as well; what is left is verified on the shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrisk.llm.common import small_batches, written

U64 = np.uint64
#: At most this many frequent shingles are sent to every task (8 bytes each).
FREQUENT = 250_000
#: A shingle counts as frequent where this many sets among those counted together hold it.
FREQUENT_FROM = 4
#: Rounds in which components of one key meet through heads, and how many keys take part.
HEAD_ROUNDS, HEAD_SHARE = 1, 4
#: In runs of so few sets of one key these meet each other without sketches beside the key.
FEW = 4
#: Keys of a set that tell under which key a pair of sets meets.
LOWEST = 4
#: A row's text beside its doc_id, which may be null or repeat: its hash.
TEXT = "text_hash"
#: 64-bit words of a folded sketch.
FOLD = 8
#: Shingles counted together (some thousand sets), whatever a task reads.
COUNTED = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE = _mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_P, _P_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _P_INVERSE)):
            x = np.full(n, p, U64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=U64)
    return _powers


def shingles(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words are runs of anything but
    ASCII white space with A-Z in lower case; a shorter text is one shingle, an empty none."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out = []
    at = 0
    while at < len(raw):  # a few texts at a time bound the arrays
        n, to = 0, at
        while to < len(raw) and (n == 0 or n + len(raw[to]) < 1 << 21):
            n += len(raw[to]) + 1
            to += 1
        out += _shingles(raw[at:to], width)
        at = to
    return out


def _shingles(raw: list[bytes], width: int) -> list[np.ndarray]:
    a = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    power, inverse = _power_tables(len(a))
    space = _SPACE[a]
    total = np.cumsum(_BYTE[a] * power[: len(a)], dtype=U64)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:])
    word = _mix((total[ends] - total[starts - 1]) * inverse[starts])
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]) + 1
    bound = np.searchsorted(starts, first)
    joined = np.zeros(max(0, len(word) - width + 1), U64)
    for k in range(width):
        joined = _mix(joined * U64(31) + word[k : k + len(joined)])
    out = []
    for i, j in zip(bound[:-1], bound[1:], strict=True):
        if j - i >= width:
            out.append(np.unique(joined[i : j - width + 1]))
        elif j > i:
            out.append(np.frombuffer(hashlib.blake2b(word[i:j].tobytes(), digest_size=8).digest(), U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def most_differing(n: int, percent: int) -> int:
    """The most elements in which a set of n can differ from one that links with it."""
    largest = n * 100 // percent
    return (100 - percent) * (n + largest) // (100 + percent)


def bands(n: int, percent: int) -> list[int]:
    """The bands (by their exponent: sizes below 4**j) in which a set of n looks for partners."""
    j = (n.bit_length() + 1) // 2
    return [j, j + 1] if n * 100 // percent >= 4**j else [j]


def block_keys(s: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """Join keys of a set: hashes of (band, block, word), rare ones first, d + 1 per band."""
    n, out = len(s), []
    d = most_differing(n, percent)
    late = np.zeros(n, bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    for j in bands(n, percent):
        if 4**j <= 64:
            word, hot = s, late
        else:
            blocks = 4**j * 3 // 5
            block = (_mix(s ^ U64(0x5851F42D4C957F2D)) >> U64(32)) % U64(blocks)
            order = np.argsort(block, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) > 0]))
            word = np.bitwise_xor.reduceat(s[order], edge) ^ _mix(block[order][edge] + U64(1))
            hot = np.logical_or.reduceat(late[order], edge)
        key = _mix(word ^ U64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        if len(key) > d + 1:
            # the highest bit of the order is whether it is frequent
            rank = (key >> U64(1)) | (hot.astype(U64) << U64(63))
            key = key[np.argpartition(rank, d)[: d + 1]]
        out.append(key)
    return np.concatenate(out)


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity bits, a power of two and two to four per element, at least a folded sketch."""
    bits = 1 << max((64 * FOLD).bit_length() - 1, (2 * len(s) - 1).bit_length())
    place = _mix(s ^ U64(0x2545F4914F6CDD1D)) & U64(bits - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of two sets' symmetric difference from their bit sketches; the longer
    sketch folds to the shorter, as places are taken by their low bits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), 0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def links(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _batch(names_types: dict, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names_types.values(), strict=True)], names=list(names_types))


_LONG, _INT, _BIN = pa.int64(), pa.int32(), pa.binary()


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A merge join at every size: all sides here grow with the corpus, so none is broadcast."""
    return left.join(right.hint("merge"), on, how)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias(TEXT), "text")


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """Per row its set's id, size and bit sketch; besides, shingles frequent in a task."""
    form = {"doc_id": _LONG, TEXT: _LONG, "sid": _LONG, "n": _INT, "sketch": _BIN, "shingle": _LONG, "df": _LONG}

    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counted():
            values, df = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U64), np.zeros(0, int))
            held.clear()
            keep = df >= FREQUENT_FROM
            values, df = values[keep].view(np.int64), df[keep]
            none = [None] * len(values)
            return _batch(form, [none, none, none, none, none, values, df])

        for batch in batches:
            rows = []
            for doc_id, text, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles(batch.column(2).to_pylist(), width), strict=True):
                if not len(s):
                    rows.append((doc_id, text, None, 0, None))
                    continue
                sid = set_id(s)
                new = sid not in seen
                if new:  # copies count once
                    seen.add(sid)
                    held.append(s)
                    size += len(s)
                rows.append((doc_id, text, sid, len(s), bit_sketch(s) if new else None))
            if rows:
                yield _batch(form, [*zip(*rows, strict=True), *[[None] * len(rows)] * 2])
            if size > COUNTED:
                yield counted()
                size = 0
        yield counted()

    return _identified(docs).select("doc_id", TEXT, "text").mapInArrow(run, f"doc_id long, {TEXT} long, sid long, n int, sketch binary, shingle long, df long")


def _keys(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    form = {"key": _LONG, "sid": _LONG, "n": _INT}

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, sids, sizes = [], [], []
            for s in shingles(batch.column(0).to_pylist(), width):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                k = block_keys(s, percent, frequent.value)
                keys.append(k.view(np.int64))
                sids.append(np.full(len(k), sid))
                sizes.append(np.full(len(k), len(s), np.int32))
            if keys:
                yield _batch(form, [np.concatenate(x) for x in (keys, sids, sizes)])

    return docs.select("text").mapInArrow(run, "key long, sid long, n int")


def _shared(keys: DataFrame, percent: int) -> DataFrame:
    """Of keys dealt and sorted by (key, n, sid): who shares a key with whom.

    A key's sets fall into runs whose sizes don't rule out a link from one to the next; sets
    of two runs never link. In a run of ``FEW`` at most each set meets those before it, with a
    null key; in a longer one every set comes with the run's key and its head, the smallest
    set. Streams, so that a run of any size needs a few rows only."""
    form = {"key": _LONG, "sid": _LONG, "n": _INT, "head": _LONG, "head_n": _INT}

    def rows(key, sid, n, known, more):
        """The output of sorted rows; ``known`` is the run key and head of a long run whose last
        row comes first; the last run is held back if it may go on and isn't long yet."""
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64))]))
        size = np.diff(np.concatenate([starts, [len(key)]]))
        name = _mix(key[starts].view(U64) ^ _mix(n[starts].astype(U64) + U64(1))).view(np.int64)
        head, head_n, many = sid[starts], n[starts], size > FEW
        if known:
            name[0], head[0], head_n[0], many[0] = *known, True
        last = (int(name[-1]), int(head[-1]), int(head_n[-1])) if many[-1] else None
        hold = int(starts[-1]) if more and not many[-1] else len(key)
        each = np.repeat(np.arange(len(starts)), size)
        emit = many[each]
        emit[0] &= not known
        out = [(name[each][emit], sid[emit], n[emit], head[each][emit], head_n[each][emit])]
        for lag in range(1, FEW):
            i = np.arange(lag, hold)
            i = i[(each[i] == each[i - lag]) & ~many[each[i]] & (100 * n[i - lag].astype(np.int64) >= percent * n[i].astype(np.int64))]
            out.append((None, sid[i], n[i], sid[i - lag], n[i - lag]))
        made = [pa.concat_arrays([pa.nulls(len(o[1]), t) if o[c] is None else pa.array(o[c], t) for o in out]) for c, t in enumerate(form.values())]
        return pa.RecordBatch.from_arrays(made, names=list(form)), hold, last

    def run(batches):
        held, known = None, None  # rows of the run that may go on, or its last row
        for batch in batches:
            part = [batch.column(i).to_numpy() for i in range(3)]
            if not len(part[0]):
                continue
            if held is not None:
                part = [np.concatenate([h, p]) for h, p in zip(held, part, strict=True)]
            fresh = np.ones(len(part[0]), bool)
            fresh[1:] = (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1])
            part = [p[fresh] for p in part]
            made, hold, known = rows(*part, known, True)
            held = [p[min(hold, len(p) - 1) :] for p in part]
            if made.num_rows:
                yield made
        if held is not None:
            yield rows(*held, known, False)[0]

    return keys.repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(run, "key long, sid long, n int, head long, head_n int")


def _near_by_sketch(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, shared) whose sizes and bit sketches don't rule out a link. The pairs and
    the sketches they need are written first: by their size the planner sends few pairs to
    the sketches rather than all sketches around."""
    pairs = written(pairs, "candidates")
    sketches = written(_join(sketches, pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi"), "wanted-sketches")
    left = sketches.select(F.col("sid").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("asketch"))
    right = sketches.select(F.col("sid").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bsketch"))

    def run(batches):
        for batch in batches:
            an, bn, x, y = (batch.column(c).to_pylist() for c in ("an", "bn", "asketch", "bsketch"))
            keep = [least_difference(p, q) <= (100 - percent) * (i + j) // (100 + percent) for i, j, p, q in zip(an, bn, x, y, strict=True)]
            yield batch.select(["a", "b", "shared"]).filter(pa.array(keep, pa.bool_()))

    both = _join(_join(pairs, left, "a"), right, "b").select("a", "b", "shared", "an", "bn", "asketch", "bsketch")
    return both.mapInArrow(run, "a long, b long, shared long")


def _sets(docs: DataFrame, sids: DataFrame, owners: DataFrame, width: int) -> DataFrame:
    """The shingle sets of the given ids, each from the text of one owner.

    Owners are rows by doc_id, null or not, and text; a set that isn't the wanted one (of
    another text with the same hash) is left out. The wanted ids are written first, so that
    the planner knows their size: texts are shuffled only where the ids are beyond its limit
    for a broadcast."""

    def run(batches):
        for batch in batches:
            sets = shingles(batch.column(1).to_pylist(), width)
            keep = [i for i, (sid, s) in enumerate(zip(batch.column(0).to_pylist(), sets, strict=True)) if len(s) and set_id(s) == sid]
            yield _batch({"sid": _LONG, "items": _BIN}, [batch.column(0).take(pa.array(keep, pa.int64())), [sets[i].tobytes() for i in keep]])

    wanted = written(_join(owners, sids, "sid", "left_semi"), "wanted")
    texts = _join(_identified(docs).alias("t"), wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.owner")) & (F.col(f"t.{TEXT}") == F.col(f"w.{TEXT}"))).select("sid", "text")
    return texts.mapInArrow(run, "sid long, items binary").dropDuplicates(["sid"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                keep.append(links(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = _join(sets, pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")
    left, right = (sets.select(F.col("sid").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
    return _join(_join(pairs.select("a", "b"), left, "a"), right, "b").select("a", "b", "a_items", "b_items").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` (the smallest id reachable) of every node of ``edges`` (a, b).

    Alternates large and small stars; each round writes its edges to the shared folder
    and reads one row, a checksum, on the driver. A node's edges are never gathered: each
    round takes minima with partial aggregation and joins them back.
    """
    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _join(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _join(large, floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u != v").distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            # every edge now leads to a root
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root").unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        state = now


_FOLDS = [f"f{i}" for i in range(FOLD)]


def _folded(sketches: DataFrame) -> DataFrame:
    """``sid, f0 ...``: sketches folded to FOLD words."""
    names = _FOLDS

    def run(batches):
        for batch in batches:
            rows = [np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, FOLD), 0) for x in batch.column(1).to_pylist()]
            if rows:
                yield _batch(dict.fromkeys(["sid", *names], _LONG), [batch.column(0), *np.stack(rows).T])

    return sketches.select("sid", "sketch").mapInArrow(run, ", ".join(f"{c} long" for c in ["sid", *names]))


def _apart(members: DataFrame, root: DataFrame) -> DataFrame:
    """``key, sid, n, root``: members of the keys whose members are in several components."""
    placed = _join(members.select("key", "sid", "n"), root.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    return written(_join(placed, mixed, "key"), "apart")


def _merged(reached: DataFrame, more: DataFrame) -> DataFrame:
    """``id, root`` after further links: only components that these join are searched again."""
    first = lambda c: reached.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    placed = _join(_join(more, first("a"), "a", "left"), first("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    again = written(components(placed), "roots").select(F.col("id").alias("root"), F.col("root").alias("higher"))
    moved = _join(reached, again, "root", "left").select("id", F.coalesce("higher", "root").alias("root"))
    new = again.select(F.col("root").alias("id"), F.col("higher").alias("root"))
    new = _join(new, reached.select("id"), "id", "left_anti")
    return written(moved.unionByName(new), "roots")


def _nearest_heads(apart: DataFrame, folded: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b, shared): every member of a part of the keys with the nearest two heads in
    other components. Heads are drawn by a hash, so that a member has many to choose from;
    rows stay one a member and key."""
    some = apart.filter(F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(HEAD_SHARE)) == 0).select("key", "sid", "n", "root")
    some = written(_join(some, folded, "sid"), "some")
    columns = ("sid", "n", "root", *_FOLDS)
    head = some.groupBy("key").agg(F.min_by(F.struct(*columns), F.xxhash64("key", "sid", F.lit(-turn))).alias("h"))
    met = _join(some, head, "key").select(*columns, *(F.col(f"h.{c}").alias(f"h_{c}") for c in columns), (F.pmod(F.xxhash64("key"), F.lit(2)) == 0).alias("even"))
    met = met.withColumn("far", F.expr(" + ".join(f"bit_count({c} ^ h_{c})" for c in _FOLDS)))
    met = met.filter(f"root != h_root and 100 * least(n, h_n) >= {percent} * greatest(n, h_n) and {100 + percent} * far <= {100 - percent} * (n + h_n)")
    near = lambda test: F.min_by(F.when(test, F.col("h_sid")), F.when(test, F.struct("far", "h_sid")))
    best = met.groupBy(F.col("sid").alias("a")).agg(F.array_distinct(F.array_compact(F.array(near(F.col("even")), near(~F.col("even"))))).alias("b"))
    return best.select("a", F.explode("b").alias("b"), F.lit(1).cast("long").alias("shared"))


def _still_apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs (a, b, an, bn) whose sets are in different components."""
    of = lambda c: root.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    return _join(_join(pairs, of("a"), "a", "left"), of("b"), "b", "left").filter("coalesce(a_root, a) != coalesce(b_root, b)").select("a", "b", "an", "bn")


def _near_folded(pairs: DataFrame, folded: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose folded sketches don't rule out a link."""
    of = lambda c: folded.select(F.col("sid").alias(c), *(F.col(f).alias(f"{c}_{f}") for f in _FOLDS))
    differ = " + ".join(f"bit_count(a_{f} ^ b_{f})" for f in _FOLDS)
    return _join(_join(pairs, of("a"), "a"), of("b"), "b").filter(f"{100 + percent} * ({differ}) <= {100 - percent} * (an + bn)").select("a", "b")


def _of_many(many: DataFrame, folded: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one key in different components, as far as sizes and folded
    sketches allow a link. All but the key's largest component meet the others."""
    largest = many.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
    low = many.groupBy("sid").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOWEST).alias("low"))
    placed = written(_join(_join(many.select("key", "sid", "n", "root"), largest, "key"), _join(folded, low, "sid"), "sid"), "apart")
    columns = ("sid", "n", "root", "low", *_FOLDS)
    x = placed.filter("root != largest").select("key", *(F.col(c).alias(f"x_{c}") for c in columns))
    y = placed.select("key", (F.col("root") == F.col("largest")).alias("inner"), *(F.col(c).alias(f"y_{c}") for c in columns))
    differ = " + ".join(f"bit_count(x_{c} ^ y_{c})" for c in _FOLDS)
    met = _join(x, y, "key").filter(
        f"x_root != y_root and (inner or x_sid < y_sid) and 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n) and {100 + percent} * ({differ}) <= {100 - percent} * (x_n + y_n)"
        " and coalesce(key = array_min(array_intersect(x_low, y_low)), true)"
    )
    return met.select(F.least("x_sid", "y_sid").alias("a"), F.greatest("x_sid", "y_sid").alias("b"))


def grouped(docs: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, text_hash, n, root`` of every row: rows whose sets are joined by links have the
    same root; it is null for an empty set. Rows are told apart by doc_id and text, so ids
    may be null or repeat with other texts."""
    spark = docs.sparkSession
    small_batches(spark)
    described = written(_describe(docs, width), "sets")
    rows = described.filter("n is not null").select("doc_id", TEXT, "sid", "n")
    sketches = described.filter("sketch is not null").groupBy("sid", "n").agg(F.min("sketch").alias("sketch"))
    sketches = written(sketches, "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", TEXT))
    owners = rows.filter("sid is not null").groupBy("sid").agg(first.alias("o")).select("sid", F.col("o.doc_id").alias("owner"), F.col(f"o.{TEXT}").alias(TEXT))
    common = described.filter("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "shingle").limit(FREQUENT).select("shingle").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(common.column(0).to_numpy().view(U64)))

    shared = written(_shared(_keys(docs, width, percent, frequent), percent), "members")
    members = shared.filter("key is not null")
    near = f"sid != head and 100 * head_n >= {percent} * n"
    heads = shared.filter(near).groupBy(F.col("sid").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("shared"), F.max(F.col("key").isNull()).alias("few"), F.max("n").alias("an"), F.max("head_n").alias("bn"))
    heads = written(heads, "heads")
    # one head for each set: the one with which it shares most keys
    best = heads.groupBy("a").agg(F.max_by(F.struct("b", "shared"), F.struct("shared", "b")).alias("h")).select("a", "h.*")
    sets = None

    def linked(pairs: DataFrame) -> DataFrame:
        nonlocal sets
        left = written(_near_by_sketch(pairs, sketches, percent), "pairs")
        wanted = left.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        fresh = _sets(docs, wanted if sets is None else _join(wanted, sets.select("sid"), "sid", "left_anti"), owners, width)
        fresh = written(fresh, "shingle-sets")
        sets = fresh if sets is None else sets.unionByName(fresh)
        return written(_verified(left, sets, percent), "links")

    def folded(members: DataFrame) -> DataFrame:
        return written(_folded(_join(sketches, members.select("sid").distinct(), "sid", "left_semi")), "folded")

    root = written(components(linked(best)), "roots")
    for turn in range(1, HEAD_ROUNDS + 1):
        members = _apart(members, root)
        root = _merged(root, linked(_nearest_heads(members, folded(members), percent, turn)))
    # whatever is still apart meets in full
    members = _apart(members, root)
    few = written(_still_apart(heads.filter("few"), root), "few")
    of_few = folded(few.select(F.explode(F.array("a", "b")).alias("sid")))
    pairs = _near_folded(few, of_few, percent).unionByName(_of_many(members, folded(members), percent))
    root = _merged(root, linked(pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))))
    return _join(rows, root.withColumnRenamed("id", "sid"), "sid", "left").select("doc_id", TEXT, "n", F.coalesce("root", "sid").alias("root"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Rows link when 100 * intersection >= percent * union of their shingle sets; component_id
    is the smallest doc_id reachable. A null or blank text has an empty set and links with
    nothing. Equal texts always link. Rows that repeat a doc_id, with the same text or others,
    are rows of their own; those with a null doc_id take part, but never name a component:
    alone they have a null component_id. Columns besides doc_id and text are ignored.
    """
    named = grouped(docs, width=width, percent=percent)
    least = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return _join(named, least, "root", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def survivors(docs: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component the row
    with the smallest doc_id stays (a null one only where there is no other; of several texts
    with that id the one of the smaller hash, of repeated rows any one). Rows without words
    all stay."""
    rows = grouped(docs, width=width, percent=percent).filter("root is not null")
    each = rows.groupBy("root", "doc_id", TEXT).agg(F.count("*").alias("rows"))
    kept = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", TEXT, "rows")).alias("k"))
    longest = max(docs.columns, key=len)
    own_id, own_text, own_rows = (f"{longest}_{i}" for i in range(3))  # of no column of the input
    kept = written(kept.select(F.col("k.doc_id").alias(own_id), F.col(f"k.{TEXT}").alias(own_text), F.col("k.rows").alias(own_rows)), "kept")
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = _join(docs.filter(~blank), kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_text)))
    one = found.filter(F.col(own_rows) > 1).dropDuplicates([own_id, own_text])
    return found.filter(F.col(own_rows) == 1).unionByName(one).select(*docs.columns).unionByName(docs.filter(blank))
