"""Hard negatives by a multiway hyperplane tree with distance ranges.

Vectors are lifted by one coordinate to a common length, so that a window of inner products
with an anchor is an annulus of distances around it. Each node of the tree has a few split
points; a vector goes to the child of the nearest one, and the node stores, for every split
point and child, the range of the distances of all vectors below that child. A child survives
for an anchor if every such range meets the annulus that its window allows; the leaves that
are left are compared exactly.

The split points come from a bounded sample (``SAMPLE`` rows by hash of the id); ranges and
leaves cover all rows. Leaves are stored in parts of bounded size and anchors come in blocks,
so a task compares one part with one block; what each pair keeps is a handful of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atrisk.llm.common import small_batches, written

#: Rows at most from which the split points are drawn, split points of a node, rows of a
#: leaf's part, and anchors of a block.
SAMPLE, SPLITS, PART, BLOCK = 16384, 8, 256, 1024
#: Relative slack for rounding in distances.
SLACK = 1e-6

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

#: The same by plain comparison of every anchor with every row.
ORACLE = """
with kept as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from kept a join kept b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id)::int as rank,
  n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positive p join scored n on n.anchor_id = p.anchor_id and not n.same and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify rank <= 3
"""


@dataclass
class Node:
    """Split points (lifted, one a row) and, by child, another node or the number of a leaf."""

    number: int
    points: np.ndarray
    children: list = field(default_factory=list)


@dataclass
class Tree:
    """The tree, with ``low[n, i, j]`` and ``high[n, i, j]``: the range of distances from split
    point i of node n to all rows below child j."""

    root: Node | int
    nodes: int
    leaves: int
    length: float  # the common length, squared
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def descend(self, lifted: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of every row; ``seen`` gets each node, its rows, their children and distances."""
        leaf = np.zeros(len(lifted), np.int64)
        todo: list = [(self.root, np.arange(len(lifted)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                leaf[rows] = node
                continue
            if not len(rows):
                continue
            d = distances(lifted[rows], node.points)
            child = d.argmin(1)
            if seen is not None:
                seen(node, rows, child, d)
            todo += [(node.children[j], rows[child == j]) for j in range(len(node.points))]
        return leaf

    def survivors(self, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the anchors that may have a row there at a distance from ``near`` to
        ``far``. An anchor's own lifted coordinate is 0: rows are at the distance that its
        inner product with them gives."""
        query = np.concatenate([anchors, np.zeros((len(anchors), 1))], 1)
        slack = SLACK * np.sqrt(max(self.length, 1.0))
        todo: list = [(self.root, np.arange(len(query)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            d, n = distances(query[rows], node.points), len(node.points)
            low, high = self.low[node.number, :n, :n], self.high[node.number, :n, :n]
            outer, inner = far[rows][:, None] + slack, near[rows][:, None] - slack
            for j in range(n):
                keeps = ((low[:, j] <= d + outer) & (high[:, j] >= d - outer) & (high[:, j] >= inner - d)).all(1)
                todo.append((node.children[j], rows[keeps]))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def grow(sample: np.ndarray, length: float, leaf: int) -> Tree:
    """A tree over the sample; a node whose sample has at most ``leaf`` rows, or only equal
    ones, is a leaf. Split points are the farthest from those chosen before."""
    tree = Tree(0, 0, 0, length)

    def build(rows: np.ndarray) -> Node | int:
        chosen = []
        if len(rows) > leaf:
            chosen, d = [0], distances(rows, rows[:1])[:, 0]
            while len(chosen) < SPLITS and d.max() > SLACK * np.sqrt(max(length, 1.0)):
                chosen.append(int(d.argmax()))
                d = np.minimum(d, distances(rows, rows[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            tree.leaves += 1
            return tree.leaves - 1
        node = Node(tree.nodes, rows[chosen])
        tree.nodes += 1
        child = distances(rows, node.points).argmin(1)
        node.children = [build(rows[child == j]) for j in range(len(chosen))]
        return node

    tree.root = build(tree.lifted(sample))
    return tree


def prepared(embeddings: DataFrame, *, relabel: int = 7, labels: int = 10) -> DataFrame:
    """``id, label, v``: rows with a label, an id and a vector of finite components, these
    as whole numbers of 1/256; where the id is divisible by ``relabel`` the next label."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = e.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    label = F.when(F.col("id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return kept.select("id", label.alias("label"), F.transform("v", lambda x: F.floor(256 * x).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of one width; missing components are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = column.flatten().to_numpy()
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where no sum reaches 2**53."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 2**53:
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return anchors @ rows.T


def _first(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best allowed entries of each row; columns are in order of
    their ids, so that of equal scores the smaller id comes first."""
    least = np.iinfo(np.int64).min
    masked = np.where(allowed, score, least)
    if score.shape[1] > k:
        bound = np.partition(masked, score.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (masked >= bound[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class Index:
    """All rows by leaf and part, and the tree whose ranges hold for all of them."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.rows = written(rows.dropDuplicates(["id", "label", "v"]), "vectors")
        n, width, longest, anchors = self.rows.agg(
            F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.count_if(F.col("id") % 50 == 0)
        ).first()
        self.width, self.anchors = max(width or 1, 1), anchors
        sample = _matrix(self.rows.orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE).select("v").toArrow().column("v"), self.width)
        self.tree = grow(sample.astype(float), longest or 0.0, max(8, PART * len(sample) // max(n, 1)))
        self.leaf_rows = self._measure()
        self.parts = np.maximum(1, -(-self.leaf_rows // PART))
        self.chunks = written(self._parts(), "leaves")
        small_batches(spark, 4096)

    def _measure(self) -> np.ndarray:
        """The ranges over all rows, one partial result a task, and the rows of each leaf."""
        tree, width = self.tree, self.width
        cells = tree.nodes * SPLITS * SPLITS

        def run(batches):
            low, high = np.full((tree.nodes, SPLITS, SPLITS), np.inf), np.full((tree.nodes, SPLITS, SPLITS), -np.inf)
            count = np.zeros(tree.leaves, np.int64)

            def seen(node, rows, child, d):
                for j in np.unique(child):
                    own = d[child == j]
                    n = own.shape[1]
                    low[node.number, :n, j] = np.minimum(low[node.number, :n, j], own.min(0))
                    high[node.number, :n, j] = np.maximum(high[node.number, :n, j], own.max(0))

            for batch in batches:
                if batch.num_rows:
                    count += np.bincount(tree.descend(tree.lifted(_matrix(batch.column(0), width).astype(float)), seen), minlength=tree.leaves)
            cell, leaf = np.flatnonzero(np.isfinite(low.ravel())), np.flatnonzero(count)
            none = pa.nulls(len(leaf), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([cell, leaf + cells])),
                    pa.concat_arrays([pa.array(low.ravel()[cell]), none]),
                    pa.concat_arrays([pa.array(high.ravel()[cell]), none]),
                    pa.array(np.concatenate([np.zeros(len(cell), np.int64), count[leaf]])),
                ],
                names=["cell", "low", "high", "n"],
            )

        # a row for each range and leaf of the tree, whose size the sample bounds
        found = self.rows.select("v").mapInArrow(run, "cell long, low double, high double, n long").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()
        cell, low, high, n = (found.column(c).to_numpy() for c in ("cell", "low", "high", "n"))
        tree.low, tree.high = np.full(cells, np.inf), np.full(cells, -np.inf)
        at = cell < cells
        tree.low[cell[at]], tree.high[cell[at]] = low[at], high[at]
        tree.low, tree.high = (x.reshape(tree.nodes, SPLITS, SPLITS) for x in (tree.low, tree.high))
        count = np.zeros(tree.leaves, np.int64)
        count[cell[~at] - cells] = n[~at]
        return count

    def _parts(self) -> DataFrame:
        """Every leaf in parts: ids in order, labels and vectors of a part as one row."""
        tree, width, parts = self.tree, self.width, self.parts
        first = np.cumsum(parts) - parts

        def place(batches):
            for batch in batches:
                leaf = tree.descend(tree.lifted(_matrix(batch.column(2), width).astype(float)))
                part = first[leaf] + batch.column(3).to_numpy() % parts[leaf]
                yield pa.RecordBatch.from_arrays([pa.array(part), *(batch.column(i) for i in range(3))], names=["part", "id", "label", "v"])

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by([("id", "ascending"), ("label", "ascending")])
            ids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
            v = _matrix(t.column("v"), width)
            return pa.table({"part": t.column("part")[:1], "ids": pa.array([ids.tobytes()]), "labels": pa.array([labels.tobytes()]), "vectors": pa.array([_packed(v)])})

        placed = self.rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("id"), 1)).select("id", "label", "v", "hash").mapInArrow(place, "part long, id long, label long, v array<bigint>")
        return placed.groupBy("part").applyInArrow(pack, "part long, ids binary, labels binary, vectors binary")

    def compare(self, anchors: DataFrame, compared, schema: str, *, home: bool = False) -> DataFrame:
        """Runs ``compared(anchors, ids, labels, vectors)`` for each block of anchors and each
        part of the leaves that survive for them. ``anchors`` has ``id, label, v`` and ``low, high``, the
        least and greatest inner product that is wanted; with ``home`` only an anchor's own leaf."""
        tree, width, parts = self.tree, self.width, self.parts
        first = np.cumsum(parts) - parts
        blocks = -(-max(self.anchors, 1) // BLOCK)

        def visits(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("v"), width).astype(float)
                if home:
                    leaf = tree.descend(tree.lifted(x))
                    found = [(int(k), np.flatnonzero(leaf == k)) for k in np.unique(leaf)]
                else:
                    low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
                    base = tree.length + (x * x).sum(1)
                    near, far = (np.sqrt(np.maximum(base - 2 * s, 0)) for s in (high, low))
                    found = tree.survivors(x, near, far)
                for leaf, rows in found:
                    if parts[leaf] and self_rows[leaf]:
                        own = np.arange(first[leaf], first[leaf] + parts[leaf])
                        out = batch.take(pa.array(np.repeat(rows, len(own))))
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(own, len(rows))), *out.columns], names=["part", *batch.schema.names])

        self_rows = self.leaf_rows
        cut = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        kinds = ", ".join(f"{c} {t}" for c, t in cut.dtypes)
        dealt = cut.mapInArrow(visits, f"part long, {kinds}")
        held = self.chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        names = [c.split()[0] for c in schema.split(", ")]

        def run(some: pa.Table, part: pa.Table) -> pa.Table:
            if not some.num_rows or not part.num_rows:
                return pa.table({n: pa.array([], pa.int64()) for n in names})
            ids, labels = (np.frombuffer(part.column(c)[0].as_py(), np.int64) for c in ("ids", "labels"))
            return compared(some, _matrix(some.column("v"), width), ids, labels, _unpacked(part.column("vectors")[0].as_py(), len(ids), width))

        return dealt.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(run, schema)


def _packed(v: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where they fit, in eight elsewhere."""
    return v.astype(np.int16 if np.abs(v).max(initial=0) < 1 << 15 else np.int64).tobytes()


def _unpacked(blob: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.int16 if len(blob) == 2 * rows * width else np.int64).reshape(rows, width).astype(np.int64)


def _same(k: int):
    """The ``k`` best rows of the anchor's own label."""

    def compared(some, vectors, ids, labels, rows):
        own, label = (some.column(c).to_numpy() for c in ("id", "label"))
        score = _scores(vectors, rows)
        least = some.column("low").to_numpy()
        row, column = _first(score, (label[:, None] == labels) & (own[:, None] != ids) & (score >= least[:, None]), k)
        return pa.table({"anchor": own[row], "other": ids[column], "score": score[row, column]})

    return compared


def _other(k: int, least: int, most: int):
    """Of every positive's window the ``k`` best rows of another label."""

    def compared(some, vectors, ids, labels, rows):
        own, label = (some.column(c).to_numpy() for c in ("id", "label"))
        score = _scores(vectors, rows)
        differs = label[:, None] != labels
        positives, scores = (some.column(c).combine_chunks() for c in ("positives", "scores"))
        sizes = np.diff(scores.offsets.to_numpy())
        start = np.cumsum(sizes) - sizes
        flat, names = scores.flatten().to_numpy(), positives.flatten().to_numpy()
        out = []
        for p in range(int(sizes.max(initial=0))):
            rows_p = np.flatnonzero(sizes > p)
            at = start[rows_p] + p
            s, mine = flat[at], score[rows_p]
            row, column = _first(mine, differs[rows_p] & (100 * mine >= least * s[:, None]) & (100 * mine <= most * s[:, None]), k)
            out.append((own[rows_p][row], names[at][row], s[row], ids[column], mine[row, column]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(("anchor", "positive", "positive_score", "other", "score"), columns, strict=True)))

    return compared


def mine(embeddings: DataFrame, *, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its ``positives`` best rows of
    the same label, the ``negatives`` best rows of another label whose score is from ``least``
    to ``most`` hundredths of the positive's. Scores are exact inner products of whole numbers;
    ties go to the smaller id.

    Rows that repeat another whole row count once; rows that share an id but differ are rows
    of their own and never serve each other. A null id, label, vector or component, and one
    that isn't finite, takes a row out; vectors of different lengths are compared as if filled
    with zeros. Other columns are ignored. An empty table, or one without anchors, gives an
    empty result, as does a positive score below 0, whose window is empty.
    """
    small_batches(embeddings.sparkSession, 4096)
    index = Index(prepared(embeddings))
    lowest, highest = float(-(2**62)), float(2**62)
    anchors = index.rows.filter(F.col("id") % every == 0)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    found = "anchor long, other long, score long"

    def top(seen: DataFrame) -> DataFrame:
        return seen.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)

    start = anchors.select("id", "label", "v", F.lit(lowest).alias("low"), F.lit(highest).alias("high"))
    near = top(index.compare(start, _same(positives), found, home=True))
    bound = near.filter(F.col("place") == positives).select(F.col("anchor").alias("of"), F.col("score").cast("double").alias("low"))
    wide = anchors.join(bound, F.col("id") == F.col("of"), "left").select("id", "label", "v", F.coalesce("low", F.lit(lowest)).alias("low"), F.lit(highest).alias("high"))
    kept = written(top(index.compare(wide, _same(positives), found)), "positives")
    windows = kept.filter(F.col("score") >= 0).groupBy(F.col("anchor").alias("of")).agg(
        F.collect_list(F.struct("other", "score")).alias("p"), F.floor(F.min("score") * least / 100.0).cast("double").alias("low"), F.ceil(F.max("score") * most / 100.0).cast("double").alias("high")
    )
    asked = anchors.join(windows, F.col("id") == F.col("of")).select("id", "label", "v", "low", "high", F.col("p.other").alias("positives"), F.col("p.score").alias("scores"))
    seen = index.compare(asked, _other(negatives, least, most), "anchor long, positive long, positive_score long, other long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other"))
    return (
        seen.withColumn("rank", rank)
        .filter(F.col("rank") <= negatives)
        .select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
