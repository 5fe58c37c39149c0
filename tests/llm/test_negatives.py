"""Hard negatives against plain comparison of all rows."""

import random

import duckdb
import pytest

pytest.importorskip("atrisk.llm")

import numpy as np  # noqa: E402

from atrisk.llm import negatives, queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, score string, part int"


def brute(rows):
    kept = []
    for i, v, label in {(i, tuple(v) if v is not None else None, label) for i, v, label in rows}:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.float32(v).astype(float)).astype(int)))
    out = []
    for a, label, v in kept:
        if a % 50:
            continue
        width = lambda x, y: min(len(x), len(y))
        scored = sorted((-int(v[: width(v, w)] @ w[: width(v, w)]), i, lab == label) for i, lab, w in kept if i != a)
        for s, i, same in [x for x in scored if x[2]][:5]:
            fits = [(n, -t) for t, n, other in scored if not other and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, i, k + 1, n, -s, t) for k, (n, t) in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*(c.split()[0] for c in negatives.RESULT.split(", "))).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize("block", [1024, 3])
def test_clusters_ties_and_odd_rows_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "PART", 16)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = random.Random(block)
    centres = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(12)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(centres)], rng.randrange(10)) for i in range(-300, 600)]
    same = [0.5] * 8
    rows += [(1000 + i, same, i % 2) for i in range(120)]  # one vector many times
    rows += [(2000, None, 1), (2050, [float("nan")] * 8, 1), (2100, [None] + [0.1] * 7, 1), (2150, [float("inf")] * 8, 2), (2200, same, None), (None, same, 1)]
    rows += [(2250, [0.25, 0.5], 3), (2251, [], 3), (2300, [0.0] * 8, 4)]
    assert got(negatives.mine(frame(spark, rows + rows[:40]))) == brute(rows)


def test_few_rows_of_a_label_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [0.9, 0.1], 1), (51, [0.7, 0.1], 2)]
    assert got(negatives.mine(frame(spark, rows))) == brute(rows)
    assert got(negatives.mine(frame(spark, []))) == []
    assert got(negatives.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]))) == []


def test_very_large_components_stay_exact():
    x = np.array([[2**30, 3], [2**29, -7]])
    assert (negatives._scores(x, x) == np.array([[2**60 + 9, 2**59 - 21], [2**59 - 21, 2**58 + 49]])).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
    want = sorted(con.execute(negatives.ORACLE).fetchall())
    assert want and got(queries.queries()["op12_hard_negatives"](spark, f"/root/testdata/{sf}")) == want


def test_siblings_are_eliminated_and_no_row_is_lost():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 100, (20, 6))
    x = np.floor(np.repeat(centres, 50, 0) + rng.normal(0, 2, (1000, 6)))
    length = float((x * x).sum(1).max())
    tree = negatives.grow(x, length, 60)
    tree.low, tree.high = np.full((tree.nodes, 8, 8), np.inf), np.full((tree.nodes, 8, 8), -np.inf)

    def seen(node, rows, child, d):
        for j in range(d.shape[1]):
            if (child == j).any():
                tree.low[node.number, : d.shape[1], j] = d[child == j].min(0)
                tree.high[node.number, : d.shape[1], j] = d[child == j].max(0)

    leaf = tree.descend(tree.lifted(x), seen)
    anchors = x[::100]
    score = anchors @ x.T
    hi = score.max(1) * 0.9
    lo = hi * 0.8
    base = length + (anchors**2).sum(1)
    visited = {(k, int(r)) for k, rows in tree.survivors(anchors, np.sqrt(np.maximum(base - 2 * hi, 0)), np.sqrt(np.maximum(base - 2 * lo, 0))) for r in rows}
    needed = {(int(leaf[j]), i) for i, j in zip(*np.nonzero((score >= lo[:, None]) & (score <= hi[:, None])), strict=True)}
    assert needed <= visited and len(visited) < 0.7 * len(anchors) * tree.leaves
