"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from atrisk.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    """Rows with their columns by name, in a common order, numbers to nine digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    number = lambda v: float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else v
    return sorted(names), sorted((tuple(number(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF)
    got = plain([tuple(r) for r in ours.collect()], ours.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    assert got == plain(cursor.fetchall(), [d[0] for d in cursor.description])
