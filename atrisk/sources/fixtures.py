"""Assets, perimeters, tile ledger and runs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrisk.functions import taxonomy

# Sources with their merge priority.
SOURCES = {"es.msan.hospitales": 100, "es.cat.schools": 95, "es.cat.livestock": 92, "es.cat.reses": 88, "es.msan.siap": 86, "es.csic.carehomes": 82, "es.meq.schools": 80, "es.cat.equipaments": 78, "es.ine.popgrid": 70, "osm": 50, "es.cat.munipoints": 5}
PROVINCES = ["barcelona", "girona", "tarragona", "lleida", "teruel"]

#: Bands in order of arrival: label, minutes, polygons (outer ring, holes).
BANDS = [
    ("1h", 60.0, [[[(1.98, 41.6), (1.969, 41.64), (1.94, 41.669), (1.9, 41.68), (1.86, 41.669), (1.831, 41.64), (1.82, 41.6), (1.831, 41.56), (1.86, 41.531), (1.9, 41.52), (1.94, 41.531), (1.969, 41.56)]]]),
    ("3h", 180.0, [[[(1.72, 41.43), (2.07, 41.45), (2.1, 41.77), (1.74, 41.78)], [(1.76, 41.7), (1.8, 41.7), (1.8, 41.75), (1.76, 41.75)]]]),
    ("6h", 360.0, [[[(1.62, 41.35), (2.2, 41.37), (2.18, 41.86), (1.63, 41.85)]], [[(2.22, 41.9), (2.29, 41.9), (2.29, 41.98), (2.22, 41.98)]]]),
]
AS_OF = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("k"), len(taxonomy.rows())
    name = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    cap = F.floor(F.abs(F.col("c_acctbal")) / 10)
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_nationkey", "c_acctbal")
    dim = F.broadcast(taxonomy.taxonomy(spark).select("row_no", "subcategory", "category"))
    out = base.join(dim, k % n == F.col("row_no")).select(
        F.concat(F.lit("a"), k.cast("string")).alias("id"),
        k.alias("source_ref"),
        name(SOURCES, k % len(SOURCES)).alias("source_id"),
        F.col("c_name").alias("name"),
        "subcategory",
        "category",
        (((k * 7919) % 10007) / F.lit(10007.0) * 0.8 + 1.5).alias("lon"),
        (((k * 104729) % 10009) / F.lit(10009.0) * 0.8 + 41.2).alias("lat"),
        F.when(k % 12 == 0, "footprint").otherwise("point").alias("geometry_kind"),
        F.when(k % 3 == 0, (k % 4000 + 100).cast("double")).alias("footprint_m2"),
        F.when(k % 4 == 0, (k % 5 + 1).cast("double")).alias("floors"),
        name(PROVINCES, F.col("c_nationkey") % 5).alias("province"),
        *(F.when(k % 5 == i, cap.cast("double")).alias(f"cap_{c}") for i, c in enumerate(("people", "beds", "students", "places"))),
        F.when(k % 7 == 0, (k % 90).cast("double")).alias("livestock_units"),
        F.when(k % 2 == 0, (k % 600).cast("double")).alias("animals"),
        ((k % 5).cast("double") * 0.08 + 0.5).alias("confidence"),
    )
    return out


def twice_registered(assets: DataFrame) -> DataFrame:
    """Assets with ``doc_id``, of which every third is in another source too, some 20 m off,
    with its name in capitals and without most figures."""
    k = F.col("source_ref")
    own = assets.withColumn("doc_id", k)
    other = own.filter(k % 3 == 0).withColumns({"doc_id": -k, "id": F.concat(F.lit("b"), k.cast("string")), "source_id": F.when(F.col("source_id") == "osm", "es.cat.equipaments").otherwise("osm"), "name": F.concat(F.upper("name"), F.lit(", S.L.")), "lon": F.col("lon") + 0.0002})
    return own.unionByName(other.withColumns({c: F.lit(None).cast("double") for c in ("footprint_m2", "cap_people", "livestock_units")}))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ASSETS_SQL = f"""(select 'a' || c_custkey as id, c_custkey as source_ref, {_list(SOURCES)}[c_custkey % {len(SOURCES)} + 1] as source_id, c_name as name, t.subcategory, t.category,
  ((c_custkey * 7919) % 10007) / 10007.0::double * 0.8::double + 1.5::double as lon, ((c_custkey * 104729) % 10009) / 10009.0::double * 0.8::double + 41.2::double as lat,
  case when c_custkey % 12 = 0 then 'footprint' else 'point' end as geometry_kind, case when c_custkey % 3 = 0 then (c_custkey % 4000 + 100)::double end as footprint_m2,
  case when c_custkey % 4 = 0 then (c_custkey % 5 + 1)::double end as floors, {_list(PROVINCES)}[c_nationkey % 5 + 1] as province,
  case when c_custkey % 5 = 0 then floor(abs(c_acctbal) / 10) end as cap_people, case when c_custkey % 5 = 1 then floor(abs(c_acctbal) / 10) end as cap_beds,
  case when c_custkey % 5 = 2 then floor(abs(c_acctbal) / 10) end as cap_students, case when c_custkey % 5 = 3 then floor(abs(c_acctbal) / 10) end as cap_places,
  case when c_custkey % 7 = 0 then (c_custkey % 90)::double end as livestock_units, case when c_custkey % 2 = 0 then (c_custkey % 600)::double end as animals,
  (c_custkey % 5)::double * 0.08::double + 0.5::double as confidence
from customer join {taxonomy.oracle()} t on c_custkey % {len(taxonomy.rows())} = t.row_no)"""


def edges_sql() -> str:
    """Every edge of every band as values, for the oracle."""
    from atrisk.functions.geom import edges

    rows = [f"({b}, {minutes}::double, {p}, {r}, {', '.join(f'{v}::double' for v in e)})" for b, (_, minutes, polygons) in enumerate(BANDS) for p, polygon in enumerate(polygons) for r, ring in enumerate(polygon) for e in edges(ring)]
    return f"(select * from (values {', '.join(rows)}) e(band, minutes, part, ring, x1, y1, x2, y2))"


def tile_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_rows(read(spark, sf_dir, "events"))


def ledger_rows(e: DataFrame) -> DataFrame:
    """Fetch outcomes from events, of a table or a stream."""
    key = F.concat(F.lit("0.05/"), (F.col("user_id") % 16 + 30).cast("string"), F.lit("/"), (F.floor(F.col("user_id") / 16) + 824).cast("string"))
    return e.select(key.alias("tile_key"), F.col("ts").alias("fetched_at"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), "event_id")


LEDGER_SQL = "(select '0.05/' || (user_id % 16 + 30) || '/' || (floor(user_id / 16)::bigint + 824) as tile_key, ts as fetched_at, case when event_type = 'error' then 'error' else 'ok' end as status, event_id from events)"


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    name = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("user_id") % len(SOURCES) + 1).cast("int"))
    return e.select(F.col("event_id").alias("run_id"), name.alias("source_id"), F.col("ts").alias("finished_at"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "partial").otherwise("ok").alias("status"))


RUNS_SQL = f"(select event_id as run_id, {_list(SOURCES)}[user_id % {len(SOURCES)} + 1] as source_id, ts as finished_at, case when event_type = 'error' then 'error' when event_type = 'view' then 'partial' else 'ok' end as status from events)"


def pop_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = F.col("o_custkey") % 80, F.col("o_orderkey") % 80
    cells = read(spark, sf_dir, "orders").groupBy(i.alias("i"), j.alias("j")).agg((F.count("*") * 10.0).alias("population"))
    return cells.select(F.concat_ws("-", "i", "j").alias("cell_id"), (F.col("i") * 0.01 + 1.5).alias("x0"), (F.col("j") * 0.01 + 41.2).alias("y0"), F.lit(0.01).alias("size"), "population")


GRID_SQL = "(select i || '-' || j as cell_id, i * 0.01::double + 1.5::double as x0, j * 0.01::double + 41.2::double as y0, n * 10.0::double as population from (select o_custkey % 80 as i, o_orderkey % 80 as j, count(*) as n from orders group by 1, 2))"
