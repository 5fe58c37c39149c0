"""Registered queries over perimeters held as a table, and over footprints, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrisk.functions import value
from atrisk.operators import exposure, overlap, perimeters
from atrisk.operators.shared import dealt
from atrisk.plans.exposure_queries import _SCORED, _rounded
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx

# The rings of every derived perimeter in its radius: band, ring, points.
RINGS = [
    (0, 0, [(0.5, 0.0), (0.25, 0.44), (-0.25, 0.44), (-0.5, 0.0), (-0.25, -0.44), (0.25, -0.44)]),
    (1, 0, [(1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0), (1.0, -1.0)]),
    (1, 1, [(0.9, 0.9), (0.6, 0.9), (0.6, 0.6), (0.9, 0.6)]),
]


def derived(parts: DataFrame, versions: bool = False) -> DataFrame:
    """A perimeter of two bands for each part; every third has a second version further east."""
    k = F.col("p_partkey")
    x, y = (k * 37 % 997) / F.lit(997.0) * 0.8 + 1.5, (k * 61 % 991) / F.lit(991.0) * 0.8 + 41.2
    base = parts.select(k.alias("perimeter_id"), x.alias("x"), y.alias("y"), ((k % 5) * 0.004 + 0.01).alias("r"))
    if versions:
        many = F.when(F.col("perimeter_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        base = base.select("*", F.explode(many).alias("version")).withColumn("x", F.col("x") + (F.col("version") - 1) * 0.01)
    point = lambda p: F.struct((F.col("x") + F.col("r") * p[0]).alias("x"), (F.col("y") + F.col("r") * p[1]).alias("y"))
    rings = F.array(*(F.struct(F.lit(b).alias("band_index"), F.lit(0).alias("part"), F.lit(r).alias("ring"), F.array(*map(point, points)).alias("points")) for b, r, points in RINGS))
    return base.select("perimeter_id", *(["version"] if versions else []), F.inline(rings))


def valued(spark, sf_dir) -> DataFrame:
    return exposure.with_class(fx.assets(spark, sf_dir)).withColumns(value.valuation()).withColumns(value.occupancy())


def _many(moved: str) -> str:
    rows = ", ".join(f"({b}, {r}, {p[0]}::double, {p[1]}::double, {q[0]}::double, {q[1]}::double)" for b, r, points in RINGS for p, q in zip(points, points[1:] + points[:1], strict=True))
    return f"""with {_SCORED}, e as (select * from (values {rows}) e(band, ring, dx1, dy1, dx2, dy2)),
p as (select k, x + {moved} as x, y, r from (select p_partkey as k, (p_partkey * 37 % 997) / 997.0::double * 0.8::double + 1.5::double as x, (p_partkey * 61 % 991) / 991.0::double * 0.8::double + 41.2::double as y, (p_partkey % 5) * 0.004::double + 0.01::double as r from part)),
c as (select id, lon, lat, k, band, ring, x + r * dx1 as x1, y + r * dy1 as y1, x + r * dx2 as x2, y + r * dy2 as y2 from scored join p on lon between x - r and x + r and lat between y - r and y + r cross join e),
odd as (select id, k, band, ring from c where (y2 > lat) <> (y1 > lat) and lon < (lat - y2) * (x1 - x2) / (y1 - y2) + x2 group by all having count(*) % 2 = 1),
first as (select id, k, min(band) as band from (select id, k, band from odd group by all having max(ring) = 0) group by 1, 2)
select k as perimeter_id, band as band_index, count(*) as assets, sum(people) as people, round(sum(total_eur), 0) as value_eur from first join scored using (id) group by 1, 2"""


@query("j1_many_perimeters", _many("0.0::double"))
def j1_many(spark, sf_dir):
    return _rounded(perimeters.exposed(valued(spark, sf_dir), derived(fx.read(spark, sf_dir, "part"))), value_eur=0)


@query("x4_evolving_perimeters", _many("case when k % 3 = 0 then 0.01::double else 0.0::double end"))
def x4(spark, sf_dir):
    path = f"{sf_dir}/part*.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return _rounded(perimeters.evolving(derived(stream, versions=True), valued(spark, sf_dir)), value_eur=0)


# The corners of every derived footprint in its half width.
CORNERS = [(1.0, 0.3), (-0.3, 1.0), (-1.0, -0.3), (0.3, -1.0)]


def footprints(spark, sf_dir) -> DataFrame:
    """Assets of which two in three have a square footprint that stands askew."""
    half = (F.col("source_ref") % 7) * 0.004 + 0.002
    ring = F.array(*(F.struct((F.col("lon") + half * x).alias("x"), (F.col("lat") + half * y).alias("y")) for x, y in CORNERS))
    return fx.assets(spark, sf_dir).select("id", "lon", "lat", F.when(F.col("source_ref") % 3 != 0, F.array(ring)).alias("rings"))


_CORNERS = ", ".join(f"({i}, {p[0]}::double, {p[1]}::double, {q[0]}::double, {q[1]}::double)" for i, (p, q) in enumerate(zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)))
_FOOTPRINTS = f"""a as (select id, lon, lat, source_ref % 3 <> 0 as shaped, (source_ref % 7) * 0.004::double + 0.002::double as h from {fx.ASSETS_SQL}),
s as (select id, lon, lat, i, lon + h * dx1 as ax, lat + h * dy1 as ay, lon + h * dx2 as cx, lat + h * dy2 as cy from a join (values {_CORNERS}) c(i, dx1, dy1, dx2, dy2) on shaped)"""


# Edges cross where each parts the other's ends; a footprint's corner in a band, or a band's in
# the footprint (on the left of all its edges), tells of the rest.
@query(
    "f2_footprints",
    f"""with {_FOOTPRINTS}, e as (select * from {fx.edges_sql()}),
q as (select id, ax as x, ay as y, true as shaped from s union all select id, lon, lat, false from a where not shaped),
inside as (select distinct id from (select id, x, y, band, part from q join e on (y2 > y) <> (y1 > y) and x < (y - y2) * (x1 - x2) / (y1 - y2) + x2 group by id, x, y, band, part, ring having count(*) % 2 = 1) group by id, x, y, band, part having count(*) = 1),
crossing as (select distinct id from s join e on ((cx - ax) * (y1 - ay) - (cy - ay) * (x1 - ax)) * ((cx - ax) * (y2 - ay) - (cy - ay) * (x2 - ax)) <= 0 and ((x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1)) * ((x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1)) <= 0),
around as (select distinct id from (select id, x1, y1 from s join e on true group by id, x1, y1 having min((cx - ax) * (y1 - ay) - (cy - ay) * (x1 - ax)) > 0))
select id from inside union select id from crossing union select id from around""",
)
def f2_footprints(spark, sf_dir):
    return overlap.in_perimeter(footprints(spark, sf_dir), [p for *_, polygons in fx.BANDS for p in polygons]).select("id")


# Two convex shapes are apart exactly where a line along one of their edges parts them.
@query(
    "j11_shape_tiles",
    f"""with {_FOOTPRINTS}, b as (select id, min(ax) as x0, max(ax) as x1, min(ay) as y0, max(ay) as y1 from s group by 1),
t as (select id, ix, unnest(range(floor(y0 / 0.05::double)::bigint, floor(y1 / 0.05::double)::bigint + 1)) as iy from (select *, unnest(range(floor(x0 / 0.05::double)::bigint, floor(x1 / 0.05::double)::bigint + 1)) as ix from b)),
apart as (select distinct t.id, ix, iy from t join s on s.id = t.id where
  greatest((cx - ax) * (iy * 0.05::double - ay) - (cy - ay) * (ix * 0.05::double - ax), (cx - ax) * (iy * 0.05::double - ay) - (cy - ay) * ((ix + 1) * 0.05::double - ax), (cx - ax) * ((iy + 1) * 0.05::double - ay) - (cy - ay) * (ix * 0.05::double - ax), (cx - ax) * ((iy + 1) * 0.05::double - ay) - (cy - ay) * ((ix + 1) * 0.05::double - ax)) < 0)
select '0.05/' || ix || '/' || iy as tile_key, count(*) as shapes from t anti join apart using (id, ix, iy) group by 1""",
)
def j11_shapes(spark, sf_dir):
    return overlap.tiles(footprints(spark, sf_dir)).groupBy("tile_key").agg(F.count("*").alias("shapes"))


@query(
    "v16_ring_repair",
    f"select id, round(case when k % 3 = 0 then 1.09::double else 2.18::double end * h * h * 1e6, 4) as area, case when k % 3 = 0 and k % 2 = 0 then 'not closed, crosses itself' when k % 3 = 0 then 'crosses itself' when k % 2 = 0 then 'not closed' end as note from (select id, source_ref as k, (source_ref % 7) * 0.004::double + 0.002::double as h from {fx.ASSETS_SQL})",
)
def v16_repair(spark, sf_dir):
    """Squares that stand askew; of every third one two corners change places, so that it is a
    bow tie of half the area; every second one is left open."""
    half = (F.col("source_ref") % 7) * 0.004 + 0.002
    at = lambda i: F.struct((F.col("lon") + half * CORNERS[i][0]).alias("x"), (F.col("lat") + half * CORNERS[i][1]).alias("y"))
    ring = F.when(F.col("source_ref") % 3 == 0, F.array(*map(at, (0, 2, 1, 3)))).otherwise(F.array(*map(at, range(4))))
    closed = F.when(F.col("source_ref") % 2 == 0, ring).otherwise(F.concat(ring, F.array(at(0))))
    return dealt(fx.assets(spark, sf_dir).select("id", "source_ref", "lon", "lat"), "id").select("id", closed.alias("r")).select("id", F.round(overlap.even_odd_area(F.col("r")) * 1e6, 4).alias("area"), overlap.ring_note(F.col("r")).alias("note"))
