"""Registered queries of overlays, circles, rate decisions and resumable ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrisk.functions import geom, grids
from atrisk.operators import clip, store
from atrisk.plans.exposure_queries import _rounded
from atrisk.plans.registry import query
from atrisk.plans.report_queries import _SEGMENTS, _ways
from atrisk.sources import fixtures as fx
from atrisk.streaming import usage

BANDS = fx.BANDS

# A square's part of a ring, edge by edge: below, within and beyond its range of x.
_SHARES = f"""e as (select *, x1 + (u - y1) * (x2 - x1) / (y2 - y1) as p, x1 + (v - y1) * (x2 - x1) / (y2 - y1) as q from (
    select *, greatest(least(y1, y2), cy) as u, least(greatest(y1, y2), cy + 0.01::double) as v from (select cell_id, population, x0 as cx, y0 as cy from {fx.GRID_SQL}), {fx.edges_sql()} where y1 <> y2) where v > u),
m as (select *, least(p, q) as a, greatest(p, q) as b, cx + 0.01::double as dx from e),
h as (select *, least(greatest(a, cx), dx) as l, least(greatest(b, cx), dx) as r from m),
rings as (select cell_id, population, band, part, ring, abs(sum(sign(y2 - y1) * (v - u) * case when b > a then ((r - l) * ((l + r) / 2 - cx) + greatest(0, b - greatest(a, dx)) * 0.01::double) / (b - a) else l - cx end)) as area from h group by all),
shares as (select cell_id, population, band as band_index, least(1.0::double, sum(case when ring = 0 then area else -area end) / (0.01::double * 0.01::double)) as share from rings group by all)"""


@query("j8_population_overlay", f"with {_SHARES} select cell_id, band_index, round(share, 6) as share from shares where share > 1e-12")
def j8(spark, sf_dir):
    return _rounded(clip.cells_in_bands(fx.pop_grid(spark, sf_dir), BANDS).select("cell_id", "band_index", "share"), share=6)


# The bands hold one another, so what a band adds is its share less that of the band before.
_ADDED = f"{_SHARES}, added as (select b.cell_id, b.population, b.band_index, b.share - coalesce(a.share, 0) as share from shares b left join shares a on a.cell_id = b.cell_id and a.band_index = b.band_index - 1)"


@query("j8_exclusive_overlay", f"with {_ADDED} select cell_id, band_index, round(share, 6) as share from added where share > 1e-7")
def j8_exclusive(spark, sf_dir):
    out = clip.exclusive_shares(fx.pop_grid(spark, sf_dir), BANDS).filter("share > 1e-7")
    return _rounded(out.select("cell_id", "band_index", "share"), share=6)


@query("a7_exact_population", f"with {_ADDED} select band_index, count(*) as cells, round(sum(population * share), 3) as population from added where share > 1e-7 group by 1")
def a7_exact(spark, sf_dir):
    """Each band's people, of ground that no earlier band holds."""
    out = clip.exclusive_shares(fx.pop_grid(spark, sf_dir), BANDS).filter("share > 1e-7")
    return _rounded(out.groupBy("band_index").agg(F.count("*").alias("cells"), F.sum(F.col("population") * F.col("share")).alias("population")), population=3)


_CLIPPED = f"""s as (select id, kind, seq, x as ax, y as ay, x2 as bx, y2 as cy from {_SEGMENTS} where x2 is not null),
e as (select * from {fx.edges_sql()} where band = 1),
c as (select id, seq, t from (select id, seq, ((x1 - ax) * (y2 - y1) - (y1 - ay) * (x2 - x1)) / d as t, ((x1 - ax) * (cy - ay) - (y1 - ay) * (bx - ax)) / d as w
  from (select *, (bx - ax) * (y2 - y1) - (cy - ay) * (x2 - x1) as d from s, e) where d <> 0) where t > 0 and t < 1 and w between 0 and 1),
p as (select id, seq, 0.0::double as t from s union all select id, seq, 1.0::double from s union all select id, seq, t from c),
i as (select * from (select id, seq, t as t0, lead(t) over (partition by id, seq order by t) as t1 from p) where t1 > t0),
m as (select i.*, kind, ax, ay, bx, cy, ax + (bx - ax) * ((t0 + t1) / 2) as lon, ay + (cy - ay) * ((t0 + t1) / 2) as lat from i join s using (id, seq)),
r as (select id, seq, t0, t1, part, ring, sum(case when ((y2 > lat) <> (y1 > lat)) and lon < (lat - y2) * (x1 - x2) / (y1 - y2) + x2 then 1 else 0 end) % 2 as odd from m, e group by all),
k as (select distinct id, seq, t0, t1 from (select id, seq, t0, t1, part from r group by all having bool_or(ring = 0 and odd = 1) and not bool_or(ring > 0 and odd = 1))),
l as (select id, kind, ax + (bx - ax) * t0 as x, ay + (cy - ay) * t0 as y, ax + (bx - ax) * t1 as x2, ay + (cy - ay) * t1 as y2 from m join k using (id, seq, t0, t1))"""
_METRES = "2 * 6371008.8::double * asin(sqrt(pow(sin(radians(y2 - y) / 2), 2) + cos(radians(y)) * cos(radians(y2)) * pow(sin(radians(x2 - x) / 2), 2)))"


@query("j10_network_clip", f"with {_CLIPPED} select id, kind, round(sum({_METRES}), 3) as metres from l group by 1, 2")
def j10(spark, sf_dir):
    return _rounded(clip.clipped_lines(_ways(spark, sf_dir), BANDS[1][2]), metres=3)


@query("v14_circles", "with s as (select s_suppkey as id, 1.5::double + (s_suppkey % 800) * 0.001::double as lon, 41.2::double + (s_suppkey % 700) * 0.001::double as lat, (s_suppkey % 250)::double as km from supplier), c as (select id, km, unnest(range(48)) as i, lon, lat, km * 1000 / 111320.0::double as up, km * 1000 / 111320.0::double / cos(radians(lat)) as across from s where km > 0 and km <= 200) select id, count(*)::int as points, round(max(lon + across * cos(i * (2 * pi() / 48))), 8) as max_x, round(max(lat + up * sin(i * (2 * pi() / 48))), 8) as max_y from c group by 1 union all select id, null, null, null from s where not (km > 0 and km <= 200)")
def v14(spark, sf_dir):
    k = F.col("s_suppkey")
    ring = geom.circle((k % 800) * F.lit(0.001) + 1.5, (k % 700) * F.lit(0.001) + 41.2, (k % 250).cast("double"))
    rows = fx.read(spark, sf_dir, "supplier").select(k.alias("id"), ring.alias("ring"))
    most = lambda c: F.round(F.array_max(F.transform("ring", lambda p: p[c])), 8)
    return rows.select("id", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("points"), most("x").alias("max_x"), most("y").alias("max_y"))


# Each decision depends on all before it; a test holds this against brute force.
@query("x2_rate_decisions")
def x2(spark, sf_dir):
    return store.rate_decisions(fx.read(spark, sf_dir, "events"), 2, 3600.0)


@query("x5_resumable_ingest", "select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type, (select count(*) from events) as landed from events group by 1")
def x5(spark, sf_dir):
    stream = usage.events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    table, ledger = usage.ingested(stream, "user_id", "ts", "event_id")
    return table.select("user_id", "event_id", "event_type").withColumn("landed", ledger.agg(F.sum("rows")).scalar())


def _radians_sql() -> str:
    """The projection's inverse over columns x, y (scaled), as SQL."""
    k, (a, b, d) = grids.constants(), grids.series()
    c = f"(2 * asin(sqrt(x * x + y * y) / (2 * {k['radius']!r}::double)))"
    beta = f"asin(cos(c) * {k['sin0']!r}::double + y * sin(c) / rho * {k['cos0']!r}::double)"
    return f"""g as (select *, sqrt(x * x + y * y) as rho, {c} as c from s), h as (select *, {beta} as beta, atan2(x * sin(c), rho * cos(c) * {k['cos0']!r}::double - y * sin(c) * {k['sin0']!r}::double) as l from g)
select id, easting, northing, size, round(degrees(l) + 10.0::double, 9) as lon, round(degrees(beta + {a!r}::double * sin(2 * beta) + {b!r}::double * sin(4 * beta) + {d!r}::double * sin(6 * beta)), 9) as lat from h"""


_IDS = "select o_orderkey as id, (3100 + o_orderkey % 700) * 1000.0::double as easting, (1700 + o_custkey % 700) * 1000.0::double as northing, case when o_orderkey % 3 = 0 then 1000.0::double else (o_orderkey % 3) * 1000.0::double end as size from orders"


@query("n3_census_cells", f"with s as (select *, (easting - {grids.EAST0}::double) / {grids.constants()['scale']!r}::double as x, (northing - {grids.NORTH0}::double) * {grids.constants()['scale']!r}::double as y from ({_IDS})), {_radians_sql()}")
def n3(spark, sf_dir):
    k, digits = F.col("o_orderkey"), lambda c: c.cast("string")
    name = F.concat(F.when(k % 3 == 0, "").otherwise(F.concat(digits(k % 3), F.lit("km"))), F.lit("N"), digits(F.col("o_custkey") % 700 + 1700), F.lit("E"), digits(k % 700 + 3100))
    cells = fx.read(spark, sf_dir, "orders").select(k.alias("id"), name.alias("name"))
    cells = cells.select("id", *(c.alias(n) for n, c in grids.corner(F.col("name")).items()))
    lon, lat = grids.lonlat(F.col("easting"), F.col("northing"))
    return _rounded(cells.select("*", lon.alias("lon"), lat.alias("lat")), lon=9, lat=9)
