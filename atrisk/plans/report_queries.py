"""Registered queries of the report's lists, guards, catalogues and registry jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrisk.functions import geom, norm
from atrisk.operators import exposure, reports, resolve
from atrisk.plans.exposure_queries import _BANDED, _FRONT, _LATEST, _SCORED, _rounded, _scored
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx

ASSETS, BANDS = fx.ASSETS_SQL, fx.BANDS
REGIONS = {"coast": (1.9, 41.2, 2.3, 41.6), "centre": (1.7, 41.4, 2.1, 41.8), "north": (1.5, 41.7, 2.3, 42.0)}
_BOXES = "(select * from (values " + ", ".join(f"('{n}', {', '.join(f'{v}::double' for v in b)})" for n, b in REGIONS.items()) + ") r(region, x0, y0, x1, y1))"
_IX, _IY = "floor(lon / 0.05::double)::bigint", "floor(lat / 0.05::double)::bigint"


@query("a8_dwelling_fallback", f"select sum(coalesce(case when cap_people > 0 then cap_people end, (source_ref % 9) * 2.47::double, 0)) as residents, count(*) as assets from {ASSETS} where category = 'residential'")
def a8(spark, sf_dir):
    assets = fx.assets(spark, sf_dir).select("category", F.col("cap_people").alias("people"), (F.col("source_ref") % 9).alias("dwellings"))
    return reports.dwelling_fallback(assets)


@query("a17_tile_plan", f"with t as (select distinct province, {_IX} as ix, {_IY} as iy from {ASSETS}) select province, count(*) as tiles, count(distinct (floor(ix / 4), floor(iy / 4))) as blocks from t group by 1")
def a17(spark, sf_dir):
    return reports.tile_plan(fx.assets(spark, sf_dir), "province", 4)


@query("a20_signup_funnel", "with s as (select c_mktsegment as origin, c_nationkey as email, c_custkey % 3 as k from customer), e as (select origin, email, sum((k = 0)::int)::bigint as completed, sum((k = 1)::int)::bigint as pending, sum((k = 2)::int)::bigint as expired from s group by 1, 2) select origin, sum(completed)::bigint as completed, sum(pending)::bigint as pending, sum(expired)::bigint as expired, max(pending) as most_pending from e group by 1")
def a20(spark, sf_dir):
    k = F.col("c_custkey") % 3
    rows = fx.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("origin"), F.col("c_nationkey").alias("email"), F.when(k == 0, "completed").when(k == 1, "pending").otherwise("expired").alias("status"))
    return reports.signup_funnel(rows)


@query("a21_catalogue", f"select category, string_agg(distinct subcategory, ',' order by subcategory) as subcategories, count(*) as assets, count(distinct subcategory)::int as kinds from {ASSETS} group by 1")
def a21(spark, sf_dir):
    return reports.catalogue(fx.assets(spark, sf_dir)).withColumn("subcategories", F.array_join("subcategories", ","))


@query("o1_report_sorts", f"with {_SCORED}, s as (select id, category, subcategory, name, round(priority, 6) as p, round(total_eur, 2) as v, round(distance_m, 2) as d from scored) select * from (select 'priority' as sort_by, id from s order by p desc, id limit 50) union all select * from (select 'value', id from s order by v desc, id limit 50) union all select * from (select 'distance', id from s order by d asc nulls last, id limit 50) union all select * from (select 'category', id from s order by category, subcategory, name, id limit 50)")
def o1(spark, sf_dir):
    s = _rounded(_scored(spark, sf_dir).select("id", "category", "subcategory", "name", F.col("priority").alias("p"), F.col("total_eur").alias("v"), F.col("distance_m").alias("d")), p=6, v=2, d=2)
    orders = {"priority": [F.desc("p")], "value": [F.desc("v")], "distance": [F.asc_nulls_last("d")], "category": [F.col("category"), F.col("subcategory"), F.col("name")]}
    parts = [reports.first_by(s, order, 50).select(F.lit(name).alias("sort_by"), "id") for name, order in orders.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("o5_scan_cap", f"select id, category, (select count(*) > 1000 from {ASSETS}) as truncated from {ASSETS} order by id limit 1000")
def o5(spark, sf_dir):
    return reports.with_truncated(fx.assets(spark, sf_dir).select("id", "category"), 1000)


@query("o6_reader_lists", f"select * from (select 'cell' as kind, cell_id as id, population as figure from {fx.GRID_SQL} order by population desc, cell_id limit 20) union all select * from (select 'asset', id, confidence from {ASSETS} order by confidence desc, id limit 50)")
def o6(spark, sf_dir):
    cells = reports.first_by(fx.pop_grid(spark, sf_dir).select(F.lit("cell").alias("kind"), F.col("cell_id").alias("id"), F.col("population").alias("figure")), [F.desc("figure")], 20)
    return cells.unionByName(reports.first_by(fx.assets(spark, sf_dir).select(F.lit("asset").alias("kind"), "id", F.col("confidence").alias("figure")), [F.desc("figure")], 50))


@query("o7_record_cap", f"select source_ref, id from {ASSETS} where source_id = 'osm' order by source_ref, id limit 100")
def o7(spark, sf_dir):
    return reports.first_by(fx.assets(spark, sf_dir).filter("source_id = 'osm'").select("source_ref", "id"), [F.col("source_ref")], 100)


@query("b3_region_tiles", f"select {_IX} as ix, {_IY} as iy, count(distinct region) as regions from {ASSETS} join {_BOXES} on lon between x0 and x1 and lat between y0 and y1 group by 1, 2")
def b3(spark, sf_dir):
    tiles = reports.in_regions(fx.assets(spark, sf_dir), REGIONS).select("region", geom.tile_index(F.col("lon"), 0.05).alias("ix"), geom.tile_index(F.col("lat"), 0.05).alias("iy"))
    return tiles.groupBy("ix", "iy").agg(F.countDistinct("region").alias("regions"))


@query("b5_wanted_layers", f"select source_id, list_has_any(list(distinct category), ['tourism', 'water']) as wanted, len(list_intersect(list(distinct category), ['tourism', 'water']))::int as layers from {ASSETS} group by 1")
def b5(spark, sf_dir):
    wanted = F.array(F.lit("tourism"), F.lit("water"))
    of = fx.assets(spark, sf_dir).groupBy("source_id").agg(F.collect_set("category").alias("c"))
    return of.select("source_id", F.arrays_overlap("c", wanted).alias("wanted"), F.size(F.array_intersect("c", wanted)).alias("layers"))


@query("j15_source_selection", f"select source_id from (select source_id, min(lon) as a, max(lon) as b, min(lat) as c, max(lat) as d, list(distinct category) as l from {ASSETS} group by 1) where a <= 1.98 and b >= 1.82 and c <= 41.68 and d >= 41.52 and list_has_any(l, ['healthcare', 'energy'])")
def j15(spark, sf_dir):
    e = fx.assets(spark, sf_dir).groupBy("source_id").agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d"), F.collect_set("category").alias("l"))
    x0, y0, x1, y1 = geom.envelope(BANDS[0][2])
    return e.filter((F.col("a") <= x1) & (F.col("b") >= x0) & (F.col("c") <= y1) & (F.col("d") >= y0) & F.arrays_overlap("l", F.array(F.lit("healthcare"), F.lit("energy")))).select("source_id")


@query("j12_region_coverage", f"with l as ({_LATEST}), t as (select string_split(tile_key, '/')[2]::bigint * 0.05::double as lon, string_split(tile_key, '/')[3]::bigint * 0.05::double as lat, status from l) select region, count(*) as tiles, sum((status = 'ok')::int)::bigint as ok from t join {_BOXES} on lon between x0 and x1 and lat between y0 and y1 group by 1")
def j12(spark, sf_dir):
    from atrisk.operators import store

    part = F.split("tile_key", "/")
    now = store.latest(fx.tile_ledger(spark, sf_dir), "tile_key", "fetched_at", "event_id", "status")
    tiles = now.select("status", (part[1].cast("long") * F.lit(0.05)).alias("lon"), (part[2].cast("long") * F.lit(0.05)).alias("lat"))
    return reports.in_regions(tiles, REGIONS).groupBy("region").agg(F.count("*").alias("tiles"), F.sum((F.col("status") == "ok").cast("long")).alias("ok"))


_PLACES = "(select id, source_ref, case when source_ref % 5 <> 0 then province end as p, case when source_ref % 3 = 0 then ' ' || upper(province) end as q, case when source_ref % 13 <> 0 then lon end as lon, lat from " + ASSETS + ")"


def _places(spark, sf_dir):
    k = F.col("source_ref")
    return fx.assets(spark, sf_dir).select("id", F.when(k % 5 != 0, F.col("province")).alias("p"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper("province"))).alias("q"), F.when(k % 13 != 0, F.col("lon")).alias("lon"), "lat")


@query("f5_place_filter", f"select id from {_PLACES} where (p is null and q is null) or p in ('girona', 'lleida') or lower(trim(q)) in ('girona', 'lleida')")
def f5(spark, sf_dir):
    return _places(spark, sf_dir).filter(reports.wanted_place([F.col("p"), F.col("q")], ["girona", "lleida"])).select("id")


@query("f6_point_filter", f"select id from {_PLACES} where lon is null or lat is null or (lon between 1.7 and 2.1 and lat between 41.4 and 41.8)")
def f6(spark, sf_dir):
    return _places(spark, sf_dir).filter(reports.wanted_point(F.col("lon"), F.col("lat"), REGIONS["centre"])).select("id")


@query("f7_place_box", f"select province, min(lon) as x0, min(lat) as y0, max(lon) as x1, max(lat) as y1 from {ASSETS} where province in ('girona', 'teruel') group by 1")
def f7(spark, sf_dir):
    known = fx.assets(spark, sf_dir).filter(F.col("province").isin("girona", "teruel"))
    return known.groupBy("province").agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))


@query("f10_area_guard", f"with e as (select subcategory, min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from {ASSETS} group by 1), k as (select subcategory, (x1 - x0) * cos(radians((y0 + y1) / 2)) * (y1 - y0) * 111.32::double * 111.32::double as km2 from e) select subcategory, round(km2, 4) as km2, km2 <= 3500 as accepted from k")
def f10(spark, sf_dir):
    return _rounded(reports.area_guard(fx.assets(spark, sf_dir), "subcategory", 3500.0), km2=4)


@query("v10_coverage_regime", f"select case when lon between 1.7 and 2.1 and lat between 41.4 and 41.8 then 'regional' when lon between 1.5 and 2.3 and lat between 41.7 and 42.0 then 'national' else 'open map only' end as regime, count(*) as assets from {ASSETS} group by 1")
def v10(spark, sf_dir):
    regime = reports.coverage_regime(F.col("lon"), F.col("lat"), REGIONS["centre"], REGIONS["north"])
    return fx.assets(spark, sf_dir).groupBy(regime.alias("regime")).agg(F.count("*").alias("assets"))


@query("v13_metric_buffer", f"with a as (select * from {ASSETS}), {_BANDED}, {_FRONT} select b.id from banded b join front f using (id) where b.band_index = 0 or f.distance_m <= 500")
def v13(spark, sf_dir):
    return fx.assets(spark, sf_dir).filter(geom.within_m(F.col("lon"), F.col("lat"), BANDS[0][2], 500.0)).select("id")


@query("r9_ndjson", f"select to_json({{'type': 'header', 'assets': (select count(*) from {ASSETS})}})::varchar as value union all select to_json({{'id': id, 'category': category, 'source_ref': source_ref}})::varchar from {ASSETS}")
def r9(spark, sf_dir):
    assets = fx.assets(spark, sf_dir)
    header = assets.agg(F.count("*").alias("assets")).select(F.lit("header").alias("type"), "assets")
    return reports.ndjson(assets, header, "id", "category", "source_ref")


_SETS = "(select o_custkey as set_id, 'b' || o_orderkey as band, case when o_custkey % 2 = 0 and o_orderkey % 3 <> 0 then (o_orderkey % 7) * 60.0::double end as minutes, o_totalprice::double as area from orders)"


def _sets(spark, sf_dir):
    k = F.col("o_orderkey")
    return fx.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.concat(F.lit("b"), k.cast("string")).alias("band"), F.when((F.col("o_custkey") % 2 == 0) & (k % 3 != 0), (k % 7) * 60.0).alias("minutes"), F.col("o_totalprice").cast("double").alias("area"))


@query("w2_band_order", f"with s as (select *, max(minutes is not null) over (partition by set_id) as timed from {_SETS}) select set_id, band, row_number() over (partition by set_id order by case when timed then minutes end asc nulls last, case when not timed then area end asc nulls last, band)::int as position from s")
def w2(spark, sf_dir):
    return reports.bands_in_order(_sets(spark, sf_dir), "set_id").select("set_id", "band", "position")


@query("v15_band_minutes", "with s as (select o_orderkey as k, case o_orderkey % 4 when 0 then (o_orderkey % 9) || 'h' when 1 then ' ' || (o_orderkey % 90) || ' min' when 2 then 'zone' else '3H' end as label, case when o_orderkey % 11 = 0 then 45.0::double end as m, case when o_orderkey % 13 = 0 then 2.0::double end as h from orders) select k, coalesce(m, h * 60, case when k % 4 = 0 then (k % 9) * 60.0::double when k % 4 = 1 then (k % 90)::double when k % 4 = 3 then 180.0::double end) as minutes from s")
def v15(spark, sf_dir):
    k = F.col("o_orderkey")
    label = F.when(k % 4 == 0, F.concat((k % 9).cast("string"), F.lit("h"))).when(k % 4 == 1, F.concat(F.lit(" "), (k % 90).cast("string"), F.lit(" min"))).when(k % 4 == 2, "zone").otherwise("3H")
    return fx.read(spark, sf_dir, "orders").select(k.alias("k"), reports.band_minutes(label, F.when(k % 11 == 0, 45.0), F.when(k % 13 == 0, 2.0)).alias("minutes"))


# Lines from order items; repeated line numbers are ordered by their other columns.
_WAY = "(select l_orderkey as id, l_orderkey % 6 as kind, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as seq, 1.5::double + ((l_orderkey * 7919) % 10007) / 10007.0::double * 0.8::double + ((l_partkey * 13) % 201 - 100) * 1e-4::double as x, 41.2::double + ((l_orderkey * 104729) % 10009) / 10009.0::double * 0.8::double + ((l_suppkey * 17) % 201 - 100) * 1e-4::double as y from lineitem)"
_SEGMENTS = f"(select id, kind, seq, x, y, lead(x) over w as x2, lead(y) over w as y2, first(x) over w as x0, first(y) over w as y0, count(*) over (partition by id) as n from {_WAY} window w as (partition by id order by seq))"
_METRES = "2 * 6371008.8::double * asin(sqrt(pow(sin(radians(y2 - y) / 2), 2) + cos(radians(y)) * cos(radians(y2)) * pow(sin(radians(x2 - x) / 2), 2)))"


def _vertices(spark, sf_dir):
    k = F.col("l_orderkey")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x = ((k * 7919) % 10007) / F.lit(10007.0) * 0.8 + 1.5 + ((F.col("l_partkey") * 13) % 201 - 100) * F.lit(1e-4)
    y = ((k * 104729) % 10009) / F.lit(10009.0) * 0.8 + 41.2 + ((F.col("l_suppkey") * 17) % 201 - 100) * F.lit(1e-4)
    return fx.read(spark, sf_dir, "lineitem").select(k.alias("id"), (k % 6).alias("kind"), seq.alias("seq"), x.alias("x"), y.alias("y"))


def _ways(spark, sf_dir):
    return reports.ways(_vertices(spark, sf_dir))


@query("u2_envelopes", f"select id, round(min(x), 9) as min_x, round(min(y), 9) as min_y, round(max(x), 9) as max_x, round(max(y), 9) as max_y from {_WAY} group by 1")
def u2(spark, sf_dir):
    return _rounded(_ways(spark, sf_dir).select("id", *(c.alias(n) for n, c in reports.envelope_of(F.col("points")).items())), min_x=9, min_y=9, max_x=9, max_y=9)


@query("a5_network_length", f"select kind, round(sum(coalesce(m, 0)) / 1000, 3) as km, count(distinct id) as lines from (select id, kind, {_METRES} as m from {_SEGMENTS}) group by 1")
def a5(spark, sf_dir):
    lines = _ways(spark, sf_dir).select("kind", reports.length_m(F.col("points")).alias("m"))
    return _rounded(lines.groupBy("kind").agg((F.sum("m") / 1000).alias("km"), F.count("*").alias("lines")), km=3)


@query("v12_perimeter_area", f"select id, round(abs(sum(x * coalesce(y2, y0) - coalesce(x2, x0) * y)) / 2 * 1e6, 4) as area from {_SEGMENTS} where n > 2 group by 1")
def v12(spark, sf_dir):
    rings = _ways(spark, sf_dir).filter(F.size("points") > 2)
    return _rounded(rings.select("id", (F.abs(geom.shoelace(F.col("points"))) / 2 * 1e6).alias("area")), area=4)


@query("v16_ring_notes", f"select note, count(*) as rings from (select id, case when count(*) < 4 then 'too few positions' when max_by(x, seq) <> min_by(x, seq) or max_by(y, seq) <> min_by(y, seq) then 'not closed' end as note from {_WAY} group by 1) group by 1")
def v16(spark, sf_dir):
    return _ways(spark, sf_dir).groupBy(reports.ring_notes(F.col("points")).alias("note")).agg(F.count("*").alias("rings"))


_RANK = "case source_id " + " ".join(f"when '{k}' then {v}" for k, v in fx.SOURCES.items()) + " else 0 end"


@query("w1_primary_election", f"with r as (select source_ref as id, province, subcategory, source_id, confidence, {_RANK} as rank from {ASSETS}) select province, subcategory, max_by(id, (rank, confidence, -id)) as id, max_by(source_id, (rank, confidence, -id)) as source_id, count(*) as members from r group by 1, 2")
def w1(spark, sf_dir):
    records = fx.assets(spark, sf_dir).select(F.col("source_ref").alias("id"), "province", "subcategory", "source_id", "confidence")
    return reports.elected(records, ["province", "subcategory"], fx.SOURCES)


@query("k3_tile_groups", f"with t as (select distinct {_IX} as ix, {_IY} as iy from {ASSETS}), n as (select *, floor(ix / 8)::bigint as strip, row_number() over (partition by floor(ix / 8) order by iy, ix) as n from t) select strip, floor((n - 1) / 10)::bigint as part, count(*) as tiles, min(ix) as min_ix, max(ix) as max_ix, min(iy) as min_iy, max(iy) as max_iy from n group by 1, 2")
def k3(spark, sf_dir):
    tiles = fx.assets(spark, sf_dir).select(geom.tile_index(F.col("lon"), 0.05).alias("ix"), geom.tile_index(F.col("lat"), 0.05).alias("iy")).distinct()
    return reports.grouped_tiles(tiles, 10)


@query("k4_refresh_outcome", f"with l as ({_LATEST}), b as (select string_split(tile_key, '/')[2] as block, count(*) as tiles, sum((status = 'ok')::int)::bigint as ok from l group by 1) select *, case when ok = tiles then 'done' when ok > 0 then 'partial' else 'failed' end as outcome, floor(ok * 100 / tiles)::bigint as percent from b")
def k4(spark, sf_dir):
    from atrisk.operators import store

    now = store.latest(fx.tile_ledger(spark, sf_dir), "tile_key", "fetched_at", "event_id", "status")
    return reports.refresh_outcome(now.withColumn("block", F.split("tile_key", "/")[1]), "block")


@query("u5_run_ledger", f"select event_id as run_id, user_id % 11 as source_id, case when event_type = 'error' then 'error' when user_id % 2 = 0 then 'partial' else 'ok' end as status, case when event_type <> 'error' then user_id else 0 end as rows, case when event_type = 'error' then repeat('e', 500) end as error from events")
def u5(spark, sf_dir):
    error = F.when(F.col("event_type") == "error", F.repeat(F.lit("e"), F.lit(600)))
    runs = fx.read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), (F.col("user_id") % 11).alias("source_id"), F.col("user_id").alias("rows"), error.alias("error"))
    return reports.run_rows(runs, F.col("rows") % 2 == 0)


@query("u6_enrichment_cache", "select s_suppkey, case when n.n_nationkey % 3 = 0 then 'old ' || n_name when n.n_nationkey % 3 = 1 then 'new ' || n_name end as payload, case when n.n_nationkey % 3 = 0 then true when n.n_nationkey % 3 = 1 then false end as cached from supplier left join nation n on s_nationkey = n_nationkey")
def u6(spark, sf_dir):
    n = fx.read(spark, sf_dir, "nation")
    of = lambda rest, word: n.filter(f"n_nationkey % 3 = {rest}").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit(word), "n_name").alias("payload"))
    return reports.enriched(fx.read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", of(0, "old "), of(1, "new ")).select("s_suppkey", "payload", "cached")


_NATION = "(select n_nationkey as k, n_nationkey % 7 as rank, lower(n_name) as n, 1.5::double + ((n_nationkey * 7919) % 10007) / 10007.0::double * 0.8::double as lon, 41.2::double + ((n_nationkey * 104729) % 10009) / 10009.0::double * 0.8::double as lat from nation)"


def _gazetteer(spark, sf_dir):
    k = F.col("n_nationkey")
    lon, lat = ((k * 7919) % 10007) / F.lit(10007.0) * 0.8 + 1.5, ((k * 104729) % 10009) / F.lit(10009.0) * 0.8 + 41.2
    names = fx.read(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), F.array(F.concat(F.lit("la "), "n_name"), F.lit("shared")).alias("alternates"), lon.alias("lon"), lat.alias("lat"), (k % 7).alias("rank"), k.alias("line"))
    return reports.gazetteer(names)


@query("r6_gazetteer", f"with e as (select unnest([n, 'la ' || n, 'shared']) as name, lon, lat, rank, k from {_NATION}) select name, min_by(lon, (rank, k)) as lon, min_by(lat, (rank, k)) as lat from e group by 1")
def r6(spark, sf_dir):
    return _gazetteer(spark, sf_dir)


@query("j5_gazetteer_join", f"with s as (select s_suppkey, n.* from supplier left join {_NATION} n on s_nationkey = n.k) select s_suppkey, case when s_suppkey % 5 <> 4 then lon end as lon, case when s_suppkey % 5 <> 4 then lat end as lat, case s_suppkey % 5 when 4 then null when 3 then 0.1::double else 0.3::double end as quality from s")
def j5(spark, sf_dir):
    n = fx.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    k, name = F.col("s_suppkey") % 5, F.col("n_name")
    municipality = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(", La"))).when(k == 2, F.concat(name, F.lit("/other"))).otherwise("nowhere")
    rows = fx.read(spark, sf_dir, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", municipality.alias("municipality"), F.when(k != 4, name).alias("province"))
    return reports.located(rows, "s_suppkey", _gazetteer(spark, sf_dir)).select("s_suppkey", "lon", "lat", "quality")


@query("j6_enrichment_merge", "with s as (select s_suppkey as k, case when s_suppkey % 4 <> 0 then s_name end as street, s_suppkey % 3 as m from supplier) select k, coalesce(street, 'street ' || k) as street, case m when 1 then 'approximate' when 2 then 'exact' end as match, round(0.8::double * case m when 1 then 0.3::double when 2 then 0.9::double end / 0.9::double, 6) as confidence from s where m > 0")
def j6(spark, sf_dir):
    k = F.col("k")
    rows = fx.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("street"))
    found = rows.filter(k % 3 != 0).select("k", F.concat(F.lit("street "), k.cast("string")).alias("found"), F.when(k % 3 == 1, "approximate").otherwise("exact").alias("match"), F.when(k % 3 == 1, 0.3).otherwise(0.9).alias("quality"))
    # what finds no match is dropped
    return rows.join(found, "k").select("k", F.coalesce("street", "found").alias("street"), "match", F.round(F.col("quality") * 0.8 / 0.9, 6).alias("confidence"))


@query("n1_coordinates", "select s_suppkey as k, round((s_suppkey % 90) + (s_suppkey % 60) / 60.0::double + (s_suppkey % 59 + 0.5::double) / 3600.0::double, 9) * case when s_suppkey % 2 = 0 then -1 else 1 end as lat, case s_suppkey % 5 when 0 then 1234.5::double + s_suppkey when 1 then s_suppkey + 0.25::double when 2 then 1234.5::double + s_suppkey when 3 then s_suppkey + 0.5::double end as figure from supplier")
def n1(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat((k % 90).cast("string"), F.lit("° "), (k % 60).cast("string"), F.lit("' "), (k % 59).cast("string"), F.lit(',5" '), F.when(k % 2 == 0, "S").otherwise("N"))
    grouped = F.format_number(k + 1234.5, 1)
    figure = F.when(k % 5 == 0, F.regexp_replace(grouped, r"^(\d+),(\d+)\.(\d)$", "$1.$2,$3")).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".25"))).when(k % 5 == 2, grouped).when(k % 5 == 3, F.concat(k.cast("string"), F.lit(",5 m²"))).otherwise("n/a")
    return fx.read(spark, sf_dir, "supplier").select(k.alias("k"), F.round(norm.dms(text), 9).alias("lat"), norm.decimal(figure).alias("figure"))


# The inverse by powers of the distance from the central meridian, not by the series of the columns.
_A, _E2, _EP2 = 6378137.0, norm.FLATTENING * (2 - norm.FLATTENING), norm.FLATTENING * (2 - norm.FLATTENING) / (1 - norm.FLATTENING * (2 - norm.FLATTENING))
_E1 = (1 - (1 - _E2) ** 0.5) / (1 + (1 - _E2) ** 0.5)
_UTM = f"""(select k, e, n, 3 * pi() / 180 + (d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {_EP2}::double + 24 * t * t) * d ** 5 / 120) / cos(p) as lon,
  p - n1 * tan(p) / r1 * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {_EP2}::double) * d ** 4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {_EP2}::double - 3 * c * c) * d ** 6 / 720) as lat
  from (select *, {_EP2}::double * cos(p) ** 2 as c, tan(p) ** 2 as t, {_A} / sqrt(1 - {_E2}::double * sin(p) ** 2) as n1, {_A} * (1 - {_E2}::double) / (1 - {_E2}::double * sin(p) ** 2) ** 1.5 as r1, (e - 500000) / ({_A} / sqrt(1 - {_E2}::double * sin(p) ** 2) * 0.9996::double) as d
    from (select *, m + {3 * _E1 / 2 - 27 * _E1**3 / 32}::double * sin(2 * m) + {21 * _E1**2 / 16 - 55 * _E1**4 / 32}::double * sin(4 * m) + {151 * _E1**3 / 96}::double * sin(6 * m) + {1097 * _E1**4 / 512}::double * sin(8 * m) as p
      from (select *, n / 0.9996::double / ({_A} * {1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256}::double) as m from (select p_partkey as k, 440000.0::double + (p_partkey * 7919) % 120000 as e, 4500000.0::double + (p_partkey * 104729) % 250000 as n from part)))))"""


@query("n1_plane_coordinates", f"select k, case when k % 4 = 0 then round(2.0::double + (k % 60) / 60.0::double, 4) when k % 4 < 3 then round(degrees(lon), 4) end as lon, case when k % 4 = 0 then round(-41.0::double - (k % 60) / 60.0::double, 4) when k % 4 < 3 then round(degrees(lat), 4) end as lat from {_UTM}")
def n1_plane(spark, sf_dir):
    """Degrees where they read, else plane coordinates, else neither."""
    k = F.col("p_partkey")
    minutes = (k % 60).cast("string")
    lon = F.when(k % 4 == 0, F.concat(F.lit("2º "), minutes, F.lit("'"))).when(k % 4 == 1, "0")
    lat = F.when(k % 4 == 0, F.concat(F.lit("41º "), minutes, F.lit("' 0,0'' s"))).when(k % 4 == 1, "0")
    east = F.when(k % 4 < 3, F.concat(((k * 7919) % 120000 + 440000).cast("string"), F.lit(",0 m")))
    north = ((k * 104729) % 250000 + 4500000).cast("string")
    at = fx.read(spark, sf_dir, "part").select(k.alias("k"), norm.coordinates(lon, lat, east, north).alias("at"))
    return at.select("k", F.round("at.lon", 4).alias("lon"), F.round("at.lat", 4).alias("lat"))


@query("n5_streets", "select s_suppkey as k, case s_suppkey % 3 when 0 then 'carrer ' when 1 then 'avinguda ' else '' end || s_name as street from supplier")
def n5(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 3 == 0, "C/ ").when(k % 3 == 1, "Avda. ").otherwise(""), F.col("s_name"))
    return fx.read(spark, sf_dir, "supplier").select(k.alias("k"), reports.street(text).alias("street"))


_REGISTRY = "(select s_suppkey as ref, case when s_suppkey % 3 = 0 then upper(s_name) else s_name end as raw, s_name as name, s_suppkey % 97 as size, s_suppkey % 2 as k from supplier)"


def _job(name, spark, sf_dir, kinds=("a", "b")):
    k = F.col("s_suppkey")
    rows = fx.read(spark, sf_dir, "supplier").select(k.alias("ref"), F.when(k % 3 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("name"), (k % 97).alias("size"), F.when(k % 2 == 0, kinds[0]).otherwise(kinds[1]).alias("kind"))
    return reports.JOBS[name](rows)


_TITLE = "case when raw = upper(raw) then upper(raw[1]) || lower(raw[2:]) else raw end"


@query("n12_hospitals", f"select ref::varchar as source_ref, case when k = 0 then 'mental_health' else 'hospital' end as subcategory, {_TITLE} as name, size::double as capacity, round(size * 2.2::double)::double as people, 0.9::double as confidence from {_REGISTRY}")
def n12(spark, sf_dir):
    return _job("hospitals", spark, sf_dir, ("psychiatric", "general"))


@query("n13_primary_care", f"select ref::varchar as source_ref, case when k = 0 then 'primary_care' else 'clinic' end as subcategory, case when k = 0 then 'centre ' else 'office ' end || {_TITLE} as name, null::double as capacity, null::double as people, 0.8::double as confidence from {_REGISTRY}")
def n13(spark, sf_dir):
    return _job("primary_care", spark, sf_dir, ("centre", "office"))


@query("n14_care_homes", f"select ref::varchar as source_ref, 'care_home' as subcategory, {_TITLE} as name, size::double as capacity, round(size * 1.33::double)::double as people, 0.8::double as confidence from {_REGISTRY}")
def n14(spark, sf_dir):
    return _job("care_homes", spark, sf_dir)


@query("n11_municipal_points", f"select ref::varchar as source_ref, 'other' as subcategory, raw as name, null::double as capacity, null::double as people, 0.25::double as confidence from {_REGISTRY}")
def n11(spark, sf_dir):
    return _job("municipal_points", spark, sf_dir)


def _tagged(spark, sf_dir):
    k, ways = F.col("p_partkey"), [*reports.HIGHWAYS, "steps"]
    road = F.element_at(F.array(*map(F.lit, ways)), (k % len(ways) + 1).cast("int"))
    tags = F.when(k % 3 == 0, F.create_map(F.lit("highway"), road)).when(k % 3 == 1, F.create_map(F.lit("railway"), F.when(k % 2 == 0, "rail").otherwise("tram"))).otherwise(F.create_map(F.lit("power"), F.when(k % 2 == 0, "line").otherwise("tower")))
    return fx.read(spark, sf_dir, "part").select(k.alias("k"), tags.alias("tags"))


_ROADS = "[" + ", ".join(f"'{v}'" for v in reports.HIGHWAYS.values()) + ", null]"


@query("c3_linear_classes", f"select p_partkey as k, case p_partkey % 3 when 0 then {_ROADS}[p_partkey % {len(reports.HIGHWAYS) + 1} + 1] when 1 then case when p_partkey % 2 = 0 then 'railway' end else case when p_partkey % 2 = 0 then 'power_line' end end as class from part")
def c3(spark, sf_dir):
    return _tagged(spark, sf_dir).select("k", reports.linear_class(F.col("tags")).alias("class"))


@query("c4_worth_keeping", f"select p_partkey as k from part where (p_partkey % 3 = 0 and p_partkey % {len(reports.HIGHWAYS) + 1} in (0, 2)) or (p_partkey % 3 = 2 and p_partkey % 2 = 1)")
def c4(spark, sf_dir):
    roads = list(reports.HIGHWAYS)
    return _tagged(spark, sf_dir).filter(reports.worth_keeping(F.col("tags"), {"highway": [roads[0], roads[2]], "power": ["tower"]})).select("k")


@query("v9_population_cells", f"with a as (select cell_id as id, population, x0 + 0.005::double as lon, y0 + 0.005::double as lat from {fx.GRID_SQL}), {_BANDED} select id as cell_id, population, band_index from banded")
def v9(spark, sf_dir):
    cells = fx.pop_grid(spark, sf_dir).select("cell_id", "population", (F.col("x0") + 0.005).alias("lon"), (F.col("y0") + 0.005).alias("lat"))
    return exposure.earliest_band(cells, BANDS).select("cell_id", "population", "band_index")


def _records(spark, sf_dir):
    """Records from documents, with fields of which some are missing."""
    docs = fx.read(spark, sf_dir, "documents")
    k, names = F.col("doc_id"), list(fx.SOURCES)
    more = docs.select("doc_id", F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int")).alias("source_id"), F.when(k % 7 != 0, F.floor(k / len(names)) % 15).alias("source_ref"), ((k % 5) * 0.08 + 0.5).alias("confidence"), F.when(k % 3 != 0, (k % 4).cast("double")).alias("floors"), F.when(k % 5 == 0, F.concat(F.lit("http://w/"), k.cast("string"))).alias("website"))
    return resolve.derived_records(docs).withColumn("subcategory", F.col("category")).join(more, "doc_id")


# Similarity by longest common subsequence and clusters over it are beyond SQL; tests hold
# these against brute force.
@query("e2_pair_scores")
def e2(spark, sf_dir):
    return resolve.scored_pairs(_records(spark, sf_dir), metres=3, similarity=6)


@query("e3_matches")
def e3(spark, sf_dir):
    return resolve.scored_pairs(_records(spark, sf_dir), score_references=False).filter(resolve.is_match()).select("a", "b")


@query("e4_clusters")
def e4(spark, sf_dir):
    return resolve.conflated(_records(spark, sf_dir))[1]


@query("e5_merged_records")
def e5(spark, sf_dir):
    """Merged records; the columns ``<field>_from`` are the provenance by field (E6)."""
    records = _records(spark, sf_dir)
    return resolve.merged(records, resolve.conflated(records)[1], fx.SOURCES, ["floors", "website"])


@query("e7_near_miss_hints")
def e7(spark, sf_dir):
    return resolve.hints(*resolve.conflated(_records(spark, sf_dir)))


@query("e8_conflation_stats")
def e8(spark, sf_dir):
    pairs, labels = resolve.conflated(_records(spark, sf_dir))
    n = labels.agg(F.count("*").alias("input"), F.countDistinct("cluster").alias("output")).withColumn("merged", F.col("input") - F.col("output"))
    near = resolve.hints(pairs, labels).agg(F.countDistinct("cluster").alias("suggested"))
    return n.withColumn("suggested", near.scalar())
