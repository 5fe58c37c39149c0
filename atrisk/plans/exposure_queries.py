"""Registered queries of the exposure operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrisk.functions import geom, taxonomy, value
from atrisk.operators import exposure, resolve, store
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx

BANDS = fx.BANDS
ASSETS, TAXONOMY = fx.ASSETS_SQL, taxonomy.oracle()


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.scored(fx.assets(spark, sf_dir), BANDS)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# A ray's crossings are counted per (asset, band, part, ring) over the edge table.
_BANDED = f"""rings as (select a.id, e.band, e.part, e.ring, sum(case when ((y2 > lat) <> (y1 > lat)) and lon < (lat - y2) * (x1 - x2) / (y1 - y2) + x2 then 1 else 0 end) % 2 as odd
  from a, {fx.edges_sql()} e group by all),
parts as (select id, band, part, bool_or(ring = 0 and odd = 1) and not bool_or(ring > 0 and odd = 1) as hit from rings group by all),
banded as (select a.*, b.band_index from a left join (select id, min(band) as band_index from parts where hit group by id) b using (id))"""
_MINUTES = "case band_index when 0 then 60.0::double when 1 then 180.0::double when 2 then 360.0::double end"
_FRONT = f"""front as (select id, min(sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2))) as distance_m from (
  select id, px, py, dx, dy, greatest(0.0::double, least(1.0::double, (px * dx + py * dy) / (dx * dx + dy * dy))) as t from (
    select id, (lon - x1) * k * 111320.0::double as px, (lat - y1) * 111320.0::double as py, (x2 - x1) * k * 111320.0::double as dx, (y2 - y1) * 111320.0::double as dy
    from (select *, cos(radians(lat)) as k from a), {fx.edges_sql()} e where e.band = 0)) group by id)"""
_INDEX = "case province " + " ".join(f"when '{k}' then {v}::double" for k, v in value.PROVINCE_INDEX.items()) + " else 1.0::double end"
_UNIT = "case subcategory " + " ".join(f"when '{k}' then {v}::double" for k, v in value.UNIT_VALUE.items()) + " else 1100.0::double end"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_SCORED = f"""a as (select * from {ASSETS}), {_BANDED}, {_FRONT},
v0 as (select b.*, f.distance_m, t.* exclude (subcategory, category, row_no), {_MINUTES} as minutes, nullif(greatest(b.livestock_units, 0), 0) as lu, nullif(greatest(b.animals, 0), 0) as an,
  coalesce(nullif(b.footprint_m2, 0), def_footprint) as area, coalesce(nullif(b.floors, 0), def_floors) as fl,
  coalesce(nullif(cap_people, 0), nullif(cap_beds, 0), nullif(cap_students, 0), nullif(cap_places, 0)) as given
  from banded b join {TAXONOMY} t on b.subcategory = t.subcategory join front f using (id)),
v1 as (select *, case when area > 0 and unit_cost > 0 then area * fl * unit_cost * {_INDEX} else 0.0::double end as structure_eur, (lu is null and an is not null and category = 'livestock') as by_head from v0),
v2 as (select *, structure_eur * contents_ratio as contents_eur, case when lu is not null then lu * {_UNIT} when by_head then an * ({_UNIT} / 6.0::double) else 0.0::double end as livestock_eur from v1),
v3 as (select *, structure_eur + contents_eur + livestock_eur as total_eur, coalesce(given, def_people) as people, given is null and def_people > 0 as people_default,
  case when nullif(cap_people, 0) is not null then 'capacity.people' when nullif(cap_beds, 0) is not null then 'registered beds' when nullif(cap_students, 0) is not null then 'enrolment' when nullif(cap_places, 0) is not null then 'registered places' when def_people > 0 then 'class default' else 'no occupancy data' end as people_basis,
  case when minutes is not null then 1.0::double / (1.0::double + pow(minutes / 120.0::double, 0.8::double)) else 0.6::double end as urgency,
  category is not null and criticality >= 90 as critical, subcategory in {_IN(taxonomy.HAZARDOUS)} as hazardous, subcategory in {_IN(taxonomy.RESPONSE)} as response from v2),
v4 as (select *, 0.38::double * case when people <= 0 then 0.0::double else least(1.0::double, log10(1 + people) / log10(1001.0::double)) end + 0.24::double * criticality / 100 + 0.14::double * vulnerability / 100 + 0.16::double * urgency
  + 0.08::double * case when total_eur <= 0 then 0.0::double else least(1.0::double, log10(1 + total_eur) / log10(50000001.0::double)) end as s0 from v3),
scored as (select * replace (case when hazardous then least(1.0::double, s0 * 1.25::double) else s0 end as s0), 100.0::double * case when response then least(1.0::double, case when hazardous then least(1.0::double, s0 * 1.25::double) else s0 end * 1.1::double) when hazardous then least(1.0::double, s0 * 1.25::double) else s0 end as priority, band_index is not null as inside_aoi from v4)"""


@query("j1_earliest_band", f"with a as (select * from {ASSETS}), {_BANDED} select id, band_index, case band_index when 0 then '1h' when 1 then '3h' when 2 then '6h' end as band, {_MINUTES} as minutes from banded")
def j1(spark, sf_dir):
    return exposure.earliest_band(fx.assets(spark, sf_dir), BANDS).select("id", "band_index", "band", "minutes")


@query("j2_distance_to_front", f"with a as (select * from {ASSETS}), {_FRONT} select id, round(distance_m, 3) as distance_m from front")
def j2(spark, sf_dir):
    return exposure.distance_to_front(fx.assets(spark, sf_dir), BANDS).select("id", F.round("distance_m", 3).alias("distance_m"))


@query("f1_envelope_filter", f"select id, lon, lat from {ASSETS} where lon >= 1.72 and lon <= 2.1 and lat >= 41.43 and lat <= 41.78")
def f1(spark, sf_dir):
    return fx.assets(spark, sf_dir).filter(geom.in_envelope(F.col("lon"), F.col("lat"), geom.envelope(BANDS[1][2]))).select("id", "lon", "lat")


@query("f2_in_perimeter", f"with a as (select * from {ASSETS}), {_BANDED} select id, category from banded where band_index is not null")
def f2(spark, sf_dir):
    return exposure.in_perimeter(fx.assets(spark, sf_dir), BANDS).select("id", "category")


@query("f3_layer_selection", f"select id, category, subcategory from {ASSETS} where category in ('tourism', 'healthcare')")
def f3(spark, sf_dir):
    return fx.assets(spark, sf_dir).filter(F.col("category").isin(exposure.resolve_layers(["campsite", "healthcare", "no such layer"]))).select("id", "category", "subcategory")


@query("f4_source_filter", f"select id, source_id from {ASSETS} where source_id in ('osm', 'es.cat.reses') and subcategory <> 'other'")
def f4(spark, sf_dir):
    return fx.assets(spark, sf_dir).filter(F.col("source_id").isin("osm", "es.cat.reses") & (F.col("subcategory") != "other")).select("id", "source_id")


@query("f8_coordinate_validity", f"select count(*) as n, sum(case when lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0) then 1 else 0 end)::bigint as valid from {ASSETS}")
def f8(spark, sf_dir):
    good = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & ~((F.col("lon") == 0) & (F.col("lat") == 0))
    return fx.assets(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(good.cast("long")).alias("valid"))


@query("j7_taxonomy_join", f"select id, a.subcategory, a.category, vulnerability, criticality, human from {ASSETS} a join {TAXONOMY} t on a.subcategory = t.subcategory")
def j7(spark, sf_dir):
    return exposure.with_class(fx.assets(spark, sf_dir)).select("id", "subcategory", "category", "vulnerability", "criticality", "human")


@query(
    "v1_valuation",
    f"""with {_SCORED} select id, round(structure_eur, 2) as structure_eur, round(contents_eur, 2) as contents_eur, round(livestock_eur, 2) as livestock_eur,
    case when total_eur <= 0 then 'not_valued' else coalesce(nullif(concat_ws('+', case when footprint_m2 > 0 and geometry_kind = 'footprint' then 'measured_footprint' when footprint_m2 > 0 then 'source_footprint' when def_footprint > 0 then 'default_footprint' end, case when floors > 0 then 'source_floors' end, case when lu is not null then 'livestock_units' when by_head then 'livestock_headcount' end), ''), 'class_default') end as value_method,
    round(case when total_eur <= 0 then 0.0::double else greatest(0.05::double, least(0.9::double, case when footprint_m2 > 0 and geometry_kind = 'footprint' then 0.8::double when footprint_m2 > 0 then 0.8::double - 0.1::double when def_footprint > 0 then 0.35::double else 0.8::double end - case when floors > 0 or area <= 0 then 0.0::double else 0.08::double end - case when by_head then 0.15::double else 0.0::double end)) end, 3) as value_confidence from scored""",
)
def v1(spark, sf_dir):
    out = _scored(spark, sf_dir).select("id", "structure_eur", "contents_eur", "livestock_eur", "value_method", "value_confidence")
    return _rounded(out, structure_eur=2, contents_eur=2, livestock_eur=2, value_confidence=3)


@query("v5_occupancy", f"with {_SCORED} select id, people, people_basis, people_default from scored")
def v5(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "people", "people_basis", "people_default")


@query("v7_priority", f"with {_SCORED} select id, round(urgency, 6) as urgency, round(priority, 6) as priority from scored")
def v7(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir).select("id", "urgency", "priority"), urgency=6, priority=6)


@query("v8_exposure_assembly", f"with {_SCORED} select id, category, band_index, inside_aoi, hazardous, response, critical, round(distance_m, 1) as distance_m, people from scored")
def v8(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir).select("id", "category", "band_index", "inside_aoi", "hazardous", "response", "critical", "distance_m", "people"), distance_m=1)


@query("a1_band_category_rollup", f"with {_SCORED} select band_index, category, count(*) as assets, sum(people) as people, round(sum(total_eur), 0) as value_eur, sum(critical::int)::bigint as critical, sum(hazardous::int)::bigint as hazardous from scored where band_index is not null group by grouping sets ((band_index, category), (band_index), (category), ())")
def a1(spark, sf_dir):
    return _rounded(exposure.rollup(_scored(spark, sf_dir)), value_eur=0)


@query("a2_band_summary", f"with {_SCORED}, b as (select * from (values (0, '1h', 60.0::double), (1, '3h', 180.0::double), (2, '6h', 360.0::double)) t(band_index, band, minutes)) select b.band_index, b.band, b.minutes, count(s.id) as assets, coalesce(sum(s.people), 0) as people, round(coalesce(sum(s.total_eur), 0), 0) as value_eur, coalesce(sum(s.critical::int), 0)::bigint as critical from b left join scored s on b.band_index = s.band_index group by all")
def a2(spark, sf_dir):
    return _rounded(exposure.band_summary(_scored(spark, sf_dir), BANDS), value_eur=0)


@query("a3_category_summary", f"with {_SCORED} select category, count(*) as assets, sum(people) as people, round(sum(total_eur), 0) as value_eur from scored group by 1")
def a3(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir).groupBy("category").agg(F.count("*").alias("assets"), F.sum("people").alias("people"), F.sum("total_eur").alias("value_eur")), value_eur=0)


_SUMMARY = "select count(*) as asset_count, sum(case when inside_aoi then people else 0 end) as people, sum(case when inside_aoi and not people_default then people else 0 end) as people_registry, sum(case when inside_aoi and people_default then people else 0 end) as people_default, round(sum(case when inside_aoi then total_eur else 0 end), 0) as value_eur, sum(critical::int)::bigint as critical, sum(hazardous::int)::bigint as hazardous, sum(response::int)::bigint as response, coalesce(sum(livestock_units), 0) as livestock_units from scored"


@query("a4_report_summary", f"with {_SCORED} {_SUMMARY}")
def a4(spark, sf_dir):
    return _rounded(exposure.summary(_scored(spark, sf_dir)), value_eur=0)


@query("o2_report_page", f"with {_SCORED} select id, round(priority, 6) as priority from scored where inside_aoi order by round(priority, 6) desc, id limit 200")
def o2(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir).filter("inside_aoi").select("id", "priority"), priority=6).orderBy(F.desc("priority"), "id").limit(200)


@query("o3_top_priority", f"with {_SCORED} select id, name, category, round(priority, 6) as priority, people from scored order by round(priority, 6) desc, id limit 10")
def o3(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir).select("id", "name", "category", "priority", "people"), priority=6).orderBy(F.desc("priority"), "id").limit(10)


@query("v17_exposure_report", f"with {_SCORED} select category, band_index, count(*) as assets, sum(people) as people, round(sum(total_eur), 0) as value_eur, round(max(priority), 5) as top_priority, round(min(distance_m), 3) as nearest_m from scored where inside_aoi group by 1, 2")
def v17(spark, sf_dir):
    """The flagship: perimeter filter, classes, bands, values, scores and roll-up in one plan."""
    # a point on the boundary may be in no band, as those follow the even-odd rule alone
    inside = exposure.scored(exposure.in_perimeter(fx.assets(spark, sf_dir), BANDS, keep_band=True), BANDS).filter("inside_aoi")
    out = inside.groupBy("category", "band_index").agg(F.count("*").alias("assets"), F.sum("people").alias("people"), F.sum("total_eur").alias("value_eur"), F.max("priority").alias("top_priority"), F.min("distance_m").alias("nearest_m"))
    return _rounded(out, value_eur=0, top_priority=5, nearest_m=3)


@query("a13_robust_density", f"select n, round(0.98 * 0.98 * n / ((q[2] - q[1]) * (r[2] - r[1])), 6) as density from (select count(*) as n, quantile_cont(lon, [0.01, 0.99]) as q, quantile_cont(lat, [0.01, 0.99]) as r from {ASSETS})")
def a13(spark, sf_dir):
    q = lambda c: F.percentile(c, F.array(F.lit(0.01), F.lit(0.99)))
    p = fx.assets(spark, sf_dir).agg(F.count("*").alias("n"), q("lon").alias("q"), q("lat").alias("r"))
    return p.select("n", F.round(F.col("n") * (0.98 * 0.98) / ((F.col("q")[1] - F.col("q")[0]) * (F.col("r")[1] - F.col("r")[0])), 6).alias("density"))


@query("a14_candidate_count", f"select count(*) as candidates from {ASSETS} where lon >= 1.82 and lon <= 1.98 and lat >= 41.52 and lat <= 41.68")
def a14(spark, sf_dir):
    return fx.assets(spark, sf_dir).filter(geom.in_envelope(F.col("lon"), F.col("lat"), geom.envelope(BANDS[0][2]))).agg(F.count("*").alias("candidates"))


@query("a15_source_category_counts", f"select source_id, category, count(*) as n from {ASSETS} group by 1, 2")
def a15(spark, sf_dir):
    return fx.assets(spark, sf_dir).groupBy("source_id", "category").agg(F.count("*").alias("n"))


@query("a18_distinct_places", f"select distinct province from {ASSETS} order by 1 limit 2000")
def a18(spark, sf_dir):
    return fx.assets(spark, sf_dir).select("province").distinct().orderBy("province").limit(2000)


@query("j11_tile_cover", f"select '0.05/' || floor(lon / 0.05::double)::bigint || '/' || floor(lat / 0.05::double)::bigint as tile_key, count(*) as n from {ASSETS} group by 1")
def j11(spark, sf_dir):
    return fx.assets(spark, sf_dir).groupBy(geom.tile_key(F.col("lon"), F.col("lat")).alias("tile_key")).agg(F.count("*").alias("n"))


@query("n6_identity", f"select id, 'atr_' || substring(sha1(source_id || '::' || source_ref), 1, 20) as asset_id from {ASSETS}")
def n6(spark, sf_dir):
    return fx.assets(spark, sf_dir).select("id", F.concat(F.lit("atr_"), F.substring(F.sha1(F.concat_ws("::", "source_id", F.col("source_ref").cast("string"))), 1, 20)).alias("asset_id"))


_NOW = f"timestamp '{fx.AS_OF}'"
_LATEST = f"select tile_key, max_by(status, (fetched_at, event_id)) as status, max(fetched_at) as fetched_at from {fx.LEDGER_SQL} group by 1"
_STATE = f"case when status = 'ok' and epoch({_NOW}) - epoch(fetched_at) <= 336 * 3600 then 'fresh' when status <> 'ok' and epoch({_NOW}) - epoch(fetched_at) <= 1800 then 'failed' else 'stale' end"


def _as_of():
    return F.lit(fx.AS_OF).cast("timestamp")


@query("k1_tile_states", f"select tile_key, fetched_at, status, {_STATE} as state from ({_LATEST})")
def k1(spark, sf_dir):
    return store.tile_states(fx.tile_ledger(spark, sf_dir), _as_of())


_WANTED = f"(select distinct '0.05/' || floor(lon / 0.05::double)::bigint || '/' || floor(lat / 0.05::double)::bigint as tile_key from {ASSETS})"


@query("b2_stale_tiles", f"select tile_key from {_WANTED} where tile_key not in (select tile_key from (select tile_key, {_STATE} as state from ({_LATEST})) where state <> 'stale')")
def b2(spark, sf_dir):
    wanted = fx.assets(spark, sf_dir).select(geom.tile_key(F.col("lon"), F.col("lat")).alias("tile_key")).distinct()
    return wanted.join(store.tile_states(fx.tile_ledger(spark, sf_dir), _as_of()).filter("state != 'stale'"), "tile_key", "left_anti")


@query("a10_store_stats", f"select source_id, count(*) as n, count(distinct category) as categories from {ASSETS} group by 1")
def a10(spark, sf_dir):
    return fx.assets(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("category").alias("categories"))


_RUNS = f"(select source_id, max_by(status, (finished_at, run_id)) as status, max(finished_at) as finished_at from {fx.RUNS_SQL} group by 1)"


@query("a11_source_stats", f"select a.source_id, a.n, r.status, r.finished_at from (select source_id, count(*) as n from {ASSETS} group by 1) a left join {_RUNS} r using (source_id)")
def a11(spark, sf_dir):
    runs = store.latest(fx.source_runs(spark, sf_dir), "source_id", "finished_at", "run_id", "status").drop("run_id")
    return fx.assets(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n")).join(runs, "source_id", "left").select("source_id", "n", "status", "finished_at")


@query("a12_pending_sources", f"select source_id, coalesce(status, 'never_run') as status from (select distinct source_id from {ASSETS}) left join {_RUNS} using (source_id) where status is null or status not in ('ok', 'loaded')")
def a12(spark, sf_dir):
    runs = store.latest(fx.source_runs(spark, sf_dir), "source_id", "finished_at", "run_id", "status")
    sources = fx.assets(spark, sf_dir).select("source_id").distinct()
    return sources.join(runs, "source_id", "left").filter("status is null or status not in ('ok', 'loaded')").select("source_id", F.coalesce("status", F.lit("never_run")).alias("status"))


@query("a16_daily_usage", "select user_id as key, ts::date as day, count(*) as used, count(*) > 3 as over from events group by 1, 2")
def a16(spark, sf_dir):
    return store.daily_usage(fx.read(spark, sf_dir, "events"), 3)


_CHANGED = f"(select * replace (name || '+' as name), row_number() over (partition by id order by source_ref desc) as rn from (select * from {ASSETS} where source_ref % 5 = 0 union all select * replace ('n' || id as id) from {ASSETS} where source_ref % 17 = 0))"


@query("u1_keyed_upsert", f"select id, name from {ASSETS} where id not in (select id from {_CHANGED}) union all select id, name from {_CHANGED} where rn = 1")
def u1(spark, sf_dir):
    base = fx.assets(spark, sf_dir).select("id", "name", "source_ref")
    batch = base.filter("source_ref % 5 = 0").unionByName(base.filter("source_ref % 17 = 0").withColumn("id", F.concat(F.lit("n"), "id")))
    batch = batch.withColumns({"name": F.concat("name", F.lit("+")), "position": -F.col("source_ref")})
    return store.upsert(base, batch, "id", "position").select("id", "name")


_PLACED = _CHANGED.replace("partition by id order", "partition by id, source_ref % 3 = 0 order")


@query("u1_placed_upsert", f"with b as (select id, name, source_ref, lon from {_PLACED} where rn = 1 and source_ref % 3 > 0) select id, name, lon from {ASSETS} where id not in (select id from b) union all select id, name, lon from b")
def u1_placed(spark, sf_dir):
    """A third of the batch has no place and changes nothing."""
    base = fx.assets(spark, sf_dir).select("id", "name", "source_ref", "lon", "lat")
    batch = base.filter("source_ref % 5 = 0").unionByName(base.filter("source_ref % 17 = 0").withColumn("id", F.concat(F.lit("n"), "id")))
    batch = batch.withColumns({"name": F.concat("name", F.lit("+")), "position": -F.col("source_ref"), "lat": F.when(F.col("source_ref") % 3 > 0, F.col("lat"))})
    return store.upsert(base, batch, "id", "position", needs=["lon", "lat"]).select("id", "name", "lon")


_REC = """(select doc_id, array_to_string(string_split(text, ' ')[1:4], ' ') as name, ('0x' || md5(array_to_string(string_split(text, ' ')[1:2], ' '))[1:8])::bigint as h from documents where text is not null)"""
_GEO = f"""(select doc_id, name, h % 17 as category, 1.5::double + (h % 4001) / 4001.0::double * 0.8::double + ((doc_id * 31) % 41 - 20) * 5e-5::double as lon, 41.2::double + (h % 4003) / 4003.0::double * 0.8::double + ((doc_id * 31) % 41 - 20) * 5e-5::double as lat from {_REC})"""


@query(
    "j3_blocking_pairs",
    f"""with c as (select *, trunc(lat * 111320.0::double / 150.0::double)::bigint as cy, trunc(lon * 111320.0::double * cos(radians(lat)) / 150.0::double)::bigint as cx from {_GEO}),
    n as (select a.doc_id as a, b.doc_id as b, 2 * 6371008.8::double * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) as m from c a join c b on a.category = b.category and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 and a.doc_id < b.doc_id)
    select a, b, round(m, 3) as metres from n where m <= 250""",
)
def j3(spark, sf_dir):
    return resolve.near_pairs(resolve.derived_records(fx.read(spark, sf_dir, "documents")), 250.0, 3)
