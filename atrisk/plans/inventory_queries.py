"""Registered queries of population, registry, tile, ledger and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrisk.functions import geom, norm
from atrisk.operators import population, registry_jobs, store
from atrisk.plans.exposure_queries import _BANDED, _LATEST, _RUNS, _STATE, _as_of, _rounded
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx
from atrisk.streaming import usage

BANDS, ASSETS = fx.BANDS, fx.ASSETS_SQL

# Samples are banded like assets: their id is the cell's with the sample's number.
_SHARES = f"""a as (select cell_id || '/' || (i * 10 + j) as id, cell_id, population, x0 + (i + 0.5::double) / 10.0::double * 0.01::double as lon, y0 + (j + 0.5::double) / 10.0::double * 0.01::double as lat
  from {fx.GRID_SQL} g, range(10) s(i), range(10) t(j)), {_BANDED},
shares as (select cell_id, population, band_index, count(*) / 100.0::double as share from banded group by all)"""


def _shares(spark, sf_dir):
    return population.band_shares(fx.pop_grid(spark, sf_dir), BANDS)


@query("j9_sampled_overlay", f"with {_SHARES} select cell_id, band_index, round(share, 6) as share from shares where band_index is not null")
def j9(spark, sf_dir):
    return _rounded(_shares(spark, sf_dir).filter("band_index is not null").select("cell_id", "band_index", "share"), share=6)


@query("a6_population_total", f"with {_SHARES} select round(sum(population * share), 3) as people, count(*) as cells, max(population) as peak from (select cell_id, population, least(sum(share), 1.0::double) as share from shares where band_index is not null group by 1, 2)")
def a6(spark, sf_dir):
    return _rounded(population.total(_shares(spark, sf_dir)), people=3)


@query("a7_population_by_band", f"with {_SHARES} select band_index, round(sum(population * share), 3) as people, count(*) as cells from shares where band_index is not null group by 1")
def a7(spark, sf_dir):
    return _rounded(population.by_band(_shares(spark, sf_dir)), people=3)


@query("o4_densest_cells", f"select cell_id, population from {fx.GRID_SQL} order by population desc, cell_id limit 5000")
def o4(spark, sf_dir):
    return fx.pop_grid(spark, sf_dir).select("cell_id", "population").orderBy(F.desc("population"), "cell_id").limit(5000)


# Livestock units a head by species.
UNITS = {"bovine": 0.8, "dairy": 1.0, "horse": 0.8, "swine": 0.3, "sheep": 0.1, "goat": 0.1, "rabbit": 0.02, "poultry": 0.01}
_SPECIES = "[" + ", ".join(f"'{s}'" for s in UNITS) + "]"
_UNIT = "case species " + " ".join(f"when '{k}' then {v}::double" for k, v in UNITS.items()) + " end"


@query(
    "a9_holdings",
    f"""with m as (select holding, species, max(heads) * {_UNIT} as units from (select l_orderkey as holding, {_SPECIES}[l_suppkey % {len(UNITS)} + 1] as species, l_quantity * 10 as heads from lineitem where l_returnflag <> 'R') group by 1, 2)
    select holding, round(sum(units), 4) as units, max_by(species, (units, species)) as dominant, count(*) filter (units > 0) > 1 as mixed from m group by 1""",
)
def a9(spark, sf_dir):
    species = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("l_suppkey") % len(UNITS) + 1).cast("int"))
    heads = fx.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("holding"), species.alias("species"), (F.col("l_quantity") * 10).alias("heads"), (F.col("l_returnflag") != "R").alias("active"))
    return _rounded(registry_jobs.holdings(heads, UNITS), units=4)


@query("j4_headcount", "select c_custkey as code, students, round(students * 1.12::double)::bigint as people from customer left join (select o_custkey, sum(o_orderkey % 400)::bigint as students from orders group by 1) on c_custkey = o_custkey")
def j4(spark, sf_dir):
    places = fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    return registry_jobs.with_headcount(places, fx.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), (F.col("o_orderkey") % 400).alias("students")), "code").select("code", "students", "people")


@query("r2_latest_edition", "select o_orderkey, year(o_orderdate)::int as edition from orders where year(o_orderdate) = (select max(year(o_orderdate)) from orders)")
def r2(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("edition"))
    return registry_jobs.latest_edition(rows, "edition").select("o_orderkey", "edition")


_FOLD = lambda c: f"trim(regexp_replace(lower(replace(strip_accents({c}), '·', '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


@query("n2_text_keys", f"select conv_id, turn, md5({_FOLD('text')}) as text_key from conversations")
def n2(spark, sf_dir):
    return fx.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(norm.folded(F.col("text"))).alias("text_key"))


# Names as registries spell them, with their keys.
SPELT = [("Hospital de Sant Joan de Déu, S.A.", "deu hospital joan sant"), ("Instal·lacions esportives d'Žižek", "esportives installacions zizek"), ("FUNDACIÓ L’Escola i Lleure SCCL", "escola lleure"), ("Школа № 5", "no школа"), ("Ακαδημία Αθηνών", "αθηνων ακαδημια"), ("Cap de la Vila 2a", "2a cap vila"), (" de la ", "")]


@query("n2_name_keys", f"select p_partkey as k, [{', '.join(repr(b) for _, b in SPELT)}][p_partkey % {len(SPELT)} + 1] as name_key from part")
def n2_names(spark, sf_dir):
    name = F.element_at(F.array(*(F.lit(a) for a, _ in SPELT)), (F.col("p_partkey") % len(SPELT) + 1).cast("int"))
    return fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), norm.name_key(name).alias("name_key"))


@query("n4_emails", f"select doc_id, found[1] as first_email, len(found)::int as emails from (select doc_id, list_transform(regexp_extract_all(text, '{registry_jobs.EMAIL}'), lambda x: lower(x)) as found from documents)")
def n4(spark, sf_dir):
    found = F.transform(F.regexp_extract_all("text", F.lit(registry_jobs.EMAIL), F.lit(0)), F.lower)
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", found.alias("found"), registry_jobs.emails(F.col("text")).alias("distinct_found"))
    return docs.select("doc_id", F.get("distinct_found", F.lit(0)).alias("first_email"), F.when(F.col("found").isNotNull(), F.size("found")).alias("emails"))


# Rules over the part names, first match.
RULES = [(("small", "tiny"), "minor"), (("ring", "bolt", "gear"), "fitting"), (("large", "big"), "major")]
_CLASS = "case " + " ".join(f"when list_has_any(w, [{', '.join(repr(t) for t in tokens)}]) then '{name}'" for tokens, name in RULES) + " else 'other' end"


@query("c1_rule_classifier", f"select p_partkey, {_CLASS} as class from (select p_partkey, string_split({_FOLD('p_name')}, ' ') as w from part)")
def c1(spark, sf_dir):
    return fx.read(spark, sf_dir, "part").select("p_partkey", registry_jobs.classify(F.col("p_name"), RULES, "other").alias("class"))


@query("u4_delete_source", f"select id, source_id from {ASSETS} where not (source_id = 'osm' or province = 'teruel')")
def u4(spark, sf_dir):
    return store.delete_where(fx.assets(spark, sf_dir), (F.col("source_id") == "osm") | (F.col("province") == "teruel")).select("id", "source_id")


_TILE = "'0.05/' || floor(lon / 0.05::double)::bigint || '/' || floor(lat / 0.05::double)::bigint"
_FRESH = f"(select tile_key from (select tile_key, {_STATE} as state from ({_LATEST})) where state = 'fresh')"


def _tiled(spark, sf_dir):
    return fx.assets(spark, sf_dir).select("id", "name", "source_ref", "lon", "lat", geom.tile_key(F.col("lon"), F.col("lat")).alias("tile_key"))


def _fresh(spark, sf_dir):
    return store.tile_states(fx.tile_ledger(spark, sf_dir), _as_of()).filter("state = 'fresh'").select("tile_key")


@query("u3_replace_by_tile", f"with a as (select id, name, source_ref, {_TILE} as tile_key from {ASSETS}), f as {_FRESH} select id, name, tile_key from a where tile_key not in (select tile_key from f) union all select id, name || '*', tile_key from a where source_ref % 3 = 0 and tile_key in (select tile_key from f)")
def u3(spark, sf_dir):
    base = _tiled(spark, sf_dir).select("id", "name", "source_ref", "tile_key")
    batch = base.filter("source_ref % 3 = 0").withColumn("name", F.concat("name", F.lit("*")))
    return store.replace_tiles(base, batch, _fresh(spark, sf_dir)).select("id", "name", "tile_key")


@query("w4_trailing_requests", "select event_id, user_id as key, count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) as requests from events")
def w4(spark, sf_dir):
    return store.trailing_requests(fx.read(spark, sf_dir, "events"), 60)


@query("k2_block_plan", f"with t as (select distinct floor(lon / 0.05::double)::bigint as ix, floor(lat / 0.05::double)::bigint as iy from {ASSETS}), m as (select *, '0.05/' || ix || '/' || iy in (select tile_key from {_FRESH}) as fresh from t) select floor(ix / 4)::bigint as bix, floor(iy / 4)::bigint as biy, count(*) as tiles, sum((not fresh)::int)::bigint as to_fetch from m group by 1, 2 having not bool_and(fresh)")
def k2(spark, sf_dir):
    index = lambda c: geom.tile_index(F.col(c), 0.05).cast("long")
    tiles = _tiled(spark, sf_dir).select("tile_key", index("lon").alias("ix"), index("lat").alias("iy")).distinct()
    return store.block_plan(tiles, _fresh(spark, sf_dir), 4)


@query("a19_tile_counts", f"select tile_key, coalesce(n, 0) as assets, coalesce(m, 0) as fetches from (select {_TILE} as tile_key, count(*) as n from {ASSETS} group by 1) full join (select tile_key, count(*) as m from {fx.LEDGER_SQL} group by 1) using (tile_key)")
def a19(spark, sf_dir):
    assets = _tiled(spark, sf_dir).groupBy("tile_key").agg(F.count("*").alias("n"))
    fetches = fx.tile_ledger(spark, sf_dir).groupBy("tile_key").agg(F.count("*").alias("m"))
    return assets.join(fetches, "tile_key", "full").select("tile_key", F.coalesce("n", F.lit(0)).alias("assets"), F.coalesce("m", F.lit(0)).alias("fetches"))


@query("b1_distinct_sources", f"select source_id from {ASSETS} union select source_id from {fx.RUNS_SQL}")
def b1(spark, sf_dir):
    return fx.assets(spark, sf_dir).select("source_id").union(fx.source_runs(spark, sf_dir).select("source_id")).distinct()


@query("j13_source_catalogue", f"select source_id, coalesce(n, 0) as assets, coalesce(status, 'never_run') as status from (select distinct source_id from {fx.RUNS_SQL}) left join (select source_id, count(*) as n from {ASSETS} where province <> 'teruel' group by 1) using (source_id) left join {_RUNS} using (source_id)")
def j13(spark, sf_dir):
    runs = fx.source_runs(spark, sf_dir)
    counts = fx.assets(spark, sf_dir).filter("province != 'teruel'").groupBy("source_id").agg(F.count("*").alias("n"))
    joined = runs.select("source_id").distinct().join(counts, "source_id", "left").join(store.latest(runs, "source_id", "finished_at", "run_id", "status"), "source_id", "left")
    return joined.select("source_id", F.coalesce("n", F.lit(0)).alias("assets"), F.coalesce("status", F.lit("never_run")).alias("status"))


@query("j14_usage_by_key", "select coalesce(c_name, '(revoked or unknown)') as owner, count(*) as requests from events left join customer on user_id = c_custkey and c_custkey % 3 <> 0 group by 1")
def j14(spark, sf_dir):
    # requests are summed by key before the join
    used = fx.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    keys = fx.read(spark, sf_dir, "customer").filter("c_custkey % 3 != 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    owner = F.coalesce("c_name", F.lit("(revoked or unknown)")).alias("owner")
    return used.join(keys, "user_id", "left").groupBy(owner).agg(F.sum("n").alias("requests"))


@query("f9_coverage_sanity", f"select source_id, sum((lon between 1.6::double and 2.2::double and lat between 41.3::double and 41.9::double)::int)::bigint as kept, sum((not (lon between 1.6::double and 2.2::double and lat between 41.3::double and 41.9::double))::int)::bigint as dropped from {ASSETS} group by 1")
def f9(spark, sf_dir):
    inside = geom.in_envelope(F.col("lon"), F.col("lat"), (1.6, 41.3, 2.2, 41.9))
    return fx.assets(spark, sf_dir).groupBy("source_id").agg(F.sum(inside.cast("long")).alias("kept"), F.sum((~inside).cast("long")).alias("dropped"))


@query("r10_snapshot_counts", f"select 'assets' as name, count(*) as n from {ASSETS} union all select 'tiles', count(*) from {fx.LEDGER_SQL} union all select 'cells', count(*) from {fx.GRID_SQL}")
def r10(spark, sf_dir):
    tables = {"assets": fx.assets(spark, sf_dir), "tiles": fx.tile_ledger(spark, sf_dir), "cells": fx.pop_grid(spark, sf_dir)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("x1_tile_ledger_stream", f"select tile_key, fetched_at, status, {_STATE} as state from ({_LATEST})")
def x1(spark, sf_dir):
    return store.state_of(usage.latest_outcomes(fx.ledger_rows(usage.events(spark, sf_dir))), _as_of())


@query("x3_daily_usage_stream", "select user_id as key, ts::date as day, count(*) as used, count(*) > 3 as over from events group by 1, 2")
def x3(spark, sf_dir):
    return usage.daily_usage(usage.events(spark, sf_dir), 3)
