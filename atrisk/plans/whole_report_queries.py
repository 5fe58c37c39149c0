"""Registered queries of the whole report's parts; without conflation, which is beyond SQL, they
have oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrisk.operators import report
from atrisk.plans.clip_queries import _ADDED, _CLIPPED, _METRES
from atrisk.plans.exposure_queries import _BANDED, _SCORED, _SUMMARY, _rounded
from atrisk.plans.registry import query
from atrisk.plans.report_queries import _vertices
from atrisk.sources import fixtures as fx

BANDS = fx.BANDS
REGION, COUNTRY = (0.1, 40.5, 3.4, 42.9), (-9.5, 35.9, 4.4, 43.9)
#: What of a page of assets is shown, and the limits of lists in these queries.
ASSETS, CELLS = 150, 400


def _table(spark, sf_dir):
    return report.scored(fx.assets(spark, sf_dir), BANDS, None, ["all"])


def _build(spark, sf_dir, priority=None):
    assets = fx.twice_registered(fx.assets(spark, sf_dir)) if priority else fx.assets(spark, sf_dir)
    return report.build(assets, BANDS, cells=fx.pop_grid(spark, sf_dir), lines=_vertices(spark, sf_dir), priority=priority, max_assets=ASSETS, max_cells=CELLS, regional=REGION, national=COUNTRY)


_INSIDE = f"{_SCORED}, inside as (select * from scored where inside_aoi)"
_RESIDENTS = f"people as (with {_ADDED} select band_index, sum(population * share) as residents from added where share > 1e-12 group by 1)"


@query("v17_report_bands", f"""with {_INSIDE}, {_RESIDENTS}, each as (select band_index, category, count(*) as n, sum(total_eur) as v, sum(people) as p, sum(critical::int) as c, sum(hazardous::int) as h from inside group by 1, 2),
b as (select * from (values (0, '1h', 60.0::double), (1, '3h', 180.0::double), (2, '6h', 360.0::double)) t(band_index, band, minutes)),
m as (select band_index, sum(n)::bigint as assets, sum(p) as people, sum(v) as value_eur, sum(c)::bigint as critical, sum(h)::bigint as hazardous, string_agg(category || '=' || n, ',' order by category) as by_category, count(*) filter (v <> 0) as valued from each group by 1)
select band_index, band, minutes, coalesce(assets, 0) as assets, coalesce(people, 0) as people, round(coalesce(value_eur, 0), 0) as value_eur, coalesce(critical, 0) as critical, coalesce(hazardous, 0) as hazardous, coalesce(by_category, '') as by_category, coalesce(valued, 0) as valued, round(coalesce(residents, 0), 3) as residents
from b left join m using (band_index) left join people using (band_index)""")
def bands(spark, sf_dir):
    parts = report.band_parts(_table(spark, sf_dir), BANDS, report.residents(fx.pop_grid(spark, sf_dir), BANDS))
    pairs = F.transform(F.map_entries("by_category"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    out = parts.withColumns({"by_category": F.array_join(pairs, ","), "valued": F.size("value_by_category").cast("long")})
    return _rounded(out.drop("area_km2", "value_by_category"), value_eur=0, residents=3)


@query("v17_report_summary", f"""with {_INSIDE}, {_RESIDENTS}, s as ({_SUMMARY.replace('from scored', 'from inside')})
select s.*, 0::bigint as merged, (select round(sum(residents), 3) from people) as residents, 'regional' as coverage from s""")
def summary(spark, sf_dir):
    shares = report.residents(fx.pop_grid(spark, sf_dir), BANDS)
    out = report.totals(_table(spark, sf_dir), BANDS, shares, report.regime(BANDS, REGION, COUNTRY))
    return _rounded(out.drop("area_km2"), value_eur=0, residents=3)


@query("v17_report_page", f"with {_INSIDE}, r as (select id, category, round(priority, 5) as priority, row_number() over (order by priority desc, id) as position from inside) select id, category, priority, position::int as position, (select count(*) from r) > {ASSETS} as truncated from r where position <= {ASSETS}")
def page(spark, sf_dir):
    out = report.page(_table(spark, sf_dir), "priority", ASSETS)
    return _rounded(out.select("id", "category", "priority", "position", "truncated"), priority=5)


_LISTED = f"""inside as (with {_ADDED} select cell_id, least(1.0::double, sum(share)) as share from added where share > 1e-12 group by 1),
g as (select cell_id as id, population, x0 + 0.01::double / 2 as lon, y0 + 0.01::double / 2 as lat, share from {fx.GRID_SQL} join inside using (cell_id)),
a as (select * from g order by population desc, id limit {CELLS}), {_BANDED}"""


@query("v17_population_report", f"with {_LISTED} select id as cell_id, population, round(share, 6) as share, round(population * share, 3) as people, band_index, (select count(*) from g) > {CELLS} as truncated from banded")
def population(spark, sf_dir):
    out = report.population_report(fx.pop_grid(spark, sf_dir), BANDS, CELLS)[1]
    return _rounded(out, share=6, people=3)


@query("v17_report_networks", f"with {_CLIPPED.replace('band = 1', 'band = 2')} select kind, round(sum({_METRES}) / 1000, 3) as km, count(distinct id) as lines from l group by 1")
def networks(spark, sf_dir):
    """Within the union of the bands, of which the last holds the others."""
    return _rounded(report.network_parts(_vertices(spark, sf_dir), BANDS), km=3)


@query("v17_report_warnings", f"""with {_INSIDE}, f as (select (select count(*) from inside) as n, (with {_ADDED} select count(distinct cell_id) from added where share > 1e-12) as c)
select 0 as position, 'capped' as code, 'the list ends after {ASSETS} of ' || n || ' assets; totals count all' as message from f where n > {ASSETS}
union all select 2, 'cells', 'the {CELLS} densest of ' || c || ' cells are listed; totals count all' from f where c > {CELLS}
union all select 3, 'no grid', 'no population grid covers this area' from f where c = 0""")
def warnings(spark, sf_dir):
    return _build(spark, sf_dir).warnings


# Conflation is beyond SQL; tests hold the parts against its clusters.
@query("v17_conflated_report")
def conflated(spark, sf_dir):
    """The whole report on twice registered assets: one row of figures for each part."""
    r = _build(spark, sf_dir, fx.SOURCES)
    parts = [
        r.summary.select(F.lit("summary").alias("part"), F.lit("all").alias("key"), F.col("asset_count").alias("count"), F.col("people").cast("double").alias("people"), F.col("value_eur").alias("figure")),
        r.summary.select(F.lit("merged"), F.lit("all"), "merged", F.lit(None).cast("double"), F.lit(None).cast("double")),
        r.bands.select(F.lit("band"), "band", "assets", F.col("people").cast("double"), "value_eur"),
        r.categories.select(F.lit("category"), "category", "assets", F.col("people").cast("double"), "value_eur"),
        r.networks.select(F.lit("network"), F.col("kind").cast("string"), "lines", F.lit(None).cast("double"), "km"),
        r.cells.groupBy(F.col("band_index").cast("string")).agg(F.count("*").alias("n"), F.sum("people").alias("people"), F.max("population").alias("most")).select(F.lit("cells"), "band_index", "n", "people", "most"),
        r.warnings.select(F.lit("warning"), "message", F.col("position").cast("long"), F.lit(None).cast("double"), F.lit(None).cast("double")),
        r.top.select(F.lit("top"), "id", F.col("position").cast("long"), F.col("people").cast("double"), "priority"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return _rounded(out, people=1, figure=2)
