"""Registered queries of whole merged records and their provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrisk.operators import merge
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx

_RANKS = "map {" + ", ".join(f"'{s}': {p}" for s, p in fx.SOURCES.items()) + "}"
_NAMES = "[" + ", ".join(f"'{s}'" for s in fx.SOURCES) + "]"

# Four neighbouring keys are one thing; the oracle numbers its records and reads them in order.
_R = f"""(select *, row_number() over (partition by cluster order by rank desc, conf desc, k) as n from (select c_custkey as k, c_custkey // 4 as cluster, {_NAMES}[c_custkey % {len(fx.SOURCES)} + 1] as src, {_RANKS}[{_NAMES}[c_custkey % {len(fx.SOURCES)} + 1]] as rank,
  (c_custkey % 5) * 0.08::double + 0.5::double as conf, case when c_custkey % 3 > 0 then c_name else '' end as name, case when c_custkey % 5 = 0 then ['own ' || c_custkey, 'p' || c_custkey // 8] when c_custkey % 5 < 4 then ['p' || c_custkey // 8] end as phone,
  case when c_custkey % 3 = 1 then 'http://w/' || c_custkey end as website, (c_custkey % 4)::double as beds, case when c_custkey % 2 = 0 then 'basis ' || c_custkey end as basis, case when c_custkey % 3 = 2 then (c_custkey % 900 + 50)::double end as footprint, c_mktsegment as segment, case when c_custkey % 4 <> 1 then 'street ' || c_custkey end as street from customer))"""


def _records(spark, sf_dir):
    k, none = F.col("c_custkey"), F.lit(None)
    key = k.cast("string")
    group = F.concat(F.lit("p"), F.floor(k / 8).cast("string"))
    source = F.element_at(F.array(*map(F.lit, fx.SOURCES)), (k % len(fx.SOURCES) + 1).cast("int"))
    rows = fx.read(spark, sf_dir, "customer").select(
        k.alias("doc_id"), source.alias("source_id"), k.cast("string").alias("source_ref"), F.when(k % 3 > 0, F.col("c_name")).otherwise("").alias("name"), F.lit("c").alias("category"), F.lit(2.0).alias("lon"), F.lit(41.0).alias("lat"),
        ((k % 5) * 0.08 + 0.5).alias("confidence"), F.when(k % 5 == 0, F.array(F.concat(F.lit("own "), key), group)).when(k % 5 < 4, F.array(group)).alias("phone"), none.cast("array<string>").alias("email"), F.when(k % 3 == 1, F.concat(F.lit("http://w/"), k.cast("string"))).alias("website"),
        none.cast("string").alias("operator"), *((k % 4).cast("double").alias(c) if c == "beds" else none.cast("double").alias(c) for c in merge.CAPACITIES), F.when(k % 2 == 0, F.concat(F.lit("basis "), k.cast("string"))).alias("basis"),
        F.create_map(F.lit("street"), F.when(k % 4 != 1, F.concat(F.lit("street "), key)), F.lit("country"), F.lit("ES")).alias("address"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attributes"),
        F.when(k % 3 == 2, (k % 900 + 50).cast("double")).alias("footprint_m2"), F.when(k % 3 == 2, "footprint").otherwise("point").alias("geometry_kind"), none.cast("double").alias("floors"),
    )
    return rows, rows.select("doc_id", F.floor(F.col("doc_id") / 4).alias("cluster"))


@query("e5_whole_records", f"""with r as {_R},
ph as (select cluster, list(v order by n, i) as phone from (select cluster, v, min(n) as n, arg_min(i, (n, i)) as i from (select cluster, n, unnest(phone) as v, unnest(range(len(phone))) as i from r) group by 1, 2) group by 1),
att as (select cluster, list(key || '=' || segment order by key) as attributes from (select cluster, case when n = 1 then 'segment' else src || ':segment' end as key, arg_min(segment, n) as segment from r group by 1, 2) group by 1)
select r.cluster, arg_min(k, n) as doc_id, arg_min(name, n) filter (name <> '') as name, coalesce(any_value(phone_.phone), []) as phone, arg_min(website, n) filter (website is not null) as website, arg_min(beds, n) filter (beds > 0) as beds,
  coalesce(any_value(basis) filter (n = 1), (arg_min({{'b': basis}}, n) filter (beds > 0)).b) as basis, arg_min(footprint, n) filter (footprint is not null) as footprint_m2, case when bool_or(footprint is not null) then 'footprint' else 'point' end as geometry_kind,
  arg_min(street, n) filter (street is not null) as street, count(*) as merged_count, round(least(0.98::double, any_value(conf) filter (n = 1) + (count(*) - 1) * 0.06::double), 3) as confidence, any_value(att.attributes) as attributes
from r left join ph as phone_ using (cluster) left join att using (cluster) group by 1""")
def e5_whole(spark, sf_dir):
    out = merge.merged_records(*_records(spark, sf_dir), fx.SOURCES)[0]
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("cluster", "doc_id", "name", "phone", "website", "beds", "basis", "footprint_m2", "geometry_kind", F.col("address")["street"].alias("street"), "merged_count", "confidence", F.array_sort(pairs).alias("attributes"))


_FIRST = " union all ".join(f"select cluster, arg_min(k, n) as k, '{f}' as field from r where {t} group by 1" for f, t in [("name", "name <> ''"), ("contacts.website", "website is not null"), ("capacity.beds", "beds > 0"), ("footprint_m2", "footprint is not null"), ("address.street", "street is not null"), ("address.country", "true")])


@query("e6_provenance", f"""with r as {_R}, w as ({_FIRST} union all select cluster, arg_min(k, n), 'contacts.phone' from (select cluster, k, n, unnest(phone) as v from r) group by cluster, v),
g as (select cluster, k, list_sort(list(distinct field)) as fields from w group by 1, 2)
select cluster, k as doc_id, src as source_id, case when n = 1 then ['identity', 'geometry'] else coalesce(fields, ['corroboration']) end as fields from r left join g using (cluster, k)""")
def e6(spark, sf_dir):
    return merge.merged_records(*_records(spark, sf_dir), fx.SOURCES)[1].drop("source_ref")
