"""Registered queries of file scans and of whole registry records; the files are written by
Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from atrisk.operators import holdings, landed
from atrisk.operators.shared import shared_dir
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx
from atrisk.sources import scans


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("r1_json_pages", "select o_orderkey as ref, o_custkey as cust, o_orderpriority as priority from orders")
def r1(spark, sf_dir):
    # pages of about 2000 keys, of which the first 100 stand at the end of the page before, too
    o = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority"))
    page = F.floor(F.col("ref") / 2000)
    overlap = o.filter("ref % 2000 < 100 and ref >= 2000").withColumn("page", page - 1)
    path = _folder(spark, "pages")
    o.withColumn("page", page).unionByName(overlap).write.partitionBy("page").json(path)
    return scans.json_pages(spark, path, "ref bigint, cust bigint, priority string", "ref")[0]


_HOME = "(select c_custkey as k, 'p' || (c_custkey // 1000) as part, (c_custkey // 1000) % 2 = 0 as even from customer)"


def _care_home_files(spark, sf_dir):
    """A file per 1000 customers in ISO-8859-1: two banner lines, a header whose columns change
    places with the file, decimal commas, some cells quoted."""
    k = F.col("c_custkey")
    c = fx.read(spark, sf_dir, "customer").select(k.alias("k"), F.floor(k / 1000).alias("n"))
    even, key = F.col("n") % 2 == 0, F.col("k").cast("string")
    name = F.concat(F.lit('"Residència ""'), key, F.lit('""; annex"'))
    lon = F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("1,"), F.lpad((F.col("k") % 1000).cast("string"), 3, "0"), F.lit("5")))
    places = (F.col("k") % 120).cast("string")
    row = F.when(even, F.concat_ws(";", name, F.lit("C/"), F.lit("Major"), key, F.lit("Lleida"), places, F.lit("41,5"), lon)).otherwise(F.concat_ws(";", lon, F.lit("41,5"), places, F.lit("Girona"), name, F.lit("900 123 456")))
    body = c.select("n", (F.col("k") + 3).alias("line"), row.alias("text"))
    header = F.when(even, "Denominación;Vía;Nombre vía;Núm. vía;Municipio;Plazas;Latitud;Longitud").otherwise("Longitud;Latitud;Plazas;Municipio;Denominación;Teléfono")
    files = c.select("n").distinct()
    top = files.select("n", F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("line"), t.alias("text")) for i, t in enumerate((F.lit("Informes"), F.lit("Recursos en España"), header))))))
    path = _folder(spark, "homes")
    lines = body.unionByName(top.withColumn("line", F.col("line") - 10)).withColumn("province", F.concat(F.lit("p"), F.col("n").cast("string")))
    lines.repartition("province").sortWithinPartitions("province", "line").select("text", "province").write.partitionBy("province").options(encoding="ISO-8859-1", sep="\u0001", quote="", escapeQuotes="false").csv(path)
    return scans.delimited(spark, path, holdings.CARE_HOME_FIELDS, mark="Denominaci", part="province=([^/]+)/")


@query("r4_delimited_files", f"select part, 'Residència \"' || k || '\"; annex' as name, (k % 120)::varchar as places, case when k % 10 > 0 then '1,' || lpad((k % 1000)::varchar, 3, '0') || '5' end as lon, case when even then 'Lleida' else 'Girona' end as municipality, case when not even then '900 123 456' end as phone, false as irregular from {_HOME}")
def r4(spark, sf_dir):
    return _care_home_files(spark, sf_dir)[0].select("part", "name", "places", "lon", "municipality", "phone", "irregular")


@query("r4_file_report", "select true as has_header, 0::bigint as irregular, count(*) as rows from customer group by c_custkey // 1000")
def r4_report(spark, sf_dir):
    return _care_home_files(spark, sf_dir)[1].drop("file")


@query("n14_care_home_records", f"""select part || '|Residència "' || k || '"; annex|' || case when even then 'Lleida' else 'Girona' end as source_ref, case when even then 'C/ Major ' || k end as street, case when k % 10 > 0 then 1 + (k % 1000 * 10 + 5) / 10000.0::double end as lon, case when k % 10 > 0 then 41.5::double end as lat,
  nullif(k % 120, 0)::double as places, case when k % 120 > 0 then round_even((k % 120) * 1.33::double, 0)::bigint end as people, case when even then [] else ['+34900123456'] end as phone, k % 10 = 0 as needs_geocoding from {_HOME}""")
def n14(spark, sf_dir):
    homes = holdings.care_homes(_care_home_files(spark, sf_dir)[0])
    return homes.select("source_ref", "address.street", F.round("lon", 6).alias("lon"), "lat", "capacity.places", "capacity.people", "contacts.phone", "needs_geocoding")


@query("r6_gazetteer_file", """with e as (select unnest(list_distinct([lower(n_name), 'sant ' || lower(n_name), 'shared'])) as name, n_nationkey as k, n_nationkey % 3 as rank from nation where n_nationkey % 4 > 0),
  b as (select name, min_by(k, (rank, k)) as k from e group by 1) select name, 1.5::double + k * 0.01::double as lon, 41.25::double + k * 0.01::double as lat from b""")
def r6_file(spark, sf_dir):
    k = F.col("n_nationkey")
    code = F.when(k % 4 == 0, "ADM1").otherwise(F.element_at(F.array(F.lit("ADM3"), F.lit("PPLA"), F.lit("PPL")), (k % 3 + 1).cast("int")))
    number = lambda base: F.round(k * 0.01 + base, 4).cast("string")
    row = F.concat_ws("\t", k.cast("string"), F.initcap("n_name"), "n_name", F.concat(F.lit('Sant "'), F.lower("n_name"), F.lit('",ab,Shared')), number(41.25), number(1.5), F.lit("P"), code, *(F.lit("") for _ in range(8)))
    path = _folder(spark, "places")
    fx.read(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1).select(row.alias("value")).write.text(path)
    return scans.gazetteer_lines(spark, path)


@query("r7_element_files", """with e as (select o_orderkey as k, o_orderkey // 4000 as file, case when o_orderkey % 2 = 0 then 'way' else 'node' end as kind, o_custkey as id, o_orderkey % 6 = 0 as shaped from orders)
select kind, id, arg_min(k, (not shaped, lpad(file::varchar, 9, '0'), k)) as number, case when bool_or(shaped) then 3 else 0 end as points from e group by 1, 2""")
def r7_files(spark, sf_dir):
    k, v = F.col("o_orderkey"), lambda x, y: F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon"))
    shape = F.when(k % 6 == 0, F.array(v(2.0, 41.0), v(2.1, 41.0), v(2.0, 41.1)))
    e = F.struct(k.alias("order"), F.when(k % 2 == 0, "way").otherwise("node").alias("type"), F.col("o_custkey").alias("id"), F.create_map(F.lit("ref"), k.cast("string")).alias("tags"), shape.alias("geometry"))
    docs = fx.read(spark, sf_dir, "orders").groupBy(F.lpad(F.floor(k / 4000).cast("string"), 9, "0").alias("part")).agg(F.array_sort(F.collect_list(e), lambda a, b: (a["order"] - b["order"]).cast("int")).alias("elements"))
    path = _folder(spark, "elements")
    docs.write.partitionBy("part").json(path)
    found = landed.elements(scans.map_elements(spark, path))
    return found.select("kind", "id", F.col("tags.ref").cast("long").alias("number"), F.coalesce(F.size("geometry"), F.lit(0)).alias("points"))


# Names as a registry writes them, each with the group and the units a head that a reader expects.
_SPECIES = [("Boví de carn", "cattle", 0.8), ("PORCÍ", "pigs", 0.3), ("Galls dindi", "poultry", 0.03), ("Gallines", "poultry", 0.01), ("Ànecs", "poultry", 0.014), ("Perdius", "poultry", 0.005), ("Estruços", "poultry", 0.1), ("Ovella i oví", "sheep_goats", 0.1), ("Cabrum", "sheep_goats", 0.1), ("Èquids", "horses", 0.8), ("Conills", "rabbits", 0.02), ("Abelles", "apiculture", 0.0), ("Aqüicultura", "aquaculture", 0.0), ("Gossos", "animal_shelter", 0.0), ("Altres", "mixed_livestock", 0.3)]
_OF = ", ".join(f"({i}, '{n}', '{g}', {u}::decimal(4,3))" for i, (n, g, u) in enumerate(_SPECIES))


@query("n10_livestock", f"""with r as (select l_orderkey as k, l_linenumber as line, l_suppkey % {len(_SPECIES)} as i, l_quantity::double as heads from lineitem where l_returnflag <> 'R' and l_orderkey % 7 > 0),
m as (select k, i, max(heads) as heads, min((line, i)) as line from r group by 1, 2),
j as (select m.k, m.line, name, grp, heads, heads::decimal(20,3) * unit as units from m join (values {_OF}) s(i, name, grp, unit) using (i)),
g as (select k, grp, sum(units) as units, min(line) as line from j group by 1, 2),
d as (select k, arg_min(grp, (-units, line)) as dominant, count(*) filter (units > 0) as n from g group by 1)
select 'ES' || k as source_ref, case when n > 1 then 'mixed_livestock' else dominant end as subcategory, dominant as dominant_group, nullif(heads, 0) as animals, units as livestock_units, names as species, rows as sub_exploitations, 'Mas ' || k || '-' || first as name, round(1 + (k % 60) / 60.0::double, 6) as lon, 41.5::double as lat
from d join (select k, round(sum(heads))::bigint as heads, round(sum(units), 1)::double as units, list_sort(list(name)) as names from j group by 1) using (k) join (select k, count(*) as rows, min(line) as first from r group by 1) using (k)""")
def n10(spark, sf_dir):
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    name = F.element_at(F.array(*(F.lit(n) for n, _, _ in _SPECIES)), (F.col("l_suppkey") % len(_SPECIES) + 1).cast("int"))
    none, text = F.lit(None).cast("string"), lambda c: c.cast("string")
    rows = fx.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" ES"), text(k)).alias("codi_rega"), F.when(F.col("l_returnflag") == "R", "Baixa").when(F.col("l_returnflag") == "A", "ACTIVA ").alias("estat_explotaci_"), name.alias("esp_cie"),
        F.replace(text(F.col("l_quantity").cast("double")), F.lit("."), F.lit(",")).alias("total_ub"), F.when(k % 7 > 0, "41.0º 30.0' 0.0''").alias("latitud"), F.when(k % 7 > 0, F.concat(F.lit("1.0º "), text(k % 60), F.lit(".0' 0.0''"))).alias("longitud"),
        F.concat(F.lit("Mas "), text(k), F.lit("-"), text(line)).alias("nom_explotaci"), *(none.alias(c) for c in holdings.HOLDING_TEXTS if c not in ("latitud", "longitud", "nom_explotaci")), F.struct(line, F.col("l_suppkey") % len(_SPECIES)).alias("position"),  # a line number may repeat
    )
    out = holdings.livestock(rows)
    return out.select("source_ref", "subcategory", "attributes.dominant_group", "capacity.animals", F.coalesce("capacity.livestock_units", F.lit(0.0)).alias("livestock_units"), "attributes.species", "attributes.sub_exploitations", "name", F.round("lon", 6).alias("lon"), "lat")
