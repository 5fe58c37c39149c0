"""Registered queries of whole registry records, over texts as the registries write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrisk.operators import registers
from atrisk.plans.registry import query
from atrisk.plans.rule_queries import _pick, _sql_pick
from atrisk.sources import fixtures as fx

# Texts as a registry has them, each with the class that a reader expects.
SERVICES = [("Residència assistida per a gent gran", "care_home"), ("Centre de dia", "day_centre"), ("Llar residència per a persones amb discapacitat", "disability_home"), ("Servei d'ajuda a domicili", None), ("Pis amb suport: malaltia mental", "mental_health"), ("Llar residència gent gran i discapacitat", "care_home"), ("CENTRE DE DIA per a infants", "day_centre")]
PLACES = [("Turisme|Albergs", "hostel"), ("Turisme|Hotels", "hotel"), ("Comerç|Mercats municipals", "market"), ("Medi ambient|Deixalleries", "waste_facility"), ("Medi ambient|DEPURADORES", "wastewater"), ("Medi ambient|Parcs i jardins", "park"), ("Cultura|Cinemes", "attraction"), ("Cementiris", "other"), ("res de tot això", "other")]


def _classes(pairs) -> str:
    return "[" + ", ".join("null" if c is None else f"'{c}'" for _, c in pairs) + f"][p_partkey % {len(pairs)} + 1]"


@query("n8_service_records", f"""select * from (select 'S' || p_partkey as source_ref, {_classes(SERVICES)} as subcategory, 'Casa Numero ' || p_partkey as name, case when p_partkey % 2 = 0 then 'C/ Nou ' || p_partkey end as street, case when p_partkey % 3 > 0 then 'Girona' end as municipality, 'Fundació Nova' as operator, nullif(p_size, 1)::double as people, true as needs_geocoding from part) where subcategory is not null""")
def n8(spark, sf_dir):
    k = F.col("p_partkey")
    key = k.cast("string")
    rows = fx.read(spark, sf_dir, "part").select(
        F.concat(F.lit(" S"), key).alias("registre"), _pick([t for t, _ in SERVICES], k).alias("tipologia"), F.concat(F.lit("CASA  NUMERO "), key).alias("nom"), F.when(k % 2 == 0, F.concat(F.lit("C/ Nou "), key)).otherwise(" ").alias("adreca"),
        F.when(k % 3 > 0, "GIRONA").alias("municipi"), F.lit("FUNDACIÓ NOVA").alias("entitat_titular"), F.when(F.col("p_size") > 1, F.col("p_size").cast("string")).otherwise("n/a").alias("capacitat"),
    )
    out = registers.social_services(rows)
    return out.select("source_ref", "subcategory", "name", "address.street", "address.municipality", "contacts.operator", "capacity.people", "needs_geocoding")


@query("n9_facility_records", f"""select p_partkey::varchar as source_ref, {_classes(PLACES)} as subcategory, 'Punt Numero ' || p_partkey as name, 'Carrer Nou ' || p_partkey as street, round(1 + (p_partkey % 1000) / 1000.0::double, 6) as lon, 41.5::double as lat,
  case when p_partkey % 4 = 0 then [] else ['+34' || (900000000 + p_partkey % 90000000), '+33145678901'] end as phone, ['info' || p_partkey || '@punt.cat'] as email, 'https://punt.cat/' || p_partkey as website from part where p_partkey % 9 > 0""")
def n9(spark, sf_dir):
    k = F.col("p_partkey")
    key = k.cast("string")
    rows = fx.read(spark, sf_dir, "part").select(
        key.alias("idequipament"), _pick([t for t, _ in PLACES], k).alias("categoria"), F.concat(F.lit("PUNT NUMERO "), key).alias("alies"), F.lit("Carrer").alias("tipus_via"), F.lit("Nou").alias("via"), key.alias("num"),
        F.when(k % 9 > 0, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).alias("longitud"), F.lit("41.5").alias("latitud"), F.when(k % 4 > 0, (k % 90000000 + 900000000).cast("string")).alias("telefon1"), F.when(k % 4 > 0, "0033 1 45 67 89 01").alias("telefon2"),
        F.concat(F.lit("Correu: INFO"), key, F.lit("@punt.cat")).alias("email"), F.concat(F.lit("punt.cat/"), key).alias("web"),
    )
    out = registers.facilities(rows)
    return out.select("source_ref", "subcategory", "name", "address.street", F.round("lon", 6).alias("lon"), "lat", "contacts.phone", "contacts.email", "contacts.website")


_KINDS = ["ESCOLA NUMERO", "ESCOLA BRESSOL", "ESCOLA ADULTS"]


@query("n7_school_records", f"""with e as (select l_partkey as k, sum(l_quantity)::double as students, count(*)::double as units from lineitem where l_linenumber % 2 = 0 group by 1)
select p_partkey::varchar as source_ref, case when p_partkey % 3 = 1 then 'nursery' when p_partkey % 4 = 0 then 'secondary_school' when p_partkey % 4 = 1 then 'primary_school' when p_partkey % 3 = 2 then 'vocational' else 'school' end as subcategory,
  {_sql_pick([k.title() for k in _KINDS], 'p_partkey')} || ' ' || p_partkey as name, round(1 + (p_partkey % 1000) / 1000.0::double, 6) as lon, students, round_even(students * 1.12::double, 0)::bigint as people, units, 'enrolment 2023/24 + 12% staff' as basis
from part left join e on p_partkey = k where p_partkey % 5 > 0""")
def n7(spark, sf_dir):
    """Of two years the latest; a fifth of the schools is in the year before only."""
    k = F.col("p_partkey")
    key = k.cast("string")
    rows = fx.read(spark, sf_dir, "part").select(
        F.when(k % 5 > 0, "2023/24").otherwise("2022/23").alias("curs"), key.alias("codi_centre"), F.concat(_pick(_KINDS, k), F.lit(" "), key).alias("denominaci_completa"), F.when(k % 4 == 0, "S").alias("eso"), F.when(k % 4 < 2, "si").alias("epri"),
        F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0")).alias("coordenades_geo_x"), F.lit("41,5").alias("coordenades_geo_y"),
    )
    year = F.when(F.col("l_linenumber") % 2 == 0, "2023/24").otherwise("2022/23")
    counts = fx.read(spark, sf_dir, "lineitem").select(year.alias("curs"), F.col("l_partkey").cast("string").alias("codi_centre"), F.col("l_quantity").cast("double").cast("string").alias("matr_cules_total"), F.lit("1").alias("unitats"))
    out = registers.schools(rows, counts)
    basis = F.concat(F.lit("enrolment "), F.col("attributes.curs"), F.lit(" + 12% staff"))  # also of those without students
    return out.select("source_ref", "subcategory", "name", F.round("lon", 6).alias("lon"), "capacity.students", "capacity.people", F.col("attributes.units").alias("units"), F.coalesce("capacity.basis", basis).alias("basis"))
