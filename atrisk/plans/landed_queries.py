"""Registered queries of landed tables, contacts, map elements and warnings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from atrisk.functions import tag_rules
from atrisk.operators import landed, store
from atrisk.operators.shared import dealt, written
from atrisk.plans.clip_queries import _IDS
from atrisk.plans.exposure_queries import _rounded
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx

ASSETS = fx.ASSETS_SQL

# A file per customer remainder, its banner one to three lines high; columns change places with the file.
_FIELDS = {"name": ("denominacion", "nombre"), "town": ("municipio",), "seats": ("plazas",)}


def _messy(spark, sf_dir):
    k, file = F.col("c_custkey"), F.col("c_custkey") % 40
    body = fx.read(spark, sf_dir, "customer").select(file.alias("file"), (F.col("c_custkey") + 20).alias("line"), "c_name", (k % 90).cast("string").alias("seats"))
    text = lambda *v: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in v))
    none = F.lit(None).cast("string")
    row = F.when(F.col("file") % 2 == 0, text("ES", "x", F.col("c_name"), F.col("seats"), " Lleida ")).otherwise(text(F.col("c_name"), " Girona", "x", "", F.col("seats")))
    body = body.select("file", "line", row.alias("cells"))
    files = body.select("file").distinct()
    names = F.when(F.col("file") % 2 == 0, text("País", "Codi", "Denominación ", "Número de plazas", "Municipio")).otherwise(text("NOMBRE", "Municipio", "Codi", "Tel.", "Altres"))
    head = files.select("file", (F.col("file") % 3 + 1).alias("line"), names.alias("cells"))
    banner = files.select("file", F.lit(0).cast("long").alias("line"), F.array(F.lit("Registre"), none, none, none, none).alias("cells"))
    return body.unionByName(head).unionByName(banner)


@query("r3_messy_table", "select c_custkey % 40 as file, c_custkey + 20 as line, c_name as name, case when c_custkey % 2 = 0 then 'Lleida' else 'Girona' end as town, case when c_custkey % 2 = 0 then (c_custkey % 90)::varchar end as seats from customer")
def r3(spark, sf_dir):
    return landed.messy_table(_messy(spark, sf_dir), _FIELDS)


_NAMED = f"select * from ({_IDS}) where id % 7 <> 0 and id % 5 > 0 and id % 11 <> 0"


@query("r5_census_scan", f"select id, id % 5 as population, easting, northing, size from ({_NAMED})")
def r5(spark, sf_dir):
    k, digits = F.col("o_orderkey"), lambda c: c.cast("string")
    name = F.concat(F.when(k % 3 == 0, "").otherwise(F.concat(digits(k % 3), F.lit("km"))), F.lit("N"), digits(F.col("o_custkey") % 700 + 1700), F.lit("E"), digits(k % 700 + 3100))
    rows = fx.read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 7 == 0, "FR").otherwise("ES").alias("country"), (k % 5).alias("population"), F.when(k % 11 == 0, "unknown").otherwise(name).alias("name"))
    return landed.census_rows(rows, "ES").select("id", "population", "easting", "northing", "size")


@query("r7_elements", "select kind, id, position, points from (select *, row_number() over (partition by kind, id order by points = 0, position) as n from (select case when o_orderkey % 2 = 0 then 'way' else 'node' end as kind, o_custkey as id, o_orderkey as position, case when o_orderkey % 3 = 0 then (o_orderkey % 4)::int else 0 end as points from orders)) where n = 1")
def r7(spark, sf_dir):
    k = F.col("o_orderkey")
    points = F.slice(F.array(*(F.struct(F.lit(float(i)).alias("x"), F.lit(0.0).alias("y")) for i in range(4))), F.lit(1), (k % 4).cast("int"))
    rows = fx.read(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "way").otherwise("node").alias("kind"), F.col("o_custkey").alias("id"), k.alias("position"), F.when(k % 3 == 0, points).alias("geometry"))
    return landed.elements(rows).select("kind", "id", "position", F.coalesce(F.when(F.col("geometry").isNotNull(), F.size("geometry")), F.lit(0)).alias("points"))


_TAIL = "lpad((c_custkey % 1000000)::varchar, 7, '0')"


@query("n4_phones", f"select c_custkey as id, case when c_custkey % 4 = 0 then ['+34' || '93' || {_TAIL}, '+1212' || {_TAIL}] when c_custkey % 4 = 1 then ['+34' || '93' || {_TAIL}, '+34' || '60' || {_TAIL}] when c_custkey % 4 = 2 then [] else ['+34' || '60' || {_TAIL}] end as phones, case when c_custkey % 3 = 0 then 'https://www.example.cat/' || c_custkey when c_custkey % 3 = 1 then 'http://example.cat' end as website from customer")
def n4_phones(spark, sf_dir):
    k = F.col("c_custkey")
    tail = F.lpad((k % 1000000).cast("string"), 7, "0")
    first = F.when(k % 4 == 0, F.concat(F.lit("0034 93 "), tail, F.lit(" / +1 (212) "), tail)).when(k % 4 == 1, F.concat(F.lit("93-"), tail, F.lit(" y 60 "), tail)).when(k % 4 == 2, "12 34")
    second = F.when(k % 4 == 0, F.concat(F.lit("93 "), tail)).when(k % 4 == 3, F.concat(F.lit("(+34) 60"), tail, F.lit("; 60 "), tail))
    site = F.when(k % 3 == 0, F.concat(F.lit("//www.example.cat/"), k.cast("string"))).when(k % 3 == 1, " http://example.cat ").otherwise("no site")
    return fx.read(spark, sf_dir, "customer").select(k.alias("id"), landed.phones(first, second).alias("phones"), landed.web_address(site).alias("website"))


# Trapezia (a ring of five vertices) and lines of three vertices.
_X, _Y, _W, _H = "(1.5::double + (p_partkey % 800) * 0.001::double)", "(41.2::double + (p_partkey % 700) * 0.001::double)", "((p_partkey % 9 + 1) * 0.001::double)", "((p_partkey % 5 + 1) * 0.001::double)"
_CY = f"({_Y} + {_H} * 4 / 9)"


@query("n16_feature_shapes", f"""select p_partkey as id, 'footprint' as shape, round({_X} + {_W} * 7 / 18, 8) as lon, round({_CY}, 8) as lat, round({_W} * {_H} * 0.75::double * cos(radians({_CY})) * pow(111320.0::double, 2), 3) as area_m2 from part where p_partkey % 3 > 0
union all select p_partkey, 'line', round({_X} + ({_W} / 2 * {_W} + {_W} * {_H}) / ({_W} + {_H}), 8), round({_Y} + ({_H} / 2 * {_H}) / ({_W} + {_H}), 8), null from part where p_partkey % 3 = 0""")
def n16(spark, sf_dir):
    k = F.col("p_partkey")
    x, y, w, h = (k % 800) * F.lit(0.001) + 1.5, (k % 700) * F.lit(0.001) + 41.2, (k % 9 + 1) * F.lit(0.001), (k % 5 + 1) * F.lit(0.001)
    v = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(v(x, y), v(x + w, y), v(x + w / 2, y + h), v(x, y + h), v(x, y))
    rows = dealt(fx.read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("id"), landed.feature_shape(F.when(k % 3 > 0, ring).otherwise(F.array(v(x, y), v(x + w, y), v(x + w, y + h)))).alias("s"))
    return _rounded(rows.select("id", "s.*"), lon=8, lat=8, area_m2=3)


@query("r11_restore", f"select id, name, source_ref from {ASSETS}")
def r11(spark, sf_dir):
    # restored twice: the second time changes nothing
    snapshot = written(fx.assets(spark, sf_dir).select("id", "name", "source_ref"), "snapshot")
    table = snapshot.filter("source_ref % 3 = 0").withColumn("name", F.lit("old"))
    for _ in range(2):
        table = store.upsert(table, snapshot.withColumn("position", F.col("source_ref")), "id", "position")
    return table.select("id", "name", "source_ref")


@query("v11_warnings", f"""with f as (select count(*) as assets, count(*) - count(distinct (name, province)) as merged, sum((lon > 2.2::double)::int)::bigint as outside from {ASSETS})
select 0 as position, 'capped' as code, 'the list ends after 100 of ' || assets || ' assets' as message from f where assets > 100
union all select 1, 'merged', merged || ' records merged' from f where merged > 0
union all select 2, 'uncovered', outside || ' assets beyond the covered area' from f where outside > 0""")
def v11(spark, sf_dir):
    each = fx.assets(spark, sf_dir).groupBy("name", "province").agg(F.count("*").alias("n"), F.sum((F.col("lon") > 2.2).cast("long")).alias("far"))
    facts = each.agg(F.sum("n").alias("assets"), (F.sum("n") - F.count("*")).alias("merged"), F.sum("far").alias("outside"))
    said = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    text = lambda c: F.col(c).cast("string")
    tests = {
        "capped": (F.col("assets") > 100, said("the list ends after 100 of ", text("assets"), " assets")),
        "merged": (F.col("merged") > 0, said(text("merged"), " records merged")),
        "uncovered": (F.col("outside") > 0, said(text("outside"), " assets beyond the covered area")),
    }
    return landed.warnings(facts, tests)


# Tags with the class that a reader of the rules expects, given out over the parts.
_TAGGED = [
    ({"amenity": "fuel", "shop": "convenience"}, "fuel_station"), ({"man_made": "storage_tank", "content": "crude oil"}, "fuel_depot"), ({"man_made": "storage_tank"}, "warehouse"),
    ({"man_made": "works", "product": "CHEMicals"}, "chemical_plant"), ({"man_made": "works"}, "factory"), ({"emergency": "fire_hydrant"}, "hydrant"),
    ({"amenity": "hospital", "building": "yes"}, "hospital"), ({"healthcare": "doctor"}, "clinic"), ({"social_facility": "group_home", "social_facility:for": "mental_health"}, "mental_health"),
    ({"social_facility": "day_care", "social_facility:for": "senior"}, "day_centre"), ({"social_facility": "assisted_living", "social_facility:for": "elderly"}, "care_home"), ({"social_facility": "outreach"}, "social_services"),
    ({"amenity": "shelter", "shelter_type": "public_transport", "building": "house"}, None), ({"amenity": "school", "isced:level": "1;2"}, "primary_school"), ({"building": "school", "isced:level": "3"}, "secondary_school"),
    ({"amenity": "school"}, "school"), ({"power": "generator", "generator:source": "wind"}, "wind_farm"), ({"power": "plant"}, "power_plant"),
    ({"man_made": "tower", "tower:type": "communication"}, "telecom_mast"), ({"man_made": "tower", "tourism": "viewpoint"}, None), ({"natural": "water", "water": "lake"}, "reservoir"),
    ({"natural": "water"}, None), ({"amenity": "recycling", "recycling_type": "centre"}, "waste_facility"), ({"amenity": "recycling"}, None),
    ({"craft": "winery"}, "workshop"), ({"craft": "sawmill"}, "sawmill"), ({"landuse": "vineyard"}, "orchard"),
    ({"tourism": "alpine_hut"}, "hostel"), ({"historic": "ruins"}, "monument"), ({"shop": "grocery"}, "supermarket"), ({"shop": "books"}, "shop"),
    ({"office": "lawyer"}, "office"), ({"building": "detached"}, "house"), ({"building": "yes"}, None), ({"building": "castle"}, "castle"), ({}, None),
]
_WAYS = [
    ({"highway": "motorway_link"}, "motorway"), ({"highway": "trunk"}, "primary_road"), ({"highway": "tertiary"}, "secondary_road"), ({"highway": "living_street"}, "local_road"),
    ({"highway": "track", "power": "line"}, "track"), ({"highway": "steps", "power": "line"}, None), ({"power": "minor_line"}, "power_line"), ({"power": "tower"}, None),
    ({"railway": "tram"}, "railway"), ({"railway": "station"}, None), ({"waterway": "canal", "man_made": "pipeline"}, None), ({"man_made": "pipeline"}, "gas_infrastructure"), ({}, None),
]


def _expected(tagged) -> str:
    return f"[{', '.join('null' if c is None else repr(c) for _, c in tagged)}][p_partkey % {len(tagged)} + 1]"


def _classified(spark, sf_dir, tagged, rules):
    sets = F.array(*(F.from_json(F.lit(json.dumps(t)), "map<string,string>") for t, _ in tagged))
    rows = fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(sets, (F.col("p_partkey") % len(tagged)).cast("int")).alias("tags"))
    return rows.select("id", tag_rules.tag_class(F.col("tags"), rules).alias("class"))


@query("c2_tag_classes", f"select p_partkey as id, {_expected(_TAGGED)} as class from part")
def c2(spark, sf_dir):
    return _classified(spark, sf_dir, _TAGGED, tag_rules.RULES)


@query("c3_network_classes", f"select p_partkey as id, {_expected(_WAYS)} as class from part")
def c3(spark, sf_dir):
    return _classified(spark, sf_dir, _WAYS, tag_rules.NETWORKS)
