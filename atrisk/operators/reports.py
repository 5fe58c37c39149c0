"""Lists, guards, catalogues and plans around the exposure report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrisk.functions import geom
from atrisk.functions.norm import title_case

# Fixed value: people a dwelling.
PEOPLE_PER_DWELLING = 2.47
Box = tuple[float, float, float, float]


def first_by(rows: DataFrame, columns: list[Column], n: int) -> DataFrame:
    """The first n rows in an order that ends with the id, so that ties have one result."""
    return rows.orderBy(*columns, "id").limit(n)


def with_truncated(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by id and, in ``truncated``, whether there were more."""
    more = rows.select("id").orderBy("id").limit(n + 1).agg((F.count("*") > n).alias("truncated"))
    return rows.orderBy("id").limit(n).withColumn("truncated", more.scalar())


def dwelling_fallback(assets: DataFrame) -> DataFrame:
    """Residents by people, else by dwellings, of residential assets."""
    people = F.coalesce(F.when(F.col("people") > 0, F.col("people").cast("double")), F.col("dwellings") * PEOPLE_PER_DWELLING, F.lit(0.0))
    return assets.filter("category = 'residential'").agg(F.sum(people).alias("residents"), F.count("*").alias("assets"))


def catalogue(assets: DataFrame) -> DataFrame:
    """Categories with their subcategories in use, sorted, and how many."""
    of = assets.groupBy("category").agg(F.sort_array(F.collect_set("subcategory")).alias("subcategories"), F.count("*").alias("assets"))
    return of.withColumn("kinds", F.size("subcategories"))


def tile_plan(assets: DataFrame, region: str, side: int) -> DataFrame:
    """Per region the distinct tiles and the blocks of side x side tiles they need."""
    ix, iy = (geom.tile_index(F.col(c), 0.05) for c in ("lon", "lat"))
    tiles = assets.select(region, ix.alias("ix"), iy.alias("iy")).distinct()
    block = F.struct(F.floor(F.col("ix") / side), F.floor(F.col("iy") / side))
    return tiles.groupBy(region).agg(F.count("*").alias("tiles"), F.countDistinct(block).alias("blocks"))


def signup_funnel(signups: DataFrame) -> DataFrame:
    """Per origin: completed, pending and expired sign-ups, and the most pending of one address."""
    each = signups.groupBy("origin", "email").agg(*(F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("completed", "pending", "expired")))
    return each.groupBy("origin").agg(*(F.sum(s).alias(s) for s in ("completed", "pending", "expired")), F.max("pending").alias("most_pending"))


def in_regions(rows: DataFrame, regions: dict[str, Box]) -> DataFrame:
    """Each row with every named box that holds it: boxes are a parameter, so this is an
    array in the row, not a join."""
    hit = F.array_compact(F.array(*(F.when(geom.in_envelope(F.col("lon"), F.col("lat"), box), name) for name, box in regions.items())))
    return rows.withColumn("region", F.explode(hit))


def area_guard(areas: DataFrame, key: str, most_km2: float) -> DataFrame:
    """Envelope area of each group's points in km2 and whether it is accepted."""
    e = areas.groupBy(key).agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    width = (F.col("x1") - F.col("x0")) * F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))
    km2 = width * (F.col("y1") - F.col("y0")) * (geom.DEG_LAT_M / 1000) ** 2
    return e.select(key, km2.alias("km2"), (km2 <= most_km2).alias("accepted"))


def coverage_regime(lon: Column, lat: Column, regional: Box, national: Box) -> Column:
    return F.when(geom.in_envelope(lon, lat, regional), "regional").when(geom.in_envelope(lon, lat, national), "national").otherwise("open map only")


def ndjson(rows: DataFrame, header: DataFrame, *columns: str) -> DataFrame:
    """A header line and a line for each row, as JSON text: ready for ``write.text``."""
    return header.select(F.to_json(F.struct("*")).alias("value")).unionByName(rows.select(F.to_json(F.struct(*columns)).alias("value")))


def bands_in_order(bands: DataFrame, key: str) -> DataFrame:
    """Numbers each set's bands: by minutes, unknown last, where any band has them, else by
    area; equal ones by name."""
    w = Window.partitionBy(key)
    timed = F.max(F.col("minutes").isNotNull()).over(w)
    order = w.orderBy(F.when(F.col("timed"), F.col("minutes")).asc_nulls_last(), F.when(~F.col("timed"), F.col("area")).asc_nulls_last(), "band")
    return bands.withColumn("timed", timed).withColumn("position", F.row_number().over(order)).drop("timed")


def band_minutes(label: Column, minutes: Column, hours: Column) -> Column:
    """Minutes from a minutes or hours property, else from a label such as 3h or 90min."""
    number = F.regexp_extract(F.lower(label), r"^\s*([0-9]+)\s*(h|min)", 1).try_cast("double")
    unit = F.regexp_extract(F.lower(label), r"^\s*([0-9]+)\s*(h|min)", 2)
    return F.coalesce(minutes, hours * 60, F.when(unit == "h", number * 60).when(unit == "min", number))


def ring_notes(points: Column) -> Column:
    """Why a ring isn't valid: too few positions or not closed; null if it is."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    return F.when(F.size(points) < 4, "too few positions").when((first["x"] != last["x"]) | (first["y"] != last["y"]), "not closed")


def elected(records: DataFrame, key: list[str], priority: dict[str, int]) -> DataFrame:
    """Each cluster's primary record: source priority, then confidence, then id; by partial
    aggregation, so that no cluster is gathered."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))[F.col("source_id")], F.lit(0))
    first = F.max_by(F.struct("id", "source_id"), F.struct(rank.alias("rank"), "confidence", (-F.col("id")).alias("low")))
    return records.groupBy(*key).agg(first.alias("p"), F.count("*").alias("members")).select(*key, F.col("p.id").alias("id"), F.col("p.source_id").alias("source_id"), "members")


def confidence_of(base: Column, members: Column) -> Column:
    """What further members add to a merged record's confidence."""
    return F.least(F.lit(0.98), base + (members - 1) * 0.06)


def grouped_tiles(tiles: DataFrame, per_group: int, strip: int = 8) -> DataFrame:
    """Tiles (ix, iy) in groups of some tiles with their box; groups are formed within
    strips of columns, so that the order needs no single task."""
    s = F.floor(F.col("ix") / strip).alias("strip")
    n = F.row_number().over(Window.partitionBy("strip").orderBy("iy", "ix"))
    numbered = tiles.select(s, "ix", "iy").withColumn("part", F.floor((n - 1) / per_group))
    return numbered.groupBy("strip", "part").agg(F.count("*").alias("tiles"), *(f(c).alias(f"{name}_{c}") for c in ("ix", "iy") for f, name in ((F.min, "min"), (F.max, "max"))))


def refresh_outcome(states: DataFrame, key: str) -> DataFrame:
    """How far each block's refresh came: done, partial or failed, and the share done."""
    done = F.sum((F.col("status") == "ok").cast("long"))
    out = states.groupBy(key).agg(F.count("*").alias("tiles"), done.alias("ok"))
    settled = F.when(F.col("ok") == F.col("tiles"), "done").when(F.col("ok") > 0, "partial").otherwise("failed")
    return out.withColumns({"outcome": settled, "percent": F.floor(F.col("ok") * 100 / F.col("tiles"))})


def run_rows(runs: DataFrame, filtered: Column) -> DataFrame:
    """Ledger rows of ingest runs: a filtered load counts as partial, errors are cut to 500."""
    status = F.when(F.col("error").isNotNull(), "error").when(filtered, "partial").otherwise("ok")
    return runs.select("run_id", "source_id", status.alias("status"), F.when(F.col("error").isNull(), F.col("rows")).otherwise(0).alias("rows"), F.substring("error", 1, 500).alias("error"))


def enriched(rows: DataFrame, key: str, cache: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows with ``payload`` from the cache, else from the lookup, which is asked only for the
    distinct keys that the cache lacks."""
    missing = rows.select(key).filter(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")
    known = cache.select(key, "payload", F.lit(True).alias("cached")).unionByName(missing.join(lookup, key).select(key, "payload", F.lit(False).alias("cached")))
    return rows.join(known, key, "left")


def place_variants(name: Column) -> Column:
    """Spellings of a place in the order to try: as it is, an article put first, and the
    halves of a double name."""
    folded = F.lower(F.trim(name))
    article = F.regexp_replace(folded, r"^(.+), (la|el|les|els|los|las)$", "$2 $1")
    return F.array_distinct(F.filter(F.concat(F.array(folded, article), F.split(folded, "/")), lambda v: v != ""))


def gazetteer(names: DataFrame) -> DataFrame:
    """``name, lon, lat``: of the rows of one folded name (place, alternates, rank, line) the
    one of the best rank, the first of them on a tie."""
    each = names.select(F.explode(F.concat(F.array("place"), "alternates")).alias("name"), "lon", "lat", "rank", "line")
    best = F.min_by(F.struct("lon", "lat"), F.struct("rank", "line"))
    return each.groupBy(F.lower("name").alias("name")).agg(best.alias("at")).select("name", "at.lon", "at.lat")


def located(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Rows with the point of the first place variant, then province variant, that the
    gazetteer knows; quality 0.3 and 0.1, null where none does."""
    def tried(column: str, level: int) -> Column:
        return F.transform(place_variants(F.coalesce(column, F.lit(""))), lambda v, i: F.struct(v.alias("name"), F.lit(level).alias("level"), i.alias("position")))

    tries = rows.select(key, F.explode(F.concat(tried("municipality", 0), tried("province", 1))).alias("t"))
    hit = tries.select(key, "t.*").join(table, "name").groupBy(key).agg(F.min_by(F.struct("lon", "lat", "level"), F.struct("level", "position")).alias("p"))
    return rows.join(hit, key, "left").select(*rows.columns, "p.lon", "p.lat", F.when(F.col("p.level") == 0, 0.3).when(F.col("p.level") == 1, 0.1).alias("quality"))


def wanted_place(columns: list[Column], wanted: list[str]) -> Column:
    """Whether any place field is wanted; a record without any passes."""
    have = F.filter(F.transform(F.array(*columns), lambda c: F.lower(F.trim(c))), lambda c: c.isNotNull() & (c != ""))
    return (F.size(have) == 0) | F.arrays_overlap(have, F.array(*map(F.lit, wanted)))


def wanted_point(lon: Column, lat: Column, box: Box) -> Column:
    """Whether a point is in the box; one without coordinates passes."""
    return lon.isNull() | lat.isNull() | geom.in_envelope(lon, lat, box)


# Abbreviations of street types.
STREETS = {"c/": "carrer", "c.": "carrer", "av.": "avinguda", "avda.": "avinguda", "pl.": "plaça", "pg.": "passeig", "ctra.": "carretera"}


def street(text: Column) -> Column:
    """A street with its type written out."""
    first = F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1))
    full = F.create_map(*(F.lit(x) for kv in STREETS.items() for x in kv))[first]
    return F.when(full.isNotNull(), F.concat_ws(" ", full, F.regexp_replace(text, r"^\s*\S+\s*", ""))).otherwise(F.trim(text))


#: Registry jobs by source: functions of a landed table that give the common asset columns.
JOBS: dict = {}


def job(source: str):
    """Decorator that registers a registry job."""

    def keep(fn):
        JOBS[source] = fn
        return fn

    return keep


def _raw(rows: DataFrame, subcategory: Column, name: Column, capacity: Column, people: Column, confidence: float) -> DataFrame:
    return rows.select(F.col("ref").cast("string").alias("source_ref"), subcategory.alias("subcategory"), name.alias("name"), capacity.cast("double").alias("capacity"), F.round(people).cast("double").alias("people"), F.lit(confidence).alias("confidence"))


@job("hospitals")
def hospitals(rows: DataFrame) -> DataFrame:
    """Beds to people; the class code tells the kind."""
    kind = F.when(F.col("kind") == "psychiatric", "mental_health").otherwise("hospital")
    return _raw(rows, kind, title_case(F.col("name")), F.col("size"), F.col("size") * 2.2, 0.9)


@job("primary_care")
def primary_care(rows: DataFrame) -> DataFrame:
    """Centres and clinics; the name is put together from kind and place."""
    kind = F.when(F.col("kind") == "centre", "primary_care").otherwise("clinic")
    return _raw(rows, kind, F.concat_ws(" ", title_case(F.col("kind")), title_case(F.col("name"))), F.lit(None), F.lit(None).cast("double"), 0.8)


@job("care_homes")
def care_homes(rows: DataFrame) -> DataFrame:
    """Places to people, staff included."""
    return _raw(rows, F.lit("care_home"), title_case(F.col("name")), F.col("size"), F.col("size") * 1.33, 0.8)


@job("municipal_points")
def municipal_points(rows: DataFrame) -> DataFrame:
    """Reference points of municipalities, of little confidence."""
    return _raw(rows, F.lit("other"), F.col("name"), F.lit(None), F.lit(None).cast("double"), 0.25)


# Road classes by highway tag; what is missing is no network.
HIGHWAYS = {"motorway": "motorway", "trunk": "motorway", "primary": "primary_road", "secondary": "secondary_road", "residential": "local_road", "track": "track"}


def linear_class(tags: Column) -> Column:
    """The network class of an element's tags: by highway, railway or power line; null for others."""
    road = F.create_map(*(F.lit(x) for kv in HIGHWAYS.items() for x in kv))[tags["highway"]]
    return F.coalesce(road, F.when(tags["railway"] == "rail", "railway"), F.when(tags["power"].isin("line", "minor_line"), "power_line"))


def worth_keeping(tags: Column, allowed: dict[str, list[str]]) -> Column:
    """Whether any tag has one of the values allowed for it."""
    out = F.lit(False)
    for tag, values in allowed.items():
        out = out | F.coalesce(tags[tag].isin(values), F.lit(False))
    return out


def ways(points: DataFrame) -> DataFrame:
    """``id, kind, points``: lines from vertices (id, kind, seq, x, y) in order of seq."""
    return points.repartition("id", "kind").groupBy("id", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def length_m(points: Column) -> Column:
    """Metres along a line, by great circles."""
    pairs = F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points) - 1).alias("b"))
    each = F.transform(pairs, lambda p: geom.haversine_m(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))
    return F.aggregate(each, F.lit(0.0), lambda s, m: s + m)


def envelope_of(points: Column) -> dict[str, Column]:
    """Envelope columns of a line or ring, to be stored beside it."""
    of = lambda c: F.transform(points, lambda p: p[c])
    return {"min_x": F.array_min(of("x")), "min_y": F.array_min(of("y")), "max_x": F.array_max(of("x")), "max_y": F.array_max(of("y"))}
