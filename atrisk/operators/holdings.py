"""Registry jobs that give whole asset records: livestock holdings and care homes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrisk.functions.norm import clean_text, coordinates, decimal, folded, let, title_case, valid
from atrisk.operators.landed import phones, web_address

# Parts of folded species names, the group they belong to, livestock units a head.
SPECIES = [
    (("bovi", "vacu"), "cattle", 0.80),
    (("porci",), "pigs", 0.30),
    (("galls dindi", "indiot"), "poultry", 0.030),
    (("gallines", "pollastres", "aviram"), "poultry", 0.010),
    (("anecs", "oques", "palmipedes"), "poultry", 0.014),
    (("guatlles", "perdius", "faisans"), "poultry", 0.005),
    (("estruc",), "poultry", 0.100),
    (("ovi",), "sheep_goats", 0.10),
    (("cabrum", "capri"), "sheep_goats", 0.10),
    (("equid", "cavall"), "horses", 0.80),
    (("camell", "dromedari", "llama"), "horses", 0.80),
    (("conill", "cunicola"), "rabbits", 0.020),
    (("apicola", "abelles"), "apiculture", 0.000),
    (("aquicultura", "piscicultura"), "aquaculture", 0.000),
    (("cervols", "cabirols", "caca"), "cattle", 0.30),
    (("gossos", "gats", "canina", "felina"), "animal_shelter", 0.000),
]
OTHER_SPECIES = ("mixed_livestock", 0.30)
LICENSED = "registered capacity in head (REGA), converted to livestock units with Eurostat coefficients"
PLACES = "licensed places (CSIC) plus staff at 1 per 3 places"
HOLDING_TEXTS = ["latitud", "longitud", "coor_x", "coor_y", "nom_explotaci", "marca_oficial", "adre_a_explotaci", "cp", "nom_municipi", "nom_comarca", "tipus_explotaci", "sistema_productiu"]


def species_group(species: Column) -> Column:
    """``name, units``: the group of the first rule of which a part is in the folded name, and
    livestock units a head."""
    group = lambda name, units: F.struct(F.lit(name).alias("name"), F.lit(units).cast("decimal(4,3)").alias("units"))

    def first_of(key: Column) -> Column:
        out = group(*OTHER_SPECIES)
        for parts, name, units in reversed(SPECIES):
            any_part = F.lit(False)
            for p in parts:
                any_part = any_part | key.contains(p)
            out = F.when(any_part, group(name, units)).otherwise(out)
        return out

    return let(folded(species), first_of)


def livestock(rows: DataFrame) -> DataFrame:
    """One record per active holding from registry rows (holding x species x kind), all texts,
    with ``position`` to order them.

    Of a species' rows the largest capacity counts, as rows repeat it; species are then summed.
    Several groups with livestock units make a mixed holding, else the group with most of them
    (the first by position on a tie) names it. Descriptions are those of the first row. Holdings
    without reference or place are left out; empty input gives no rows. A holding's rows are
    reduced to its species before they meet. Sums are of decimals, so they don't depend on the
    order of rows; halves are rounded up.
    """
    active = rows.filter(F.coalesce(folded(F.col("estat_explotaci_")), F.lit("")).isin("activa", "")).withColumn("source_ref", clean_text(F.col("codi_rega"))).filter("source_ref is not null")
    heads = F.greatest(F.coalesce(decimal(F.col("total_ub")), F.lit(0.0)), F.lit(0.0))
    each = active.select("source_ref", F.coalesce(clean_text(F.col("esp_cie")), F.lit("?")).alias("species"), heads.alias("heads"), "position", *HOLDING_TEXTS)
    most = each.groupBy("source_ref", "species").agg(F.max("heads").alias("heads"), F.count("*").alias("n"), F.min("position").alias("position"), F.min_by(F.struct(*HOLDING_TEXTS), "position").alias("first"))
    most = most.withColumn("group", species_group(F.col("species"))).withColumn("units", F.col("heads").cast("decimal(20,3)") * F.col("group.units"))
    item = F.struct("position", "species", "heads", F.col("group.name").alias("group"), "units")
    whole = most.groupBy("source_ref").agg(F.sum("n").alias("n"), F.min_by("first", "position").alias("first"), F.sort_array(F.collect_list(item)).alias("s"))
    total = lambda items, field: F.aggregate(items, F.lit(0).cast("decimal(38,6)"), lambda t, i: (t + i[field]).cast("decimal(38,6)"))
    names = F.array_distinct(F.transform("s", lambda i: i["group"]))  # in order of position
    sums = F.transform(names, lambda g, i: F.struct(total(F.filter("s", lambda x: x["group"] == g), "units").alias("units"), (-i).alias("order"), g.alias("name")))
    counted = F.sort_array(F.transform(F.filter("s", lambda i: i["heads"] > 0), lambda i: F.struct(i["species"].alias("species"), i["heads"].alias("heads"))))
    f = lambda c: F.col(f"first.{c}")
    # what is exploded is computed once, where a filter on it would be pushed below and read the texts twice
    place = F.explode(F.array_compact(F.array(coordinates(f("longitud"), f("latitud"), f("coor_x"), f("coor_y")))))
    made = whole.select("*", place.alias("at")).select("*", sums.alias("sums"), counted.alias("counted"))
    dominant = F.array_max("sums")["name"]
    several = F.size(F.filter("sums", lambda g: g["units"] > 0)) > 1
    address = F.struct(clean_text(f("adre_a_explotaci")).alias("street"), clean_text(f("cp")).alias("postcode"), title_case(f("nom_municipi")).alias("municipality"), title_case(f("nom_comarca")).alias("comarca"), F.lit("Catalunya").alias("region"), F.lit("ES").alias("country"))
    capacity = F.struct(F.nullif(F.round(F.aggregate("s", F.lit(0.0), lambda t, i: t + i["heads"])).cast("long"), F.lit(0)).alias("animals"), F.nullif(F.round(total(F.col("s"), "units"), 1).cast("double"), F.lit(0.0)).alias("livestock_units"), F.lit(LICENSED).alias("basis"), F.lit(0.55).alias("confidence"))
    by_species = F.map_from_arrays(F.transform("counted", lambda i: i["species"]), F.transform("counted", lambda i: F.round(i["heads"]).cast("long")))
    attributes = F.struct(F.transform("counted", lambda i: i["species"]).alias("species"), by_species.alias("species_head_capacity"), dominant.alias("dominant_group"), F.col("n").alias("sub_exploitations"), clean_text(f("tipus_explotaci")).alias("holding_type"), clean_text(f("sistema_productiu")).alias("production_system"))
    name = title_case(F.coalesce(F.nullif(f("nom_explotaci"), F.lit("")), f("marca_oficial")))
    return made.select("source_ref", F.when(several, "mixed_livestock").otherwise(dominant).alias("subcategory"), name.alias("name"), "at.lon", "at.lat", address.alias("address"), capacity.alias("capacity"), attributes.alias("attributes"), F.lit(0.8).alias("confidence"))


#: Columns of care home files, by candidates of their names.
CARE_HOME_FIELDS = {"name": ("Denominacion",), "via": ("Via",), "street": ("Nombre via",), "number": ("Num. via",), "municipality": ("Municipio",), "postcode": ("C. Postal",), "phone": ("Telefono",), "url": ("URL",), "places": ("Plazas",), "ownership": ("Titularidad",), "modified": ("ltima modificaci", "Ultima modificaci"), "lon": ("Longitud",), "lat": ("Latitud",)}


def care_homes(rows: DataFrame) -> DataFrame:
    """Care homes from ``scans.delimited`` rows: people are places and staff, the street is put
    together from its three columns, and only records without usable coordinates need the
    geocoder. Rows without a name are left out."""
    lon, lat, places = decimal(F.col("lon")), decimal(F.col("lat")), decimal(F.col("places"))
    named = rows.filter("name is not null").withColumns({"x": lon, "y": lat, "seats": places}).withColumn("ok", valid(F.col("x"), F.col("y")))
    street = clean_text(F.concat_ws(" ", "via", "street", "number"))
    address = F.struct(street.alias("street"), "municipality", "postcode", F.lit("ES").alias("country"))
    capacity = F.when(F.coalesce(F.col("seats"), F.lit(0.0)) != 0, F.struct(F.col("seats").alias("places"), F.bround(F.col("seats") * 1.33).cast("long").alias("people"), F.lit(PLACES).alias("basis"), F.lit(0.8).alias("confidence")))
    contacts = F.struct(phones(F.col("phone")).alias("phone"), web_address(F.col("url")).alias("website"))
    attributes = F.struct("ownership", F.col("seats").alias("places_licensed"), F.col("part").alias("province"), F.col("modified").alias("last_modified"))
    ref = F.concat_ws("|", "part", "name", F.coalesce("municipality", F.lit("")))
    return named.select(ref.alias("source_ref"), F.lit("care_home").alias("subcategory"), "name", F.when(F.col("ok"), F.col("x")).alias("lon"), F.when(F.col("ok"), F.col("y")).alias("lat"), address.alias("address"), contacts.alias("contacts"), capacity.alias("capacity"), attributes.alias("attributes"), F.lit(0.8).alias("confidence"), (~F.col("ok")).alias("needs_geocoding"))
