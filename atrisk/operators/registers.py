"""Registry jobs that give whole asset records: schools, social services, public facilities.

Landed rows are texts, of which any may be null and most columns may be absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrisk.functions import rules
from atrisk.functions.norm import clean_text, coordinates, decimal, title_case
from atrisk.operators.landed import phones, web_address
from atrisk.operators.registry_jobs import emails, latest_edition

# Staff to each student, what capacities rest on and how far records are trusted.
STAFF, SCHOOL_CAPACITY, SCHOOL = 0.12, 0.75, 0.85
PLACES, PLACES_CAPACITY, SOCIAL = "registered places (RESES)", 0.7, 0.55
FACILITY = 0.8
# The registry's columns of the stages that a school offers.
STAGES = {"infant": "einf2c", "primary": "epri", "secondary": "eso", "upper": "batx"}


def _text(rows: DataFrame, *names: str) -> Column:
    """The first of some columns that has a text, as far as the table has them."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns), F.lit(None).cast("string"))


def _address(rows: DataFrame, street: Column) -> Column:
    return F.struct(
        clean_text(street).alias("street"), clean_text(_text(rows, "cp", "codi_postal", "cpostal")).alias("postcode"), title_case(_text(rows, "nom_municipi", "municipi", "poblacio")).alias("municipality"),
        title_case(_text(rows, "nom_comarca", "comarca")).alias("comarca"), F.lit("Catalunya").alias("region"), F.lit("ES").alias("country"),
    )


def _contacts(rows: DataFrame, phone: list[str], email: str, website: str, operator: Column) -> Column:
    numbers = phones(*(_text(rows, p) for p in phone))
    found = F.coalesce(emails(_text(rows, email)), F.array().cast("array<string>"))
    return F.struct(numbers.alias("phone"), found.alias("email"), web_address(_text(rows, website)).alias("website"), operator.alias("operator"))


def _placed(rows: DataFrame, lon: str, lat: str, easting: str, northing: str) -> DataFrame:
    """Rows with a place ``at``, in degrees or else on the plane; the rest is left out."""
    return rows.withColumn("at", coordinates(_text(rows, lon), _text(rows, lat), _text(rows, easting), _text(rows, northing))).filter("at is not null")


def enrolled(enrolments: DataFrame, year: str | None = None) -> DataFrame:
    """``codi_centre, students, units`` of one school year, by default the latest, summed over
    stages; one row per school."""
    of = latest_edition(enrolments, "curs") if year is None else enrolments.filter(F.col("curs") == year)
    number = lambda c: F.coalesce(decimal(F.col(c)), F.lit(0.0))
    return of.groupBy(clean_text(F.col("codi_centre")).alias("codi_centre")).agg(F.sum(number("matr_cules_total")).alias("students"), F.sum(number("unitats")).alias("units"))


def schools(rows: DataFrame, enrolments: DataFrame) -> DataFrame:
    """One record per school of the latest year of ``rows`` (all years stacked): the level by stages
    and name, headcounts of the same year joined by code, people with staff. Schools without
    code or place are left out; those without students have no capacity. Repeated rows of a
    school give repeated records, of which an upsert keeps the first."""
    now = latest_edition(rows, "curs").withColumn("source_ref", clean_text(F.col("codi_centre"))).filter("source_ref is not null")
    placed = _placed(now, "coordenades_geo_x", "coordenades_geo_y", "coordenades_utm_x", "coordenades_utm_y")
    year = rows.agg(F.max("curs").alias("curs"))
    counts = enrolled(enrolments.join(F.broadcast(year), "curs").select(*enrolments.columns))  # one row, the year
    joined = placed.join(counts.withColumnRenamed("codi_centre", "source_ref"), "source_ref", "left")
    level = rules.school_level({k: _text(rows, c) for k, c in STAGES.items()}, _text(rows, "denominaci_completa"))
    capacity = F.when(F.col("students") > 0, F.struct("students", F.bround(F.col("students") * (1 + STAFF)).cast("long").alias("people"), F.concat(F.lit("enrolment "), F.col("curs"), F.lit(" + 12% staff")).alias("basis"), F.lit(SCHOOL_CAPACITY).alias("confidence")))
    owner = clean_text(_text(rows, "nom_titularitat"))
    attributes = F.struct("curs", owner.alias("titularitat"), _text(rows, "nom_naturalesa").alias("naturalesa"), "units", _text(rows, "codi_municipi").alias("codi_municipi"))
    return joined.select(
        "source_ref", level.alias("subcategory"), title_case(_text(rows, "denominaci_completa")).alias("name"), "at.lon", "at.lat", _address(rows, _text(rows, "adre_a")).alias("address"),
        _contacts(rows, ["tel_fon"], "e_mail_centre", "url", owner).alias("contacts"), capacity.alias("capacity"), attributes.alias("attributes"), F.lit(SCHOOL).alias("confidence"),
    )


def social_services(rows: DataFrame) -> DataFrame:
    """Services with premises, by typology; they have an address only and wait for the geocoder.
    People are the places. Rows without a number or of a service without premises are left out."""
    places = decimal(_text(rows, "capacitat"))
    capacity = F.when(places != 0, F.struct(places.alias("places"), places.alias("people"), F.lit(PLACES).alias("basis"), F.lit(PLACES_CAPACITY).alias("confidence")))
    attributes = F.struct(*(clean_text(_text(rows, c)).alias(c) for c in ("tipologia", "qualificacio", "nif", "inscripcio")))
    none = F.lit(None).cast("double")
    out = rows.select(
        clean_text(F.col("registre")).alias("source_ref"), rules.social_service(_text(rows, "tipologia")).alias("subcategory"), title_case(_text(rows, "nom")).alias("name"), none.alias("lon"), none.alias("lat"), _address(rows, _text(rows, "adreca")).alias("address"),
        F.struct(title_case(_text(rows, "entitat_titular")).alias("operator")).alias("contacts"), capacity.alias("capacity"), attributes.alias("attributes"), F.lit(SOCIAL).alias("confidence"), F.lit(True).alias("needs_geocoding"),
    )
    return out.filter("source_ref is not null and subcategory is not null")


def facilities(rows: DataFrame) -> DataFrame:
    """Public facilities, by category, else name; the street is put together from its columns.
    Rows without identifier or place are left out."""
    name = title_case(_text(rows, "nom", "alies"))
    attributes = F.struct(clean_text(_text(rows, "categoria")).alias("categoria"), clean_text(_text(rows, "localitzacio")).alias("localitzacio"), _text(rows, "codi_municipi").alias("codi_municipi"))
    street = F.concat_ws(" ", _text(rows, "tipus_via"), _text(rows, "via"), _text(rows, "num"))
    known = _placed(rows.withColumn("source_ref", clean_text(F.col("idequipament"))).filter("source_ref is not null"), "longitud", "latitud", "utmx", "utmy")
    return known.select(
        "source_ref", rules.facility(_text(rows, "categoria"), name).alias("subcategory"), name.alias("name"), "at.lon", "at.lat", _address(rows, street).alias("address"),
        _contacts(rows, ["telefon1", "telefon2"], "email", "web", F.lit(None).cast("string")).alias("contacts"), attributes.alias("attributes"), F.lit(FACILITY).alias("confidence"),
    )
