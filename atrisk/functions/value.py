"""Valuation, occupancy, urgency and priority as columns over assets joined to the taxonomy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atrisk.functions.taxonomy import HAZARDOUS, RESPONSE

# Construction cost index by province, the rest 1.
PROVINCE_INDEX = {"barcelona": 1.15, "girona": 1.08, "tarragona": 1.0, "lleida": 0.95, "madrid": 1.18, "guipuzcoa": 1.12, "vizcaya": 1.1, "baleares": 1.2, "malaga": 1.05, "valencia": 1.0, "sevilla": 0.98, "zaragoza": 0.96, "asturias": 0.95, "navarra": 1.05, "cantabria": 0.98, "alava": 1.05, "murcia": 0.93, "almeria": 0.92, "badajoz": 0.88, "caceres": 0.88, "teruel": 0.88, "soria": 0.88, "cuenca": 0.89, "jaen": 0.9}
# EUR per livestock unit by subcategory, and for the rest.
UNIT_VALUE = {"cattle": 1500.0, "pigs": 500.0, "poultry": 600.0, "sheep_goats": 1200.0, "horses": 3800.0, "rabbits": 750.0, "aquaculture": 1000.0, "mixed_livestock": 1100.0, "apiculture": 250.0, "animal_shelter": 900.0}
OTHER_UNIT_VALUE = 1100.0
# Weights of the priority score and what counts as full.
WEIGHTS = {"people": 0.38, "criticality": 0.24, "vulnerability": 0.14, "urgency": 0.16, "value": 0.08}
FULL_PEOPLE, FULL_VALUE = 1000.0, 50_000_000.0


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def positive(v: Column) -> Column:
    """Zero and less count as missing."""
    return F.when(v > 0, v)


def valuation() -> dict[str, Column]:
    """area_m2, structure_eur, contents_eur, livestock_eur, total_eur, value_method,
    value_confidence from footprint_m2, floors, province, livestock_units, animals,
    geometry_kind and the taxonomy's columns."""
    c = F.col
    own = positive(c("footprint_m2"))
    area = F.coalesce(own, c("def_footprint"))
    floors = F.coalesce(positive(c("floors")), c("def_floors"))
    priced = (area > 0) & (c("unit_cost") > 0)
    structure = F.when(priced, area * floors * c("unit_cost") * lookup(F.lower("province"), PROVINCE_INDEX, 1.0)).otherwise(0.0)
    contents = structure * c("contents_ratio")
    per_unit = lookup(c("subcategory"), UNIT_VALUE, OTHER_UNIT_VALUE)
    units, animals = positive(c("livestock_units")), positive(c("animals"))
    by_head = animals.isNotNull() & units.isNull() & (c("category") == "livestock")
    livestock = F.when(units.isNotNull(), units * per_unit).when(by_head, animals * (per_unit / 6.0)).otherwise(0.0)
    total = structure + contents + livestock
    parts = F.concat_ws(
        "+",
        F.when(own.isNotNull() & (c("geometry_kind") == "footprint"), "measured_footprint").when(own.isNotNull(), "source_footprint").when(c("def_footprint") > 0, "default_footprint"),
        F.when(positive(c("floors")).isNotNull(), "source_floors"),
        F.when(units.isNotNull(), "livestock_units").when(by_head, "livestock_headcount"),
    )
    trust = F.when(own.isNotNull() & (c("geometry_kind") == "footprint"), 0.8).when(own.isNotNull(), F.lit(0.8) - 0.1).when(c("def_footprint") > 0, 0.35).otherwise(0.8)
    trust = trust - F.when(positive(c("floors")).isNull() & (area > 0), 0.08).otherwise(0.0) - F.when(by_head, 0.15).otherwise(0.0)
    return {
        "structure_eur": structure,
        "contents_eur": contents,
        "livestock_eur": livestock,
        "total_eur": total,
        "value_method": F.when(total <= 0, "not_valued").when(parts == "", "class_default").otherwise(parts),
        "value_confidence": F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.05), F.least(trust, F.lit(0.9)))),
    }


def occupancy() -> dict[str, Column]:
    """people, people_basis and people_default: the first figure a source gives, else the class's."""
    given = [("people", "capacity.people"), ("beds", "registered beds"), ("students", "enrolment"), ("places", "registered places")]
    has = [positive(F.col(f"cap_{name}")) for name, _ in given]
    basis = F.coalesce(*(F.when(h.isNotNull(), label) for h, (_, label) in zip(has, given, strict=True)), F.when(F.col("def_people") > 0, "class default"), F.lit("no occupancy data"))
    return {"people": F.coalesce(*has, F.col("def_people")), "people_basis": basis, "people_default": F.coalesce(*has).isNull() & (F.col("def_people") > 0)}


def urgency(minutes: Column, band: Column, n_bands: int) -> Column:
    decay = 1.0 / (1.0 + F.pow(F.greatest(minutes, F.lit(0.0)) / 120.0, F.lit(0.8)))
    rank = F.lit(0.6) if n_bands <= 1 else F.when(band.isNull(), 0.6).otherwise(1.0 - band / float(n_bands - 1) * 0.7)
    return F.when(minutes.isNotNull(), decay).otherwise(rank)


def _log_share(v: Column, full: float) -> Column:
    return F.when(v <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log10(v + 1) / F.log10(F.lit(1 + full))))


def priority(urgent: Column) -> Column:
    """0 to 100 from people, criticality, vulnerability, urgency and total_eur."""
    w, c = WEIGHTS, F.col
    score = _log_share(c("people"), FULL_PEOPLE) * w["people"] + c("criticality") / 100 * w["criticality"] + c("vulnerability") / 100 * w["vulnerability"] + urgent * w["urgency"] + _log_share(c("total_eur"), FULL_VALUE) * w["value"]
    score = F.when(c("subcategory").isin(HAZARDOUS), F.least(F.lit(1.0), score * 1.25)).otherwise(score)
    score = F.when(c("subcategory").isin(RESPONSE), F.least(F.lit(1.0), score * 1.1)).otherwise(score)
    return score * 100.0
