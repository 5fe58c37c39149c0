"""Map tags to asset classes: an ordered table of rules that becomes one CASE beside the scan.

A rule has a class (or None: dropped) and alternatives, each a few tags with the values
that must hold together: a list of values, ``ANY`` for any value, ``"*part*"`` for a part of
the value, ``"start*"`` for its start. The first rule with an alternative that holds decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY: list[str] = []
Alternative = dict[str, list[str]]

# Classes by tags, in order of precedence.
RULES: list[tuple[str | None, list[Alternative]]] = [
    # hazards
    ("fuel_station", [{"amenity": ["fuel"]}, {"shop": ["fuel"]}]),
    ("fuel_depot", [{"man_made": ["storage_tank", "gasometer"], "content": ["*fuel*", "*oil*"]}, {"landuse": ["depot"], "content": ["*fuel*", "*oil*"]}, {"man_made": ["gasometer"]}]),
    ("warehouse", [{"man_made": ["storage_tank"]}, {"landuse": ["depot"]}]),
    ("gas_infrastructure", [{"man_made": ["pipeline"], "substance": ["gas", "oil", "fuel"]}]),
    ("chemical_plant", [{"industrial": ["chemical"]}, {"man_made": ["works"], "product": ["*chem*"]}]),
    ("sawmill", [{"craft": ["sawmill"]}, {"industrial": ["sawmill"]}]),
    # emergency
    ("hydrant", [{"emergency": ["fire_hydrant"]}]),
    ("water_point", [{"emergency": ["water_tank", "suction_point", "fire_water_pond"]}]),
    ("emergency_shelter", [{"emergency": ["assembly_point"]}]),
    ("ambulance", [{"emergency": ["ambulance_station"]}, {"amenity": ["ambulance_station"]}]),
    ("fire_station", [{"amenity": ["fire_station"]}, {"building": ["fire_station"]}]),
    ("police", [{"amenity": ["police"]}]),
    ("helipad", [{"aeroway": ["helipad", "heliport"]}]),
    # health
    ("hospital", [{"amenity": ["hospital"]}, {"healthcare": ["hospital"]}, {"building": ["hospital"]}]),
    ("pharmacy", [{"amenity": ["pharmacy"]}, {"healthcare": ["pharmacy"]}]),
    ("clinic", [{"amenity": ["clinic", "doctors", "dentist"]}, {"healthcare": ["centre", "clinic", "doctor", "dentist"]}]),
    ("mental_health", [{"healthcare": ["psychiatry"]}, {"social_facility": ["group_home"], "social_facility:for": ["*mental*"]}]),
    ("veterinary", [{"amenity": ["veterinary"]}, {"healthcare": ["veterinary"]}]),
    # social care
    ("care_home", [{"amenity": ["nursing_home"]}, {"social_facility": ["nursing_home"]}]),
    ("day_centre", [{"social_facility": ["day_care"], "social_facility:for": ["*senior*", "*elderly*"]}]),
    ("care_home", [{"social_facility": ANY, "social_facility:for": ["*senior*", "*elderly*"]}]),
    ("disability_home", [{"social_facility": ANY, "social_facility:for": ["*disab*"]}]),
    ("shelter", [{"social_facility": ANY, "social_facility:for": ["*homeless*"]}]),
    ("childcare_residential", [{"social_facility": ANY, "social_facility:for": ["*child*"]}]),
    ("social_services", [{"social_facility": ANY}]),
    (None, [{"amenity": ["shelter"], "shelter_type": ["public_transport"]}]),
    # education
    ("nursery", [{"amenity": ["kindergarten", "childcare"]}, {"building": ["kindergarten"]}]),
    ("university", [{"amenity": ["university"]}, {"building": ["university"]}]),
    ("vocational", [{"amenity": ["college"]}, {"building": ["college"]}]),
    ("nursery", [{"amenity": ["school"], "isced:level": ["0*"]}, {"building": ["school"], "isced:level": ["0*"]}]),
    ("primary_school", [{"amenity": ["school"], "isced:level": ["1*"]}, {"building": ["school"], "isced:level": ["1*"]}]),
    ("secondary_school", [{"amenity": ["school"], "isced:level": ["2*", "3*"]}, {"building": ["school"], "isced:level": ["2*", "3*"]}]),
    ("school", [{"amenity": ["school"]}, {"building": ["school"]}]),
    ("library", [{"amenity": ["library"]}]),
    ("archive", [{"amenity": ["archive"]}]),
    ("research", [{"amenity": ["research_institute"]}]),
    ("vocational", [{"amenity": ["driving_school"]}]),
    # energy and utilities
    ("substation", [{"power": ["substation", "transformer"]}]),
    ("solar_farm", [{"power": ["plant"], "plant:source": ["*solar*"]}, {"power": ["generator"], "generator:source": ["*solar*"]}]),
    ("wind_farm", [{"power": ["plant"], "plant:source": ["*wind*"]}, {"power": ["generator"], "generator:source": ["*wind*"]}]),
    ("power_plant", [{"power": ["plant", "generator"]}]),
    ("power_tower", [{"power": ["tower", "portal"]}]),
    ("water_tower", [{"man_made": ["water_tower"]}]),
    ("water_treatment", [{"man_made": ["water_works", "reservoir_covered"]}]),
    ("wastewater", [{"man_made": ["wastewater_plant"]}]),
    ("pumping_station", [{"man_made": ["pumping_station"]}]),
    ("telecom_mast", [{"man_made": ["mast", "tower"], tag: values} for tag, values in (("tower:type", ["*communication*"]), ("mast:type", ["*communication*"]), ("communication:mobile_phone", ["yes"]))] + [{"man_made": ["communications_tower"]}]),
    (None, [{"man_made": ["mast", "tower"]}]),
    ("silo", [{"man_made": ["silo", "bunker_silo"]}]),
    ("factory", [{"man_made": ["works"]}]),
    ("data_centre", [{"telecom": ["data_center"]}]),
    ("telecom_exchange", [{"telecom": ["exchange"]}]),
    # water
    ("reservoir", [{"water": ["reservoir"]}, {"landuse": ["reservoir"]}, {"natural": ["water"], "water": ["pond", "lake"]}]),
    ("water_point", [{"amenity": ["water_point", "drinking_water"]}]),
    # transport
    ("airport", [{"aeroway": ["aerodrome"]}]),
    ("station", [{"railway": ["station", "halt"]}, {"public_transport": ["station"]}, {"amenity": ["bus_station", "ferry_terminal"]}]),
    ("parking", [{"amenity": ["parking"]}]),
    ("bridge", [{"bridge": ["yes", "viaduct"]}]),
    ("tunnel", [{"tunnel": ["yes"]}]),
    # industry and farming
    ("quarry", [{"landuse": ["quarry"]}, {"man_made": ["mineshaft"]}]),
    ("waste_facility", [{"amenity": ["waste_transfer_station"]}, {"landuse": ["landfill"]}, {"amenity": ["recycling"], "recycling_type": ["centre"]}]),
    ("factory", [{"landuse": ["industrial"]}, {"building": ["industrial"]}]),
    ("warehouse", [{"building": ["warehouse"]}]),
    ("workshop", [{"craft": ANY}]),
    ("farm", [{"landuse": ["farmyard"]}, {"place": ["farm"]}]),
    ("greenhouse", [{"building": ["greenhouse"]}, {"landuse": ["greenhouse_horticulture"]}]),
    ("farm_building", [{"building": ["farm", "farm_auxiliary", "barn", "stable", "cowshed"]}]),
    ("orchard", [{"landuse": ["vineyard", "orchard"]}]),
    ("winery", [{"industrial": ["winery"]}]),
    ("animal_shelter", [{"amenity": ["animal_shelter", "animal_boarding"]}]),
    # tourism
    ("campsite", [{"tourism": ["camp_site", "caravan_site", "camp_pitch"]}]),
    ("hotel", [{"tourism": ["hotel"]}, {"building": ["hotel"]}]),
    ("hostel", [{"tourism": ["hostel", "alpine_hut", "wilderness_hut"]}]),
    ("rural_lodging", [{"tourism": ["guest_house", "chalet", "apartment"]}]),
    ("museum", [{"tourism": ["museum"]}]),
    ("viewpoint", [{"tourism": ["viewpoint"]}]),
    ("picnic_site", [{"tourism": ["picnic_site"]}, {"leisure": ["picnic_table"]}]),
    ("attraction", [{"tourism": ["attraction", "theme_park", "zoo", "aquarium", "gallery"]}]),
    # heritage
    ("castle", [{"historic": ["castle", "fort", "city_gate", "tower"]}]),
    ("church", [{"historic": ["church", "chapel", "monastery", "wayside_shrine"]}]),
    ("monument", [{"historic": ["monument", "memorial"]}]),
    ("archaeological", [{"historic": ["archaeological_site"]}]),
    ("monument", [{"historic": ["ruins"]}]),
    ("church", [{"amenity": ["place_of_worship"]}, {"building": ["church", "chapel", "cathedral", "mosque", "synagogue"]}]),
    # environment
    ("protected_area", [{"leisure": ["nature_reserve"]}, {"boundary": ["protected_area"]}]),
    ("forest", [{"natural": ["wood"]}, {"landuse": ["forest"]}]),
    ("wetland", [{"natural": ["wetland"]}]),
    ("park", [{"leisure": ["park", "garden"]}]),
    ("sports_facility", [{"leisure": ["sports_centre", "stadium", "pitch", "swimming_pool", "golf_course", "water_park", "fitness_centre"]}]),
    # trade and public life
    ("supermarket", [{"shop": ["supermarket", "convenience", "grocery", "general"]}]),
    ("shop", [{"shop": ANY}]),
    ("market", [{"amenity": ["marketplace"]}]),
    ("restaurant", [{"amenity": ["restaurant", "cafe", "bar", "pub", "fast_food", "food_court"]}]),
    ("bank", [{"amenity": ["bank"]}]),
    ("office", [{"amenity": ["townhall", "courthouse", "post_office"]}, {"office": ANY}]),
    ("attraction", [{"amenity": ["community_centre", "theatre", "cinema", "arts_centre", "conference_centre", "exhibition_centre"]}]),
    ("other", [{"amenity": ["grave_yard"]}, {"landuse": ["cemetery"]}]),
    # homes
    ("apartments", [{"building": ["apartments", "dormitory"]}]),
    ("house", [{"building": ["house", "detached", "bungalow", "manor"]}]),
    ("static_caravan", [{"building": ["static_caravan"]}]),
    ("residential_building", [{"building": ["residential", "terrace"]}]),
    ("office", [{"building": ["civic", "public"]}]),
    ("castle", [{"building": ["castle"]}]),
]

# Network classes; a highway of another kind is none, whatever else it is.
NETWORKS: list[tuple[str | None, list[Alternative]]] = [
    ("motorway", [{"highway": ["motorway", "motorway_link"]}]),
    ("primary_road", [{"highway": ["trunk", "trunk_link", "primary", "primary_link"]}]),
    ("secondary_road", [{"highway": ["secondary", "secondary_link", "tertiary"]}]),
    ("local_road", [{"highway": ["unclassified", "residential", "living_street"]}]),
    ("track", [{"highway": ["track"]}]),
    (None, [{"highway": ANY}]),
    ("power_line", [{"power": ["line", "minor_line"]}]),
    ("railway", [{"railway": ["rail", "light_rail", "narrow_gauge", "subway", "tram", "funicular"]}]),
    (None, [{"waterway": ["river", "stream", "canal"]}]),
    ("gas_infrastructure", [{"man_made": ["pipeline"]}]),
]

#: Tags whose case doesn't matter.
FOLDED = {"product"}


def holds(tags: Column, tag: str, values: list[str]) -> Column:
    """Whether a tag has one of the values; false, not null, without the tag."""
    v = F.lower(tags[tag]) if tag in FOLDED else tags[tag]
    if not values:
        return F.coalesce(v != "", F.lit(False))
    whole = [x for x in values if "*" not in x]
    tests = [v.isin(whole)] if whole else []
    tests += [v.contains(x.strip("*")) if x.startswith("*") else v.startswith(x.rstrip("*")) for x in values if "*" in x]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def tag_class(tags: Column, rules: list[tuple[str | None, list[Alternative]]] = RULES) -> Column:
    """The class of an element's tags (a map of strings) by the first rule that holds, null
    where none does."""
    def rule(alternatives: list[Alternative]) -> Column:
        each = [reduce(lambda a, b: a & b, (holds(tags, t, v) for t, v in a.items())) for a in alternatives]
        return reduce(lambda a, b: a | b, each)

    return reduce(lambda c, r: c.when(rule(r[1]), F.lit(r[0])), rules[1:], F.when(rule(rules[0][1]), F.lit(rules[0][0])))
