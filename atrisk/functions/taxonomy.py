"""The asset taxonomy as a constant dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Subcategory, category, vulnerability, criticality, human-bearing, unit cost
# (EUR per m2), contents ratio, default footprint (m2), default floors, default people.
ROWS = [
    ("nursery", "education", 75, 95, True, 1180, 0.25, 600, 1, 60),
    ("primary_school", "education", 70, 95, True, 1180, 0.25, 1800, 2, 300),
    ("secondary_school", "education", 70, 92, True, 1250, 0.25, 2600, 2, 500),
    ("school", "education", 70, 92, True, 1200, 0.25, 2000, 2, 300),
    ("vocational", "education", 65, 80, True, 1250, 0.35, 2200, 2, 300),
    ("university", "education", 65, 85, True, 1450, 0.45, 4000, 3, 900),
    ("music_school", "education", 65, 70, True, 1250, 0.4, 800, 2, 100),
    ("library", "education", 70, 70, True, 1350, 0.55, 900, 2, 80),
    ("research", "education", 60, 80, True, 1650, 0.9, 2000, 2, 150),
    ("hospital", "healthcare", 60, 100, True, 2100, 0.8, 6000, 4, 400),
    ("primary_care", "healthcare", 65, 95, True, 1550, 0.65, 1400, 2, 90),
    ("clinic", "healthcare", 65, 85, True, 1550, 0.65, 900, 2, 50),
    ("pharmacy", "healthcare", 65, 70, True, 1200, 0.6, 120, 1, 6),
    ("mental_health", "healthcare", 65, 95, True, 1600, 0.55, 1600, 2, 80),
    ("veterinary", "healthcare", 65, 60, True, 1200, 0.55, 300, 1, 10),
    ("care_home", "social_care", 75, 100, True, 1480, 0.4, 2200, 3, 90),
    ("day_centre", "social_care", 70, 85, True, 1350, 0.35, 800, 1, 45),
    ("disability_home", "social_care", 75, 100, True, 1450, 0.4, 900, 2, 30),
    ("shelter", "social_care", 70, 90, True, 1280, 0.3, 900, 2, 50),
    ("childcare_residential", "social_care", 75, 100, True, 1400, 0.35, 900, 2, 30),
    ("social_services", "social_care", 60, 70, True, 1200, 0.35, 500, 2, 25),
    ("fire_station", "emergency", 40, 100, True, 1450, 0.95, 1400, 1, 25),
    ("police", "emergency", 45, 95, True, 1450, 0.7, 1200, 2, 40),
    ("civil_protection", "emergency", 45, 95, True, 1350, 0.7, 900, 1, 20),
    ("ambulance", "emergency", 45, 95, True, 1350, 0.9, 700, 1, 15),
    ("helipad", "emergency", 20, 90, False, 350, 0.1, 900, 1, 0),
    ("emergency_shelter", "emergency", 40, 95, True, 1200, 0.25, 1500, 1, 0),
    ("water_point", "emergency", 15, 90, False, 0, 0.0, 0, 1, 0),
    ("motorway", "transport", 25, 95, False, 0, 0.0, 0, 1, 0),
    ("primary_road", "transport", 30, 95, False, 0, 0.0, 0, 1, 0),
    ("secondary_road", "transport", 35, 85, False, 0, 0.0, 0, 1, 0),
    ("local_road", "transport", 40, 70, False, 0, 0.0, 0, 1, 0),
    ("track", "transport", 55, 60, False, 0, 0.0, 0, 1, 0),
    ("railway", "transport", 35, 90, False, 0, 0.0, 0, 1, 0),
    ("station", "transport", 50, 85, True, 1600, 0.5, 2000, 2, 200),
    ("airport", "transport", 45, 90, True, 1800, 0.7, 8000, 2, 300),
    ("bridge", "transport", 30, 95, False, 0, 0.0, 0, 1, 0),
    ("tunnel", "transport", 25, 90, False, 0, 0.0, 0, 1, 0),
    ("port", "transport", 40, 80, True, 900, 0.6, 5000, 1, 40),
    ("parking", "transport", 45, 35, False, 420, 0.05, 1500, 1, 0),
    ("fuel_station", "transport", 90, 85, True, 900, 1.2, 350, 1, 8),
    ("substation", "energy", 65, 98, False, 2400, 2.5, 1200, 1, 0),
    ("power_line", "energy", 75, 95, False, 0, 0.0, 0, 1, 0),
    ("power_tower", "energy", 55, 90, False, 0, 0.0, 0, 1, 0),
    ("power_plant", "energy", 60, 95, False, 2600, 2.0, 6000, 1, 30),
    ("solar_farm", "energy", 70, 70, False, 480, 0.6, 20000, 1, 0),
    ("wind_farm", "energy", 55, 70, False, 0, 0.0, 0, 1, 0),
    ("gas_infrastructure", "energy", 85, 95, False, 1800, 1.8, 800, 1, 0),
    ("fuel_depot", "energy", 95, 95, False, 1200, 2.5, 3000, 1, 10),
    ("reservoir", "water", 5, 85, False, 0, 0.0, 0, 1, 0),
    ("water_treatment", "water", 45, 90, False, 1600, 1.5, 2500, 1, 10),
    ("water_tower", "water", 30, 80, False, 1400, 0.3, 200, 1, 0),
    ("pumping_station", "water", 55, 85, False, 1500, 1.4, 300, 1, 0),
    ("hydrant", "water", 10, 80, False, 0, 0.0, 0, 1, 0),
    ("wastewater", "water", 45, 75, False, 1500, 1.3, 3000, 1, 8),
    ("telecom_mast", "telecom", 70, 92, False, 0, 0.0, 60, 1, 0),
    ("telecom_exchange", "telecom", 60, 90, False, 2000, 3.0, 600, 2, 5),
    ("data_centre", "telecom", 55, 85, False, 3200, 4.0, 2000, 1, 15),
    ("factory", "industry", 65, 75, True, 720, 0.9, 4000, 1, 80),
    ("warehouse", "industry", 70, 60, True, 520, 0.8, 5000, 1, 20),
    ("hazardous_site", "industry", 90, 98, True, 1500, 2.0, 6000, 1, 40),
    ("chemical_plant", "industry", 90, 95, True, 1900, 2.2, 5000, 1, 60),
    ("quarry", "industry", 30, 45, False, 0, 0.0, 0, 1, 10),
    ("waste_facility", "industry", 85, 65, True, 620, 0.7, 4000, 1, 20),
    ("sawmill", "industry", 95, 60, True, 560, 1.1, 3000, 1, 25),
    ("workshop", "industry", 65, 50, True, 700, 0.8, 400, 1, 8),
    ("farm", "agriculture", 85, 60, True, 480, 0.7, 1200, 1, 4),
    ("farm_building", "agriculture", 88, 45, False, 320, 0.55, 800, 1, 0),
    ("greenhouse", "agriculture", 92, 45, False, 260, 0.8, 2500, 1, 0),
    ("silo", "agriculture", 80, 60, False, 900, 1.5, 300, 1, 0),
    ("winery", "agriculture", 70, 60, True, 1100, 1.6, 1800, 1, 15),
    ("orchard", "agriculture", 90, 40, False, 0, 0.0, 0, 1, 0),
    ("beehives", "agriculture", 95, 30, False, 0, 0.0, 0, 1, 0),
    ("forestry", "agriculture", 95, 45, False, 0, 0.0, 0, 1, 0),
    ("cattle", "livestock", 90, 75, False, 420, 0.4, 1500, 1, 2),
    ("pigs", "livestock", 92, 70, False, 450, 0.45, 1800, 1, 2),
    ("poultry", "livestock", 95, 65, False, 400, 0.55, 2000, 1, 2),
    ("sheep_goats", "livestock", 88, 70, False, 350, 0.35, 1000, 1, 2),
    ("horses", "livestock", 85, 75, False, 520, 0.45, 900, 1, 2),
    ("rabbits", "livestock", 92, 55, False, 400, 0.45, 900, 1, 1),
    ("apiculture", "livestock", 95, 40, False, 0, 0.0, 0, 1, 0),
    ("aquaculture", "livestock", 45, 50, False, 700, 0.7, 1200, 1, 3),
    ("mixed_livestock", "livestock", 90, 70, False, 420, 0.45, 1500, 1, 2),
    ("animal_shelter", "livestock", 88, 75, True, 700, 0.4, 700, 1, 6),
    ("house", "residential", 75, 85, True, 1050, 0.35, 140, 2, 3),
    ("apartments", "residential", 60, 90, True, 980, 0.35, 500, 4, 45),
    ("residential_building", "residential", 68, 85, True, 1000, 0.35, 300, 3, 20),
    ("isolated_dwelling", "residential", 90, 88, True, 1100, 0.35, 220, 2, 4),
    ("static_caravan", "residential", 95, 85, True, 700, 0.4, 40, 1, 3),
    ("shop", "commercial", 60, 50, True, 1100, 0.7, 200, 1, 8),
    ("supermarket", "commercial", 60, 65, True, 1000, 0.9, 1800, 1, 60),
    ("office", "commercial", 55, 50, True, 1250, 0.55, 900, 3, 90),
    ("market", "commercial", 65, 55, True, 1000, 0.7, 1500, 1, 80),
    ("restaurant", "commercial", 65, 45, True, 1150, 0.7, 250, 1, 40),
    ("bank", "commercial", 50, 50, True, 1300, 0.6, 300, 2, 12),
    ("sports_facility", "commercial", 55, 60, True, 950, 0.4, 1800, 1, 120),
    ("campsite", "tourism", 98, 95, True, 260, 0.4, 10000, 1, 350),
    ("hotel", "tourism", 60, 85, True, 1450, 0.55, 2000, 4, 220),
    ("rural_lodging", "tourism", 85, 85, True, 1200, 0.45, 350, 2, 20),
    ("hostel", "tourism", 80, 88, True, 1150, 0.4, 500, 2, 60),
    ("attraction", "tourism", 65, 70, True, 1200, 0.6, 1200, 1, 150),
    ("picnic_site", "tourism", 90, 70, True, 0, 0.0, 0, 1, 40),
    ("viewpoint", "tourism", 70, 55, True, 0, 0.0, 0, 1, 15),
    ("church", "heritage", 65, 75, True, 1500, 0.9, 800, 1, 120),
    ("monument", "heritage", 60, 70, False, 2200, 1.0, 300, 1, 0),
    ("castle", "heritage", 55, 75, True, 2400, 0.8, 1500, 2, 30),
    ("museum", "heritage", 60, 80, True, 1800, 1.5, 1500, 2, 100),
    ("archive", "heritage", 65, 85, True, 1600, 1.8, 900, 2, 20),
    ("archaeological", "heritage", 55, 70, False, 0, 0.0, 0, 1, 0),
    ("protected_area", "environment", 90, 70, False, 0, 0.0, 0, 1, 0),
    ("forest", "environment", 95, 55, False, 0, 0.0, 0, 1, 0),
    ("nature_reserve", "environment", 92, 70, False, 0, 0.0, 0, 1, 0),
    ("wetland", "environment", 45, 65, False, 0, 0.0, 0, 1, 0),
    ("park", "environment", 75, 45, False, 0, 0.0, 0, 1, 20),
    ("population_cell", "population", 50, 100, True, 0, 0.0, 0, 1, 0),
    ("other", "commercial", 55, 40, True, 900, 0.4, 300, 1, 5),
]

# Fixed values.
HAZARDOUS = ["fuel_station", "fuel_depot", "gas_infrastructure", "hazardous_site", "chemical_plant", "waste_facility", "sawmill"]
RESPONSE = ["fire_station", "water_point", "hydrant", "reservoir", "helipad", "ambulance", "civil_protection", "emergency_shelter", "sports_facility"]

SCHEMA = "row_no int, subcategory string, category string, vulnerability double, criticality double, human boolean, unit_cost double, contents_ratio double, def_footprint double, def_floors double, def_people double"


def rows() -> list[tuple]:
    """The rows with their number before them, figures as floating point."""
    return [(i, name, category, float(vulnerable), float(critical), human, *map(float, rest)) for i, (name, category, vulnerable, critical, human, *rest) in enumerate(ROWS)]


def taxonomy(spark: SparkSession) -> DataFrame:
    """One row per subcategory; a constant of a hundred rows, so broadcasting it is safe."""
    return spark.createDataFrame(rows(), SCHEMA)


def oracle() -> str:
    """The same table as SQL values."""
    body = ", ".join("(" + ", ".join([str(r[0]), f"'{r[1]}'", f"'{r[2]}'", f"{r[3]}::double", f"{r[4]}::double", str(r[5]).lower(), *(f"{v}::double" for v in r[6:])]) + ")" for r in rows())
    return f"(select * from (values {body}) t(row_no, subcategory, category, vulnerability, criticality, human, unit_cost, contents_ratio, def_footprint, def_floors, def_people))"
