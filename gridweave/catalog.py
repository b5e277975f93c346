"""Zone catalogue and other fixed values, and lookups built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone, full name, latitude, longitude, main city, load weight.
ZONES = [
    ("NP15", "North of Path 15", 37.7749, -122.4194, "San Francisco", 0.25),
    ("ZP26", "Fresno/Central Valley", 36.7378, -119.7871, "Fresno", 0.08),
    ("SP15", "South of Path 15", 34.0522, -118.2437, "Los Angeles", 0.35),
    ("SDGE", "San Diego Gas & Electric", 32.7157, -117.1611, "San Diego", 0.08),
    ("SCE", "Southern California Edison", 34.1478, -117.8265, "San Bernardino", 0.15),
    ("PGE_BAY", "PG&E Bay Area", 37.4419, -122.1430, "Palo Alto", 0.05),
    ("PGE_VALLEY", "PG&E Central Valley", 37.6391, -120.9969, "Modesto", 0.02),
    ("SMUD", "Sacramento Municipal Utility District", 38.5816, -121.4944, "Sacramento", 0.02),
]
LOAD_WEIGHTS = {z[0]: z[5] for z in ZONES}

# Population weights of the eastern zones.
POPULATION_WEIGHTS = {
    "WEST": 0.06, "GENESE": 0.05, "CENTRL": 0.04, "NORTH": 0.02, "MHK VL": 0.02, "CAPITL": 0.05,
    "HUD VL": 0.08, "MILLWD": 0.05, "DUNWOD": 0.03, "NYNYC": 0.42, "LONGIL": 0.18,
}

# Resource to zone at ingest, and the later repair mapping.
RESOURCE_ZONE = {
    "CA ISO-TAC": "SYSTEM", "SDGE-TAC": "SDGE", "SCE-TAC": "SCE", "PGE-TAC": "NP15",
    "SMUD-TAC": "SMUD", "BANCSMUD": "SMUD", "BANCMID": "PGE_VALLEY", "LADWP": "SP15",
}
RESOURCE_ZONE_REPAIR = {
    "CA ISO-TAC": "SYSTEM", "PGE-TAC": "NP15", "PGE": "PGE_VALLEY", "SCE-TAC": "SCE",
    "SDGE-TAC": "SDGE", "BANCSMUD": "SMUD", "LADWP": "SP15",
}

# Physical load range of a zone in MW.
LOAD_RANGES = {"SCE": (6000, 25000), "SP15": (1500, 7000), "PGE": (3000, 12000), "SDGE": (1000, 4000)}

# Evening multiplier (default 1), yearly growth (default 0), share of the system load (default 0.1).
EVENING_MULTIPLIER = {"SCE": 1.15, "SP15": 1.08, "LADWP": 1.12}
GROWTH_FACTOR = {"SCE": 0.02, "SP15": 0.015, "LADWP": 0.018}
SCALE_FACTOR = {
    "SCE": 0.32, "SP15": 0.28, "NP15": 0.25, "SDGE": 0.08, "SMUD": 0.04, "PGE_VALLEY": 0.03, "LA_METRO": 0.60,
}

# Components of composite zones, holidays, text of weather codes, expected zones.
COMPOSITES = {"LA_METRO": ["SCE", "SP15"]}
HOLIDAYS = ["01-01", "07-04", "12-25", "11-24", "05-30"]
EXPECTED_ZONES = ["SYSTEM", "NP15", "SCE", "SMUD", "PGE_VALLEY", "SP15", "SDGE"]
WEATHER_TEXT = {
    0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast",
    45: "fog", 48: "depositing rime fog",
    51: "light drizzle", 53: "moderate drizzle", 55: "dense drizzle",
    61: "slight rain", 63: "moderate rain", 65: "heavy rain",
    80: "slight rain showers", 81: "moderate rain showers", 82: "violent rain showers",
    95: "thunderstorm", 96: "thunderstorm with slight hail", 99: "thunderstorm with heavy hail",
}


def lookup(values: dict, key: Column, default=None) -> Column:
    """Value of a fixed dictionary for ``key``, else the default."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def zone_table(spark: SparkSession) -> DataFrame:
    """The zone catalogue as a table."""
    schema = "zone string, full_name string, latitude double, longitude double, city string, weight double"
    return spark.createDataFrame(ZONES, schema)


def pairs_table(spark: SparkSession, values: dict, key: str, value: str, kind: str = "double") -> DataFrame:
    """A fixed dictionary as a two-column table."""
    return spark.createDataFrame(list(values.items()), f"{key} string, {value} {kind}")
