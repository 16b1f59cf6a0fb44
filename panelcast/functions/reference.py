"""Small fixed tables. All of these are fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# State abbreviation and the two leading digits of its municipality codes.
STATE_CODES = [
    ("AC", 12), ("AL", 27), ("AP", 16), ("AM", 13), ("BA", 29), ("CE", 23), ("DF", 53),
    ("ES", 32), ("GO", 52), ("MA", 21), ("MT", 51), ("MS", 50), ("MG", 31), ("PA", 15),
    ("PB", 25), ("PR", 41), ("PE", 26), ("PI", 22), ("RJ", 33), ("RN", 24), ("RS", 43),
    ("RO", 11), ("RR", 14), ("SC", 42), ("SP", 35), ("SE", 28), ("TO", 17),
]

# Neighbouring states. PE lists SE but not the reverse; kept as given.
NEIGHBOURS = {
    "AC": ["AM", "RO"],
    "AL": ["PE", "SE", "BA"],
    "AP": ["PA"],
    "AM": ["AC", "RO", "MT", "PA", "RR"],
    "BA": ["SE", "AL", "PE", "PI", "TO", "GO", "MG", "ES"],
    "CE": ["PI", "PE", "PB", "RN"],
    "DF": ["GO", "MG"],
    "ES": ["BA", "MG", "RJ"],
    "GO": ["DF", "TO", "BA", "MG", "MS", "MT"],
    "MA": ["PA", "TO", "PI"],
    "MT": ["RO", "AM", "PA", "TO", "GO", "MS"],
    "MS": ["MT", "GO", "MG", "SP", "PR"],
    "MG": ["BA", "ES", "RJ", "SP", "GO", "DF", "MS"],
    "PA": ["AP", "AM", "RR", "MA", "TO", "MT"],
    "PB": ["RN", "CE", "PE"],
    "PR": ["SP", "MS", "SC"],
    "PE": ["AL", "SE", "BA", "PI", "CE", "PB"],
    "PI": ["MA", "TO", "BA", "PE", "CE"],
    "RJ": ["ES", "MG", "SP"],
    "RN": ["PB", "CE"],
    "RS": ["SC"],
    "RO": ["AC", "AM", "MT"],
    "RR": ["AM", "PA"],
    "SC": ["PR", "RS"],
    "SP": ["RJ", "MG", "MS", "PR"],
    "SE": ["AL", "BA"],
    "TO": ["MA", "PA", "MT", "GO", "BA", "PI"],
}

# State, population, climate zone, biome, mean cases, peak season, pattern.
STATE_PROFILES = [
    ("SP", 46000000.0, "tropical", "atlantic_forest", 1500.0, "summer", "endemic"),
    ("RJ", 17000000.0, "tropical", "atlantic_forest", 1200.0, "summer", "endemic"),
    ("MG", 21000000.0, "tropical", "atlantic_forest", 800.0, "summer", "endemic"),
    ("BA", 15000000.0, "tropical", "atlantic_forest", 600.0, "year_round", "endemic"),
    ("PR", 11000000.0, "subtropical", "atlantic_forest", 400.0, "summer", "epidemic"),
    ("SC", 7000000.0, "subtropical", "atlantic_forest", 300.0, "summer", "epidemic"),
    ("RS", 11000000.0, "subtropical", "pampas", 250.0, "summer", "epidemic"),
    ("AM", 4000000.0, "tropical", "amazon", 900.0, "year_round", "endemic"),
    ("PA", 8000000.0, "tropical", "amazon", 700.0, "year_round", "endemic"),
]

# Test, season, last training week, first and last target week.
BACKTEST_SEASONS = [
    ("1", "2022-2023", "2022-06-26", "2022-10-09", "2023-10-08"),
    ("2", "2023-2024", "2023-06-25", "2023-10-08", "2024-10-06"),
    ("3", "2024-2025", "2024-06-23", "2024-10-06", "2025-10-05"),
    ("final", "2025-2026", "2025-06-22", "2025-10-05", "2026-10-04"),
]

# Expected input files, as (table, file name, required).
SOURCE_FILES = [
    ("dengue", "dengue.csv.gz", True),
    ("climate", "climate.csv.gz", True),
    ("climate_forecast", "climate_forecast.csv.gz", False),
    ("population", "datasus_population_2001_2024.csv.gz", True),
    ("environ", "environ_vars.csv.gz", False),
    ("ocean", "ocean_climate_oscillations.csv.gz", False),
    ("regional_map", "map_regional_health.csv", False),
]


def state_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE_CODES, "uf string, code int")


def neighbour_edges(spark: SparkSession) -> DataFrame:
    rows = [(uf, n) for uf, names in NEIGHBOURS.items() for n in names]
    return spark.createDataFrame(rows, "uf string, neighbor string")


def state_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        STATE_PROFILES,
        "state_uf string, population double, climate_zone string, biome string,"
        " avg_cases double, peak_season string, historical_pattern string",
    )
