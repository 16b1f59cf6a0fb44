"""Schemas of the raw tables."""

from __future__ import annotations

from panelcast.operators.merge import CLIMATE

FLAGS = ", ".join(f"{r}_{i} boolean" for r in ("train", "target") for i in (1, 2, 3))

SCHEMAS = {
    "dengue": f"date date, epiweek int, geocode int, uf string, casos bigint, {FLAGS}",
    "climate": "date date, epiweek int, geocode int, " + ", ".join(f"{c} double" for c in CLIMATE),
    "climate_forecast": "reference_month date, geocode int",
    "population": "geocode int, year int, population bigint",
    "environ": "geocode int, koppen string, biome string",
    "ocean": "date date, enso double, iod double, pdo double",
    "regional_map": "geocode int",
}
