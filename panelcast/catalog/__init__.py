"""All named queries. Importing this package registers them."""

import importlib

from panelcast.catalog.registry import ORACLE, QUERIES

MODULES = ["panel", "prep", "features", "metrics", "forecasts", "learned", "ensembles", "validation", "reports", "submissions", "storage"]
for _name in MODULES:
    importlib.import_module(f"panelcast.catalog.{_name}")

__all__ = ["ORACLE", "QUERIES"]
