"""Whole queries: views over the driver's tables, the queries of each operator, and the SQL that each must equal."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _part in ("scalar", "filters", "retrieval", "analytics", "catalogue", "maintenance", "stateful", "stores"):
    importlib.import_module(f"{__name__}.{_part}")

__all__ = ["ORACLES", "QUERIES"]
