"""Named queries over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "regime_transitions"

for _part in ("bars", "features", "labels", "evaluation", "models", "streams", "sources", "research"):
    _m = import_module(f"tidegauge.plans.{_part}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
