"""All registered queries of the engine's own operators, with the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cityportrait.plans import allocation, extras, households, places, tables, validation

_MODULES = (allocation, validation, places, extras, households, tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.S.items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.flagship(spark, sf_dir)
