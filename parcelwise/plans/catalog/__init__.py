"""Registered queries: name -> callable, and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import areas, listing, lookup, register, study, texts, units

_MODULES = (areas, listing, units, lookup, study, register, texts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    merged: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        merged.update(module.QUERIES)
    return merged


def oracle_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for module in _MODULES:
        merged.update(module.ORACLES)
    return merged
