"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from narralake.plans import chunks, corpus, narrations, quality, runs, signals, streams

FAMILIES = (corpus, quality, chunks, narrations, signals, runs, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for family in FAMILIES for name, fn in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
