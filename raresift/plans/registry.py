"""Query registry: every entry pairs a Spark builder with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from raresift.plans import analogues


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[analogues.Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``build`` under ``name``; ``sql`` may use the analogue views freely."""

    def register(build):
        if name in ENTRIES:
            raise ValueError(f"query registered twice: {name}")
        ENTRIES[name] = Entry(name, build, sql)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry):
        return lambda spark, sf_dir: entry.build(analogues.Tables(spark, sf_dir))

    return {name: bind(entry) for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        name: analogues.with_views(entry.sql)
        for name, entry in ENTRIES.items()
        if entry.sql is not None
    }
