"""Registry of named queries: a Spark builder and (when SQL-expressible) a DuckDB twin."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from retentia.functions.columns import round6

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None
    ids: str  # inventory ids covered (SURVEY §2)


REGISTRY: dict[str, Entry] = {}


def finish(df: DataFrame) -> DataFrame:
    """Round every double column half-up to 6 decimals (the twin SQL does the same)."""
    return df.select(*[round6(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
                       for f in df.schema.fields])


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; its output doubles are rounded."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(name, build, sql, ids)
        return fn
    return deco
