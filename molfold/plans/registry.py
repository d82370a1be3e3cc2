"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _lists_as_text(fn: QueryFn, arrays: tuple[str, ...]) -> QueryFn:
    """List columns joined to text, so that results compare as plain values."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in arrays})

    return run


def query(name: str, sql: str | None = None, arrays: tuple[str, ...] = (), ints: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its check.

    ``arrays`` are list columns to compare as text, ``ints`` are columns that
    the SQL side must narrow to 32 bits.
    """

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = _lists_as_text(fn, arrays) if arrays else fn
        if sql is not None:
            changes = [f"array_to_string({c}, '|') AS {c}" for c in arrays] + [f"CAST({c} AS INTEGER) AS {c}" for c in ints]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(changes)}) FROM ({sql})" if changes else sql
        return fn

    return wrap
