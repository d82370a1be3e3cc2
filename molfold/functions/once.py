"""Evaluate an expensive column exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Like ``withColumn``, but later filters and projections reuse the value.

    Catalyst is free to push a filter on a derived column below the projection
    that computes it, and to merge neighbouring projections; both repeat the
    computation.  A one-element generator is a boundary for both, costs no
    shuffle and keeps the row count.
    """
    return df.select("*", F.explode_outer(F.array(column)).alias(name))
