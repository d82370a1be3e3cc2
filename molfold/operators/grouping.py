"""Values gathered by key without unbounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): every distinct value of each key and how often it occurs.

    The same form at any size: a key is as many rows as it has values, values
    are counted before the shuffle, and no task builds a list.
    """
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
