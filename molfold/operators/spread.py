"""Use every core on inputs that come in few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_small(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Deal the rows of a small scan out over all cores.

    A file with one row group is read by one task however many cores there
    are; dealing its rows out costs one cheap shuffle and lets the expensive
    per-row work that follows run in parallel.  A scan that already has
    ``per_core`` splits per core is returned unchanged, so large inputs are
    never shuffled here.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
