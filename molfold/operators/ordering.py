"""Order-dependent operators that stay distributed.

A window without a partition key sorts everything in one task.  Here the rows
are first assigned to consecutive key ranges, numbered or summed inside their
range, and then shifted by the total of the ranges before them.  Only one row
per range is gathered for that shift.

Ranges are those of a range partitioning.  Rows are written once with the
number of their range, so every later pass, however often it is recomputed,
sees a row in the same range, and none repeats the work before it.
All order columns sort ascending; pass ``-F.col("x")`` to reverse a number.
The order must be total (add a unique column last).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def _key(order: Sequence) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


def with_range(df: DataFrame, order: Sequence, ranges: int | None = None, name: str = "_range") -> DataFrame:
    """Adds the number of the key range of each row, stored in the shared folder."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return written(df.repartitionByRange(n, *cols).withColumn(name, F.spark_partition_id()), "ranges")


def prefix_sum(
    df: DataFrame, order: Sequence, value: Column, name: str = "running", ranges: int | None = None
) -> DataFrame:
    """Running total of ``value`` up to and including each row."""
    parts = with_range(df.withColumn("_v", value), order, ranges)
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    inside = Window.partitionBy("_range").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    running = parts.withColumn("_in", F.sum("_v").over(inside))
    totals = parts.groupBy("_range").agg(F.sum("_v").alias("_sum"))
    # one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    out = running.join(F.broadcast(shift), "_range").withColumn(name, F.col("_in") + F.col("_shift"))
    return out.drop("_range", "_v", "_in", "_shift")


def dense_positions(df: DataFrame, order: Sequence, name: str = "position", ranges: int | None = None) -> DataFrame:
    """0-based position of every row in a total order."""
    out = prefix_sum(df, order, F.lit(1).cast("bigint"), "_pos", ranges)
    return out.withColumn(name, F.col("_pos") - 1).drop("_pos")


def zip_by_position(left: DataFrame, left_order: Sequence, right: DataFrame, right_order: Sequence) -> DataFrame:
    """Pairs the rows of two tables by position; the shorter one decides."""
    a = dense_positions(left, left_order, "position")
    b = dense_positions(right, right_order, "position")
    return a.join(b, "position")


def rotate(df: DataFrame, order: Sequence, shift: int, n_rows: int) -> DataFrame:
    """Positions after moving the first ``shift`` rows to the end."""
    pos = dense_positions(df, order)
    return pos.withColumn("position", F.pmod(F.col("position") - shift, F.lit(n_rows)))


def chunk(df: DataFrame, order: Sequence, size: int) -> DataFrame:
    """Adds ``chunk``: consecutive groups of ``size`` rows."""
    return dense_positions(df, order).withColumn("chunk", F.floor(F.col("position") / size))


def take_while(df: DataFrame, order: Sequence, predicate: Column) -> DataFrame:
    """Rows before the first one that fails the predicate."""
    key = _key(order)
    first = df.where(~F.coalesce(predicate, F.lit(False))).agg(F.min(key)).scalar()
    return df.withColumn("_first", first).where(F.col("_first").isNull() | (key < F.col("_first"))).drop("_first")


def drop_while(df: DataFrame, order: Sequence, predicate: Column) -> DataFrame:
    """Rows from the first one that fails the predicate on."""
    key = _key(order)
    first = df.where(~F.coalesce(predicate, F.lit(False))).agg(F.min(key)).scalar()
    return df.withColumn("_first", first).where(F.col("_first").isNotNull() & (key >= F.col("_first"))).drop("_first")


def is_sorted(df: DataFrame, position: str, value: str) -> DataFrame:
    """One row: whether ``value`` never falls along ``position``.

    Each row is compared with the row at the next position through a join on
    the position, so no task needs the whole table.
    """
    nxt = df.select((F.col(position) - 1).alias(position), F.col(value).alias("_next"))
    return df.join(nxt, position).agg(F.coalesce(F.bool_and(F.col(value) <= F.col("_next")), F.lit(True)).alias("sorted"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """Element at position n div 2 of the sorted values (no interpolation).

    Values are counted first, and the running count over distinct values finds
    the element, so heavy repetition does not concentrate rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    running = prefix_sum(counts, [value], F.col("_n"), "_upto").withColumn("_total", total)
    return running.where(F.col("_upto") > F.floor(F.col("_total") / 2)).agg(F.min(value).alias("median"))
