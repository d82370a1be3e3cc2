"""Seeded shuffles and samples of exact size without sorting by random keys.

A Feistel network over a rectangle of a x b cells is a bijection of its cells.
With a and b near the root of the number of rows the rectangle is hardly
larger than the rows; a row that leaves them is sent through again.  So every
row finds its place in the shuffle by itself, from its position alone, and a
sample of m rows is the rows whose place is below m.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import dense_positions

ROUNDS = 6
#: Passes of a row through the network: more are needed with a chance below 64 ** -64.
WALKS = 64


def _mixed(value: Column, seed: int, step: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(step), value)), 1, 8), 16, 10).cast("bigint")


def sides(n: int) -> tuple[int, int]:
    """Sides of the smallest nearly square rectangle of at least n cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(position: Column, n: int, seed: int) -> Column:
    """The place of a position from 0 to n - 1 in the shuffle of a seed."""
    a, b = sides(n)

    def stepped(step: int):
        def left(c: Column) -> Column:
            return F.struct(((c["l"] + _mixed(c["r"], seed, step)) % a).alias("l"), c["r"].alias("r"))

        def right(c: Column) -> Column:
            return F.struct(c["l"].alias("l"), ((c["r"] + _mixed(c["l"], seed, step)) % b).alias("r"))

        return right if step % 2 else left

    def once(p: Column) -> Column:
        cell = F.struct(F.floor(p / b).cast("bigint").alias("l"), (p % b).alias("r"))
        for step in range(ROUNDS):
            cell = F.transform(F.array(cell), stepped(step))[0]
        return F.transform(F.array(cell), lambda c: c["l"] * b + c["r"])[0]

    more = min(a * b - n, WALKS)
    first = once(position.cast("bigint"))
    if not more:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(more)), first, lambda p, _: F.when(p < n, p).otherwise(once(p)))


def seeded_shuffle(df: DataFrame, order: Sequence, seed: int, name: str = "place") -> DataFrame:
    """Rows with their place, 0 to rows - 1, in the shuffle of a seed.

    ``order`` names columns that tell all rows apart; the same rows and seed
    give the same places however they are partitioned.
    """
    n = df.count()
    numbered = dense_positions(df, order, "_position")
    return numbered.withColumn(name, permuted(F.col("_position"), n, seed)).drop("_position")


def seeded_sample(df: DataFrame, order: Sequence, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows, all if there are fewer; every set is as likely as any other of its size."""
    return seeded_shuffle(df, order, seed, "_place").where(F.col("_place") < size).drop("_place")
