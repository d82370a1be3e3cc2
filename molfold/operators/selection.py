"""Order statistics by narrowing, without sorting the rows.

Sketches that merge in the map tasks bracket each wanted position between two
values, and one more aggregation counts what lies below and inside the bracket.
That repeats inside the brackets until each holds few distinct values, which
are then counted one by one.  A sketch of accuracy a leaves about 4/a of the
rows, so 10^12 rows take three rounds of two scans, and a column of few values
takes one.  Rows never leave the map side, only sketches and counts do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank error of a sketch is the rows over this.
ACCURACY = 2000
#: Distinct values counted one by one in a round, over all brackets.
FEW = 20_000


def order_statistics(df: DataFrame, column: str, positions: Sequence[int] = (), fractions: Sequence[float] = (), few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """(position, value): exact values at places of the ascending order.

    ``positions`` count from 0, negative ones from the end; a fraction f asks
    for place ``floor(f * (n - 1))``.  NULLs and NaN take no part.  Places outside
    the column give NULL.  Equal places are told once.  Works on numbers, dates
    and timestamps.
    """
    spark, kind = df.sparkSession, df.schema[column].dataType
    value = F.col(column)
    rows = df.select(value.alias("v")).where(value.isNotNull() & (~F.isnan(value) if kind.typeName() in ("double", "float") else F.lit(True)))
    total, least, most = rows.agg(F.count("v"), F.min("v"), F.max("v")).first()
    wanted = {p if p >= 0 else total + p for p in positions} | {int(f * (total - 1)) for f in fractions if total}
    found = {p: None for p in wanted if not 0 <= p < total}
    # bracket -> places in it; a bracket is (lowest, highest, rows below), ends included
    open_ = {(least, most, 0): sorted(wanted - found.keys())} if wanted - found.keys() else {}
    while open_:
        open_ = _round(rows, open_, found, few, accuracy)
    schema = f"position bigint, value {kind.simpleString()}"
    return spark.createDataFrame(sorted(found.items()), schema)


def _inside(low, high) -> Column:
    return F.col("v").between(F.lit(low), F.lit(high))


def _round(rows: DataFrame, brackets: dict, found: dict, few: int, accuracy: int) -> dict:
    """Settle the places of small brackets, cut the others; what is left."""
    for (low, high, _), places in brackets.items():
        if low == high:
            found.update(dict.fromkeys(places, low))
    brackets = {b: p for b, p in brackets.items() if b[0] != b[1]}
    if not brackets:
        return {}
    keys = list(brackets)
    sizes = rows.agg(*[c for k, (low, high, _) in enumerate(keys) for c in (F.count_if(_inside(low, high)).alias(f"n{k}"), F.approx_count_distinct(F.when(_inside(low, high), F.col("v"))).alias(f"d{k}"))]).first()
    small, left = [], few
    for k in sorted(range(len(keys)), key=lambda k: sizes[f"d{k}"]):
        if sizes[f"d{k}"] <= left:
            small.append(k)
            left -= sizes[f"d{k}"]
    if small:
        _count_values(rows, {keys[k]: brackets[keys[k]] for k in small}, found)
    large = [k for k in range(len(keys)) if k not in small]
    if not large:
        return {}
    # where the sketch sees the places of each large bracket, a little to both sides
    shares = {k: sorted({min(max((p - keys[k][2]) / sizes[f"n{k}"] + side / accuracy, 0.0), 1.0) for p in brackets[keys[k]] for side in (-2, 2)}) for k in large}
    sketch = rows.agg(*[F.percentile_approx(F.when(_inside(*keys[k][:2]), F.col("v")), F.array(*map(F.lit, shares[k])), accuracy).alias(f"s{k}") for k in large]).first()
    cuts = {k: sorted({keys[k][0], keys[k][1], *(c for c in sketch[f"s{k}"] if keys[k][0] <= c <= keys[k][1])}) for k in large}
    # counts of each cut value and of what lies strictly between two of them
    parts = {k: [p for a, b in zip(c, c[1:], strict=False) for p in ((a, a), (a, b))] + [(c[-1], c[-1])] for k, c in cuts.items()}
    inner = {(k, i): F.count_if((F.col("v") == F.lit(a)) if a == b else (F.col("v") > F.lit(a)) & (F.col("v") < F.lit(b))).alias(f"c{k}_{i}") for k, p in parts.items() for i, (a, b) in enumerate(p)}
    ends = {(k, i): [f(F.when((F.col("v") > F.lit(a)) & (F.col("v") < F.lit(b)), F.col("v"))).alias(f"{f.__name__}{k}_{i}") for f in (F.min, F.max)] for k, p in parts.items() for i, (a, b) in enumerate(p) if a != b}
    counts = rows.agg(*inner.values(), *[c for pair in ends.values() for c in pair]).first()
    rest: dict = {}
    for k, part in parts.items():
        below, places = keys[k][2], brackets[keys[k]]
        for i, (a, b) in enumerate(part):
            n = counts[f"c{k}_{i}"]
            here = [p for p in places if below <= p < below + n]
            if here and a == b:
                found.update(dict.fromkeys(here, a))
            elif here:
                rest[counts[f"min{k}_{i}"], counts[f"max{k}_{i}"], below] = here
            below += n
    return rest


def _count_values(rows: DataFrame, brackets: dict, found: dict) -> None:
    """Places in brackets of few distinct values, from the count of each value."""
    condition = F.lit(False)
    for low, high, _ in brackets:
        condition = condition | _inside(low, high)
    counted = sorted(rows.where(condition).groupBy("v").count().collect())
    for (low, high, below), places in brackets.items():
        waiting = list(places)
        for v, n in counted:
            if low <= v <= high:
                while waiting and waiting[0] < below + n:
                    found[waiting.pop(0)] = v
                below += n
