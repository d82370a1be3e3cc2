"""Places of the ascending order against sorted lists."""

import datetime as dt
import random

import pytest

from molfold.operators.selection import order_statistics


def values(df, column="v", **how):
    return {r.position: r.value for r in order_statistics(df, column, **how).collect()}


rng = random.Random(4)
COLUMNS = {
    "all distinct": ("double", [rng.random() for _ in range(3000)]),
    "few values": ("int", [rng.choice((1, 5, 9)) for _ in range(3000)]),
    "one value in half": ("bigint", [7] * 1500 + [rng.randrange(-(10**6), 10**6) for _ in range(1500)]),
    "far apart": ("double", [s * 10.0**e for e in range(-300, 300) for s in (-1, 1)]),
    "long and close": ("bigint", [2**60 + k for k in range(2000)]),
    "days": ("date", [dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(4000)) for _ in range(2000)]),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_places(spark, name):
    kind, data = COLUMNS[name]
    n, ordered = len(data), sorted(data)
    df = spark.createDataFrame([(v,) for v in data + [None] * 50], f"v {kind}").repartition(3)
    places = [0, 1, n // 3, n // 2, n - 2, -1]
    got = values(df, positions=places, fractions=[0.25, 0.99], few=600 if name == "long and close" else 30, accuracy=50)
    want = {p % n: ordered[p] for p in places} | {int(f * (n - 1)): ordered[int(f * (n - 1))] for f in (0.25, 0.99)}
    assert got == want


def test_nothing_there(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert values(empty, positions=[0, -1], fractions=[0.5]) == {0: None, -1: None}
    some = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (1.0,)], "v double")
    assert values(some, positions=[0, 1, 2]) == {0: 1.0, 1: 1.0, 2: None}
