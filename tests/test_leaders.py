"""Sphere exclusion, joins of crowded fingerprints, and packed bits against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from molfold.functions import bits as B
from molfold.operators import search as K
from molfold.operators.leaders import first_independent, sphere_exclusion


def signed(w):
    return w - (1 << 64) if w >> 63 else w


def library():
    """Near copies of few seeds, a fingerprint of a third of the rows, and rows without bits."""
    rng = random.Random(11)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    words = [rng.choice(seeds) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(110)]
    words += [seeds[0]] * 60 + [0] * 3 + seeds
    rng.shuffle(words)
    return list(enumerate(words))


def score(x, y):
    either = (x | y).bit_count()
    return (x & y).bit_count() / either if either else 0.0


def sequential(rows, threshold):
    near = {i: [j for j, y in rows if i != j and score(x, y) >= threshold] for i, x in rows}
    leader = {}
    for i in sorted(near, key=lambda i: (-len(near[i]), i)):
        if i not in leader:
            for j in [i, *near[i]]:
                leader.setdefault(j, i)
    return {i: (leader[i], len(near[i])) for i, _ in rows}


def table(spark, rows):
    df = spark.createDataFrame([(i, [signed(w)]) for i, w in rows], "id long, fp array<long>")
    return df.withColumn("popcnt", B.popcount("fp"))


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_sphere_exclusion(spark, threshold):
    rows = library()
    got = {r.id: (r.leader, r.neighbours) for r in sphere_exclusion(table(spark, rows), threshold).collect()}
    assert got == sequential(rows, threshold)
    assert len({leader for leader, _ in got.values()}) < len(rows)


def test_sphere_exclusion_of_nothing(spark):
    assert sphere_exclusion(table(spark, []), 0.5).collect() == []
    assert [tuple(r) for r in sphere_exclusion(table(spark, [(7, 0)]), 0.5).collect()] == [(7, 7, 0)]


def test_a_chain_is_decided_in_order(spark):
    nodes = spark.range(7)
    edges = spark.range(6).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted(r.id for r in first_independent(nodes, edges).collect()) == [0, 2, 4, 6]


def test_crowded_fingerprints_keep_their_rows(spark):
    rows = library()
    got = {r.id: r.neighbours for r in K.neighbour_counts(table(spark, rows), 0.8).collect()}
    assert got == {i: n for i, (_, n) in sequential(rows, 0.8).items()}


def test_packed_bits(spark):
    rng = random.Random(3)
    words = [[signed(rng.getrandbits(64)) for _ in range(n)] for n in (1, 2, 4)] + [[0], [-1], [signed(1 << 63)], []]
    df = spark.createDataFrame([(w,) for w in words], "fp array<long>")
    for order in ("little", "big"):
        packed = df.select("fp", B.packed_binary("fp", order).alias("p")).select("fp", "p", B.unpacked("p", order).alias("back")).collect()
        assert all(r.fp == r.back for r in packed)
        if order == "little":
            assert all(bytes(r.p) == b"".join((w % (1 << 64)).to_bytes(8, "little") for w in r.fp) for r in packed)
    flags = [[], [True], [False] * 8 + [True, True], [True] * 8]
    got = spark.createDataFrame([(f,) for f in flags], "f array<boolean>").select(B.packbits("f").alias("p")).collect()
    assert [r.p for r in got] == [[], [128], [0, 192], [255]]
    numbers = [0, 1, 2, 3, 4, 5, 1023, 1024, 1025, (1 << 62) + 1, signed(1 << 63), -1]
    got = spark.createDataFrame([(n,) for n in numbers], "w long").select(B.bit_ceil("w").alias("c")).collect()
    assert [r.c for r in got] == [1, 1, 2, 4, 4, 8, 1024, 1024, 2048, signed(1 << 63), signed(1 << 63), None]
