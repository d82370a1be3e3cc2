"""Seeded places and nearest-first searches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from molfold.operators import search as K
from molfold.operators import shuffling as H


@pytest.mark.parametrize("n", [0, 1, 3, 50, 1000])
def test_every_place_once(spark, n):
    df = spark.range(n).withColumn("place", F.lit("x"))
    places = {}
    for partitions in (1, 5):
        rows = H.seeded_shuffle(df.repartition(partitions), ["id"], seed=7, name="at").collect()
        assert sorted(r["at"] for r in rows) == list(range(n))
        places[partitions] = {r.id: r["at"] for r in rows}
    assert places[1] == places[5]


def test_samples_are_exact_and_even(spark):
    df = spark.range(60)
    seen = Counter()
    for seed in range(10):
        drawn = [r.id for r in H.seeded_sample(df, ["id"], 15, seed).collect()]
        assert len(drawn) == len(set(drawn)) == 15
        seen.update(drawn)
    assert len(seen) >= 50 and max(seen.values()) <= 8
    assert len(H.seeded_sample(df, ["id"], 99, 1).collect()) == 60


def test_far_shells_are_not_read():
    rng = random.Random(4)
    for _ in range(200):
        most, count, k = 128, rng.randrange(1, 100), rng.randrange(1, 8)
        rows = [(n, round(rng.random() * min(n, count) / max(n, count), 2), i) for i, n in enumerate(rng.choices(range(1, most + 1), k=rng.choice([3, 60, 400])))]
        rows = [(n, min(s, min(n, count) / max(n, count)), i) for n, s, i in rows]
        read = []

        def shell(lo, hi):
            read.append((lo, hi))
            return sorted(((s, i) for n, s, i in rows if lo <= n <= hi), key=lambda x: (-x[0], x[1]))[:k]

        want = sorted(((s, i) for _, s, i in rows), key=lambda x: (-x[0], x[1]))[:k]
        assert K.nearest_first(count, k, most, shell) == want
        covered = [n for lo, hi in read for n in range(lo, hi + 1)]
        assert len(covered) == len(set(covered))
    read.clear()
    rows = [(40, 1.0, i) for i in range(9)] + [(90, 0.4, 100)]
    count, k = 40, 5
    assert len(K.nearest_first(40, 5, 128, shell)) == 5 and read == [(36, 44)]


def test_stored_topk(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        words = [sum(1 << b for b in rng.sample(range(63), rng.randrange(0, 40))) for _ in range(2)]
        rows.append((i, words, sum(w.bit_count() for w in words)))
    df = spark.createDataFrame(rows, "id long, fp array<bigint>, popcnt int")
    K.write_database(df, str(tmp_path / "db"))
    db = K.read_database(spark, str(tmp_path / "db"))
    for q in (rows[0][1], rows[5][1], [1, 0], [0, 0]):
        for k in (1, 7, 700):
            assert [tuple(r) for r in K.topk_stored(db, q, k).collect()] == [tuple(r) for r in K.topk_search(df, q, k).collect()]
