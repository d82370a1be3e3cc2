"""Fingerprints stored by bits against plain sets."""

import os

import numpy as np
import pytest

from molfold.operators import sliced as S

from . import brute as P


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    sets = P.random_sets(3, 500, 0, 60, 256) + [set()] * 3 + P.random_sets(5, 20, 3, 5, 256) * 2
    rows = [(i, P.words(s, 256), len(s)) for i, s in enumerate(sets)]
    path = os.path.join(tmp_path_factory.mktemp("sliced"), "db")
    S.write_sliced(spark.createDataFrame(rows + [(-1, None, None)], "id bigint, fp array<bigint>, popcnt int"), path, 256, block=100, n_files=3)
    return path, dict(enumerate(sets))


def test_blocks(spark, library):
    blocks = spark.read.parquet(library[0]).selectExpr("least", "most", "size(ids) AS n", "array_min(counts) AS a", "array_max(counts) AS b").collect()
    assert sum(b.n for b in blocks) == len(library[1]) and all(b.n <= 100 and (b.least, b.most) == (b.a, b.b) for b in blocks)


@pytest.mark.parametrize("query", [1, 7, 500, 503, 530])
@pytest.mark.parametrize("threshold", [0.01, 0.2, 1.0])
def test_threshold(spark, library, query, threshold):
    path, sets = library
    q = sets[query]
    got = {r.id: r.score for r in S.threshold_sliced(spark, path, P.words(q, 256), threshold).collect()}
    assert got == {i: s for i, x in sets.items() if (s := P.tanimoto(q, x)) >= threshold}


@pytest.mark.parametrize("query, k", [(1, 10), (7, 1), (505, 30), (500, 5), (7, 0), (7, 1000)])
def test_topk(spark, library, query, k):
    path, sets = library
    q = sets[query]
    got = [(r.id, r.score) for r in S.topk_sliced(spark, path, P.words(q, 256), k).collect()]
    want = sorted(((i, P.tanimoto(q, x)) for i, x in sets.items() if x), key=lambda r: (-r[1], r[0]))[:k]
    assert got == ([] if not q else want)


def test_only_the_query_bits_are_read(spark, library):
    path, sets = library
    plan = S.threshold_sliced(spark, path, P.words({3, 9}, 256), 0.5)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "bit_3:" in read and "bit_9:" in read and read.count("bit_") == 2
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(most," in pushed and "LessThanOrEqual(least," in pushed


def test_counters():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 700):
        bits = rng.random((40, n)) < rng.random((40, 1))
        got = S.common_counts((np.packbits(r, bitorder="little").tobytes() for r in bits), n)
        assert (got == bits.sum(axis=0)).all()
    assert (S.common_counts([], 5) == 0).all()
