import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from molfold.functions import bits as B
from molfold.operators import blocked, clusters
from molfold.operators import search as K

from . import brute


def table(spark, sets):
    rows = [(i, brute.words(s), len(s)) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "id bigint, fp array<bigint>, popcnt int")


@pytest.fixture(scope="module")
def sets():
    # a third of the rows are copies, and one row is empty
    base = brute.random_sets(7, 200, 20, 80)
    return base + [set(base[0])] * 100 + [set()]


@pytest.fixture(scope="module")
def db(spark, sets):
    return table(spark, sets).cache()


QUERY = brute.random_sets(11, 1, 40, 41)[0]


@pytest.mark.parametrize("threshold", [0.02, 0.05, 0.2])
def test_threshold_equals_full_scan(db, sets, threshold):
    q = QUERY | set(list(sets[0])[:15])
    want = sorted(((-brute.tanimoto(q, s), i) for i, s in enumerate(sets) if s and brute.tanimoto(q, s) >= threshold))
    for pruned in (True, False):
        got = [(-r.score, r.id) for r in K.threshold_search(db, brute.words(q), threshold, pruned).collect()]
        assert got == want


def test_topk_equals_full_sort(db, sets):
    want = sorted((-brute.tanimoto(QUERY, s), i) for i, s in enumerate(sets) if s)[:20]
    assert [(-r.score, r.id) for r in K.topk_search(db, brute.words(QUERY), 20).collect()] == want
    assert K.topk_search(db, brute.words(QUERY), 0).count() == 0
    assert K.topk_search(db, brute.words(set()), 5).count() == 0
    assert K.threshold_search(db, brute.words(set()), 0.1).count() == 0


def test_band_keeps_boundary_hits():
    for q in range(1, 150):
        for t100 in range(5, 100, 3):
            t = t100 / 100
            lo, hi = K.band(q, t)
            for c in range(1, 300):
                if min(q, c) / max(q, c) >= t:
                    assert lo <= c <= hi


@pytest.mark.parametrize("rows", [4096, 7])
def test_many_queries(spark, db, sets, rows, monkeypatch):
    monkeypatch.setattr(blocked, "ROWS", rows)
    monkeypatch.setattr(blocked, "QUERIES", rows)
    qs = brute.random_sets(3, 6, 20, 60) + [set(sets[0]), set()]
    queries = table(spark, qs)
    hits = {(r.query_id, r.id): r.score for r in K.multi_threshold_search(db, queries, 0.03).collect()}
    want = {(a, b): brute.tanimoto(q, s) for a, q in enumerate(qs) for b, s in enumerate(sets) if q and brute.tanimoto(q, s) >= 0.03}
    assert hits == want
    top = sorted((r.query_id, r["rank"], r.id) for r in K.multi_topk_search(db, queries, 7).collect())
    best = []
    for a, q in enumerate(qs):
        if q:
            order = sorted((-brute.tanimoto(q, s), b) for b, s in enumerate(sets) if s)[:7]
            best += [(a, k + 1, b) for k, (_, b) in enumerate(order)]
    assert top == sorted(best)
    full = {(r.query_id, r.id): r.score for r in K.similarity_matrix(db, queries, pack=3).collect()}
    assert full == {(a, b): brute.tanimoto(q, s) for a, q in enumerate(qs) for b, s in enumerate(sets)}
    sparse = {(r.query_id, r.id): (r.common, r.score) for r in K.sparse_matrix(db, queries, part_rows=rows).collect()}
    assert sparse == {(a, b): (len(q & s), brute.tanimoto(q, s)) for a, q in enumerate(qs) for b, s in enumerate(sets) if q & s}


def test_inverted_index_has_no_row_for_a_meeting(spark, db, sets):
    """Counts come out of blocks; repeated and null ids count together, as one row of all their bits."""
    queries = table(spark, [set(sets[0]), set(sets[1])])
    plan = K.sparse_matrix(db, queries, part_rows=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "on_bits" not in plan and "bit#" not in plan and "FlatMapCoGroups" in plan
    rows = [(1, [3], 2), (1, [3], 2), (1, [5, None], 2), (None, [1], 1), (None, [1], 1), (2, [-1, 1], 65), (3, None, 0), (4, [0], 0)]
    odd = spark.createDataFrame(rows, "id long, fp array<long>, popcnt int")
    asked = spark.createDataFrame([(7, [1], 1), (7, [1], 1), (8, [0, 1], 1), (None, [1 << 62, 3], 3), (9, None, 0)], "id long, fp array<long>, popcnt int")
    got = sorted(((r.query_id, r.id, r.common) for r in K.sparse_matrix(odd, asked, part_rows=2).collect()), key=repr)
    assert got == sorted([(7, 1, 6), (7, None, 4), (7, 2, 2), (8, 2, 1), (None, 2, 2)], key=repr)


def near_sets(universe, count, size):
    rng = random.Random(5)
    out = []
    for _ in range(count):
        s = set(rng.choice(out)) if out and rng.random() < 0.6 else {rng.randrange(universe) for _ in range(size)}
        for _ in range(rng.randrange(4)):
            s ^= {rng.randrange(universe)}
        out.append(s)
    return out + [set(out[0])] * 40


@pytest.mark.parametrize("universe,size", [(2048, 30), (2048, 900)])
@pytest.mark.parametrize("block_rows", [4096, 16])
def test_all_pairs(spark, universe, size, block_rows):
    sets = near_sets(universe, 120, size)
    first, copies = {}, {}
    for i, s in enumerate(sets):
        k = frozenset(s)
        first.setdefault(k, i)
        copies[k] = copies.get(k, 0) + 1
    keys = [k for k in first if k]
    for t in (0.5, 0.8):
        got = {(r.id_a, r.id_b): (r.score, r.copies_a, r.copies_b) for r in K.all_pairs(table(spark, sets), t, block_rows).collect()}
        want = {}
        for x in keys:
            for y in keys:
                if first[x] < first[y] and brute.tanimoto(x, y) >= t:
                    want[(first[x], first[y])] = (brute.tanimoto(x, y), copies[x], copies[y])
        assert got == want and want


def test_neighbour_counts(spark):
    sets = near_sets(2048, 80, 30) + [set()]
    got = {r.id: r.neighbours for r in K.neighbour_counts(table(spark, sets), 0.6).collect()}
    for i, s in enumerate(sets):
        want = sum(1 for j, o in enumerate(sets) if j != i and s and brute.tanimoto(s, o) >= 0.6)
        assert got[i] == want


def test_bit_functions(spark):
    xs, ys = brute.random_sets(1, 200, 0, 90), brute.random_sets(2, 200, 0, 90)
    xs[0], ys[0], xs[1] = set(), set(), set()
    df = spark.createDataFrame(
        [(i, brute.words(x), brute.words(y), sorted(x), sorted(y)) for i, (x, y) in enumerate(zip(xs, ys))],
        "id int, x array<bigint>, y array<bigint>, xs array<int>, ys array<int>",
    )
    out = df.select(
        "id", B.popcount("x").alias("p"), B.intersection("x", "y").alias("c"), B.union_count("x", "y").alias("u"), B.hamming("x", "y").alias("h"),
        B.tanimoto("x", "y").alias("t"), B.tanimoto("y", "x").alias("t2"), B.dice("x", "y").alias("d"), B.cosine("x", "y").alias("o"),
        B.tversky("x", "y", 1, 1).alias("v1"), B.tversky("x", "y", 0.5, 0.5).alias("v2"), B.is_subset("x", "y").alias("s"),
        B.is_subset(B.bit_and("x", "y"), "y").alias("s2"), B.on_bits("x").alias("on"), B.from_bits("xs", 2048).alias("w"), "x",
        B.sparse_tanimoto("xs", "ys").alias("st"),
    )
    for r in out.collect():
        x, y = xs[r.id], ys[r.id]
        assert (r.p, r.c, r.u, r.h) == (len(x), len(x & y), len(x | y), len(x ^ y))
        assert r.t == r.t2 == r.v1 == r.st == brute.tanimoto(x, y) and r.d == pytest.approx(r.v2) and r.d >= r.t and 0 <= r.o <= 1 + 1e-12
        assert r.s == (x <= y) and r.s2 and list(r.on) == sorted(x) and list(r.w) == list(r.x)


def test_database_layout(spark, db, tmp_path):
    K.write_database(db, str(tmp_path / "db"))
    back = K.read_database(spark, str(tmp_path / "db"))
    assert {(r.id, tuple(r.fp)) for r in back.collect()} == {(r.id, tuple(r.fp)) for r in db.collect()}
    plan = K.threshold_search(back, brute.words(QUERY), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(popcnt" in plan and "LessThanOrEqual(popcnt" in plan
    assert K.count_range(back, 30, 50).count() == db.where(F.col("popcnt").between(30, 50)).count()


def test_stored_library_is_pruned_by_the_scan(spark, db, sets, tmp_path):
    K.write_database(db, str(tmp_path / "library"))
    stored = K.read_database(spark, str(tmp_path / "library"))
    words = brute.words(set(sets[0]))
    for threshold in (0.5, 0.8):
        found = K.threshold_search(stored, words, threshold)
        assert "GreaterThanOrEqual(popcnt" in found._jdf.queryExecution().executedPlan().toString()
        assert {r.id for r in found.collect()} == {b for b, s in enumerate(sets) if brute.tanimoto(sets[0], s) >= threshold}
    part = set(sorted(sets[0])[:4])
    inside = K.superset_search(stored, brute.words(part))
    assert "GreaterThanOrEqual(popcnt" in inside._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in inside.collect()} == {b for b, s in enumerate(sets) if part <= set(s)}


def test_threshold_zero_is_refused(db):
    with pytest.raises(ValueError):
        K.multi_threshold_search(db, db, 0)


def test_cluster_search(spark, db, sets, monkeypatch):
    monkeypatch.setattr(clusters, "ROWS", 9)
    qs = brute.random_sets(5, 8, 20, 60) + [set(sets[0]), set()]
    for pivots in (1, 12):
        index = clusters.ClusterIndex(db, pivots)
        for threshold in (0.05, 0.6, 1.0):
            got = {(r.query_id, r.id): r.score for r in index.search(table(spark, qs), threshold).collect()}
            assert got == {(a, b): brute.tanimoto(q, s) for a, q in enumerate(qs) for b, s in enumerate(sets) if q and brute.tanimoto(q, s) >= threshold}
    assert clusters.ClusterIndex(db.where("false")).search(table(spark, qs), 0.5).count() == 0


def test_leading_scores_against_a_full_sort():
    rng = np.random.default_rng(2)
    for k, rows in ((1, 1), (3, 2), (5, 60)):
        score = rng.integers(0, 6, (40, rows)) / 5
        floor = rng.integers(0, 6, 40) / 5
        x, y = blocked._leading(score, floor, k)
        want = [(i, j) for i in range(40) for j in sorted(range(rows), key=lambda j: (-score[i, j], j))[:k] if score[i, j] >= floor[i]]
        assert list(zip(x.tolist(), y.tolist(), strict=True)) == want


def test_pairs_of_small_blocks_are_spread(spark, monkeypatch):
    """Few bytes, many comparisons: blocks are not put together in a few tasks."""
    monkeypatch.setattr(blocked, "ROWS", 16)
    rng = random.Random(3)
    words = [rng.getrandbits(62) for _ in range(400)]
    db = spark.createDataFrame([(i, [w], w.bit_count()) for i, w in enumerate(words)], "id long, fp array<bigint>, popcnt int")
    pairs = K.multi_threshold_search(db, db, 0.5)
    assert pairs.rdd.getNumPartitions() >= 40
    want = sum((a & b).bit_count() * 2 >= (a | b).bit_count() for a in words for b in words)
    assert pairs.count() == want


@pytest.mark.parametrize("threshold", [0.4, 0.8, 1.0])
@pytest.mark.parametrize("words", [1, 3, 32])
def test_rows_given_up_early_are_no_hits(threshold, words):
    """Pairs on both sides of the threshold, in blocks whose rows come in any order of popcount."""
    rng = np.random.default_rng(words)
    fp = rng.integers(0, 2**63, (60, words), dtype=np.uint64) & rng.integers(0, 2**63, (60, words), dtype=np.uint64)
    fp = np.concatenate([fp, fp ^ (np.uint64(1) << rng.integers(0, 12, (60, words)).astype(np.uint64)), fp[:9]])
    n = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)

    def side(at):
        lists = pa.array(fp[at].view(np.int64).tolist(), pa.list_(pa.int64()))
        return pa.table({"id": pa.array(at), "fp": lists, "popcnt": pa.array(n[at], pa.int32()), "copies": pa.array(at * 0 + 1), "cls": pa.array(at * 0), "other": pa.array(at * 0)})

    got = K._block_hits(threshold)(side(rng.permutation(len(fp))), side(rng.permutation(len(fp)))).to_pylist()
    found = {(r["id_a"], r["id_b"]): r["common"] for r in got}
    want = {}
    for a in range(len(fp)):
        for b in range(a + 1, len(fp)):
            common = int(np.bitwise_count(fp[a] & fp[b]).sum())
            if common >= threshold * (n[a] + n[b] - common):
                want[a, b] = common
    assert len(found) == len(got) and want and all(found.get(pair) == common for pair, common in want.items())
    # pairs with few differing bits only are kept for the exact test
    assert all(common >= (threshold - 1e-6) * (n[a] + n[b] - common) for (a, b), common in found.items())
