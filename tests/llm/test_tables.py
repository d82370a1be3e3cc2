"""Sharding, packing, search, classifier and pipeline."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from molfold.llm import mtree as M
from molfold.llm import packing as P
from molfold.llm import quality as Q
from molfold.llm import sharding as X

SF = "/root/testdata/sf0.001"


# --- sharding ---


def test_shards(shared):
    docs = [(i, "é" * (i % 7) if i % 5 else None) for i in range(1003)] + [(1, "a"), (1, "a"), (None, "b")]
    df = shared.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS slot").repartition(7)
    rows = X.sharded_documents(df, shards=16, seed=3, cell_rows=20).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert X.sharded_documents(df.where("false")).collect() == []
    assert len(X.shuffle_into_shards(df.limit(3), 16).collect()) == 3


def test_matrix_law():
    """Rows add up, and a cell's share of a partition follows the hypergeometric law."""
    ends, cells = np.array([0, 5, 5, 12, 20]), np.array([4, 9, 7])
    draws = []
    for seed in range(3000):
        m = np.array([X.matrix_row(ends, cells, p, seed) for p in range(4)])
        assert m.sum(axis=0).tolist() == cells.tolist() and m.sum(axis=1).tolist() == np.diff(ends).tolist()
        draws.append(m[3, 1])
    assert abs(np.mean(draws) - 8 * 9 / 20) < 0.1
    assert abs(np.var(draws) - 8 * (9 / 20) * (11 / 20) * (12 / 19)) < 0.15


def test_every_order_is_as_likely(shared):
    df = shared.range(4).withColumnRenamed("id", "doc_id").repartition(2).cache()
    seen = Counter()
    for seed in range(120):
        rows = X.shuffle_into_shards(df, 2, seed, cell_rows=2).collect()
        seen[tuple(r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)))] += 1
    assert len(seen) >= 22 and max(seen.values()) <= 16


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(1)
    got = [X.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 50_000) for _ in range(300)]
    assert abs(np.mean(got) - 20_000) < 30 and abs(np.std(got) - np.sqrt(50_000 * 0.24)) < 15


# --- packing ---


def test_plan_is_best_fit_decreasing():
    """With one size the filling of the bins is that of the plain algorithm, piece by piece."""
    rng = random.Random(1)
    for _ in range(40):
        counts = Counter(rng.randint(1, 50) for _ in range(rng.randint(1, 200)))
        room = []
        for n in sorted(counts.elements(), reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                room.append(50 - n)
        plan = P.plan_bins(dict(counts), (50,))
        assert sorted(x for _, n, size, used in plan.bins for x in [size - used] * n) == sorted(room)


def test_packing(shared):
    rng = random.Random(2)
    docs = [(i, "x" * rng.choice([0, 3, 60, 99, 100, 101, 350, rng.randint(0, 130)])) for i in range(400)] + [(1, "dup"), (1, "dup"), (None, "n"), (500, None)] + [(600 + i, "same") for i in range(150)]
    df = shared.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS rank", "3 AS n_tokens")
    rows = P.pack(df, capacities=(40, 70, 100), group_rows=20).collect()
    want = Counter()
    for d, t in docs:
        n = len(t or "") + 1
        want.update((d, k, 100 * k, min(100, n - 100 * k)) for k in range(-(-n // 100)))
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert {r.bin_capacity for r in own} == {P.downsized(at, (40, 70, 100))}
    filled = sum(r.n_tokens for r in rows) / sum(own[0].bin_capacity for own in bins.values())
    assert filled > 0.97
    assert P.pack(df.where("false")).collect() == []


# --- search ---


def plain_top(rows, k=5, every=50):
    entries = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            entries.setdefault((i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)), None)
    out = []
    for i, v in entries:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in entries if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"subtree_rows": 40, "page_rows": 4, "most_routing": 5, "block": 3}])
def test_top_products(shared, options):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows = [(int(i), [float(x) for x in base[i % 6] * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.2]) for i in range(-50, 250)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, [0.0] * 8), (2050, [1e4] * 8)]
    rows += [rows[3], (None, rows[3][1]), (3000, None), (3050, [float("nan")] * 8), (3100, [None] + [1.0] * 7), (3150, [float("inf")] * 8)]
    df = shared.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS cell")
    got = sorted(tuple(r) for r in M.top_products(df, **options).collect())
    assert got == plain_top(rows)


def test_few_vectors(shared):
    df = shared.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in M.top_products(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert M.top_products(df.where("vec_id = 0")).collect() == []
    assert M.top_products(df.where("false")).collect() == []


# --- classifier ---


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    right = np.array([0.95, 0.8, 0.7])
    votes = np.where(rng.random((20_000, 3)) < right, truth[:, None], ~truth[:, None]) + 1
    votes[rng.random((20_000, 3)) < 0.2] = Q.NONE
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    bad = Q.fit_votes(patterns, counts.astype(float))[inverse.ravel()]
    assert ((bad > 0.5) == truth).mean() > 0.93
    assert len(Q.fit_votes(np.zeros((0, 3)), np.zeros(0))) == 0


def classified_corpus():
    rng = random.Random(3)
    syllables = "an be co du el fi go ha".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 5)))
    docs, labels = [], []
    for i in range(600):
        kind = i % 6
        w = [rng.choice(["a", "of", "to"]) if rng.random() < 0.4 else word() for _ in range(rng.randint(30, 120))]
        if kind == 0:
            w = [x + "###" for x in w]
        elif kind == 1:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["nastyword", "foulword"])
        docs.append((i, " ".join(w)))
        if i % 2 or kind in (0,):
            labels.append((i, 0 if kind == 0 else 1, int(kind == 1)))
    return docs, labels


def test_classifier(shared):
    docs, labels = classified_corpus()
    extra = [(1000, None), (1001, ""), (1002, " \n"), (None, docs[2][1]), docs[2]]
    df = shared.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "1 AS keep", "2 AS votes", "3 AS toxic")
    marks = shared.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = Q.classify(df, marks).collect()
    assert len(rows) == len(docs) + len(extra)
    by_id = {r.doc_id: r.keep for r in rows}
    wrong = [i for i, _ in docs if by_id[i] == (i % 6 < 2)]
    assert len(wrong) <= 6
    assert not any(by_id[i] for i in (1000, 1001, 1002))
    kept = Q.keep_good(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r.keep for r in rows)
    again = {(r.doc_id, r.quality, r.toxicity) for r in Q.classify(df.repartition(5), marks).collect()}
    assert again == {(r.doc_id, r.quality, r.toxicity) for r in rows}


def test_classifier_without_labels_or_documents(shared):
    docs = shared.createDataFrame([(1, "a few words of text"), (2, None)], "doc_id long, text string")
    none = shared.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.toxicity for r in Q.classify(docs, none).collect()} == {1: 0.0, 2: 0.0}
    assert Q.classify(docs.where("false"), none).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables not present")
def test_classifier_on_held_out_labels(shared):
    """Trained on every other label, measured on the rest."""
    docs = shared.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = shared.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("odd", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    rows = Q.classify(docs, labels.where("odd")).join(labels.where("NOT odd").withColumnRenamed("quality", "good"), "doc_id").collect()
    good = [r for r in rows if r.good == 1 and r.toxic == 0]
    assert sum(r.keep for r in good) >= 0.95 * len(good)
    junk = [r for r in rows if r.good == 0]
    assert sum(not r.keep for r in junk) >= 0.95 * len(junk)
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(not r.keep for r in toxic) >= 0.8 * len(toxic)


# --- pipeline ---


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline_stages(shared):
    """Every stage on what the one before kept, each against its operator's own report."""
    from molfold.llm.decontaminate import contamination
    from molfold.llm.secrets import scan_secrets

    from .test_minhash import plain_kept

    source = docs = shared.read.parquet(f"{SF}/documents.parquet")
    bench = shared.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(shared, docs, SF).cache()
        ids = [r.doc_id for r in rows.select("doc_id").collect()]
        before = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "packing":
            assert rows.columns == source.columns and set(ids) <= set(before) and len(ids) == len(set(ids))
        if name == "near_duplicates":
            assert sorted(ids) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])
        if name == "decontamination":
            assert sorted(ids) == sorted(r.doc_id for r in contamination(docs, bench).where("NOT contaminated").collect())
        if name == "secrets":
            assert sorted(ids) == sorted(before) and scan_secrets(rows).where("n_assign + n_access + n_hex > 0").count() == 0
            assert rows.where("n_chars <> length(text)").count() == 0
        if name == "packing":
            assert set(ids) == set(before)
        docs = rows
    want = sorted(tuple(r) for r in docs.collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(shared, SF).collect()) == want
