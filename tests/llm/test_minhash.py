"""The pipeline's near-duplicate stage against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from molfold.llm import minhash as M


def plain_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def plain_kept(rows):
    """Smallest id of each group, by all pairs."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def edited():
    """Texts with copies of 1 to 6 changed words: similarities on both sides of 0.8."""
    rng = random.Random(8)
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 30, 120, 200]))]
        rows.append((10 * base, " ".join(words)))
        for k in range(1, 7):
            copy = list(words)
            for at in rng.sample(range(len(copy)), min(k, len(copy))):
                copy[at] = f"new{rng.randrange(10**6)}"
            rows.append((10 * base + k, " ".join(copy)))
    return rows + [(1000, None), (1001, " \n"), (1002, rows[4][1]), (1003, rows[9][1].upper())]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_stage_keeps_one_of_each_similar_group(shared, block):
    """Whole meeting places and those cut into blocks."""
    rows = edited()
    df = shared.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS same", "2 AS key")
    kept = M.keep_one_similar(df, block=block)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_sets_meet_by_their_fingerprints(shared):
    """With one band of 60 least values hardly any pair of 0.97 shares it; two differing bits or fewer are enough."""
    rng = random.Random(5)
    rows, close, unlike = [], 0, 0
    for base in range(60):
        words = [f"w{rng.randrange(9000)}" for _ in range(400)]
        copy = [*words[:-2], "other", "end"]
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(copy))]
        a, b = (M.shingle_set(" ".join(w).encode()) for w in (words, copy))
        near = (M.majority([a]) ^ M.majority([b])).bit_count() <= 2
        close += near
        unlike += near and not set(M.band_keys(a, 1, 60)) & set(M.band_keys(b, 1, 60))
    assert unlike > 10
    kept = M.keep_one_similar(shared.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=60)
    left = {r.doc_id for r in kept.collect()}
    assert len(left) <= 120 - close and all(2 * base in left for base in range(60))


def test_index_is_shuffled_as_numbers(shared, monkeypatch):
    """Before sets are asked for by their digests, whatever is exchanged row by row of the index holds fixed numbers only."""
    plans = []
    keep = M.checkpointed

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df)

    monkeypatch.setattr(M, "checkpointed", kept)
    rows = edited()
    M.keep_one_similar(shared.createDataFrame(rows, "doc_id long, text string"))
    [met] = [p for p in plans if "explode(keys" in p]
    grouped = [line for line in met.splitlines() if "Aggregate [key" in line]
    assert grouped and not any("same" in line or "decimal" in line for line in grouped)
    exploded = [line for line in met.splitlines() if "Generate explode(keys" in line]
    assert len(exploded) == 2 and not any("same" in line for line in exploded)


def test_stage_of_the_pipeline(shared):
    """An edited copy far beyond two differing bits goes, a text of less than 0.8 stays."""
    rows = edited()
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(shared, shared.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)
    assert stage(shared, got.where("false"), "").collect() == []


def test_bands_meet_as_often_as_promised():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(400):
        drawn = rng.integers(0, 2**64, 100, dtype=np.uint64)
        a, b = np.sort(drawn[:90]), np.sort(drawn[10:])  # 80 of 100
        met += bool(set(M.band_keys(a, 20, 5)) & set(M.band_keys(b, 20, 5)))
    assert met >= 398
