"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from molfold.llm import ranked_search as R

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(w.translate(LOW) for w in TERM.findall(text or ""))


def plain_ranking(docs, items, k=10):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, question in items:
        scored = []
        for d, b, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // length
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in terms(question).items() if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed=4, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"É{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    text = lambda size: " ".join(rng.choices(words, weights, k=size))
    docs = [(i, text(rng.choice([1, 5, 40, 300]))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(5, docs[3][1]), (5, docs[3][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, " .,"), (2003, text(20000))]
    items = [(i, text(rng.choice([1, 3, 20]))) for i in range(30)] + [(1, "w1 W1 w1 w3"), (1, "w1 W1 w1 w3"), (None, "w7"), (40, None), (41, "unknown words"), (42, "")]
    return docs, items


@pytest.mark.parametrize("shard, block", [(4096, 256), (37, 5)])
def test_rankings(shared, shard, block):
    docs, items = corpus()
    d = shared.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS item_id", "3 AS t").repartition(5)
    i = shared.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS doc_id", "3 AS n")
    got = R.ranked_documents(d, i, shard=shard, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(docs, items)


def test_empty_tables(shared):
    docs, items = corpus(n=10)
    d, i = shared.createDataFrame(docs, "doc_id long, text string"), shared.createDataFrame(items, "item_id long, text string")
    for a, b in ((d.where("false"), i), (d, i.where("false")), (d.where("doc_id = 2000"), i)):
        assert R.ranked_documents(a, b).collect() == []


def test_reading_stops_early():
    """A document far above the rest ends the search after the first positions; a tie at the k-th score does not."""
    rng = np.random.default_rng(1)
    n = 2000
    rows = np.tile(np.arange(n), 3)
    term = np.repeat(np.arange(3), n)
    impacts = rng.integers(1, 100, 3 * n)
    impacts[rows < 5] = 1000 - rows[rows < 5]
    shard = R.Shard(rows, rows, term, impacts)
    got, scores, read = shard.best(np.arange(3), np.array([1, 1, 2]), 5)
    assert got.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == [4 * (1000 - r) for r in range(5)] and read <= 2 * R.STEP
    tied = R.Shard(rows, -rows, term, np.full(3 * n, 7))  # the order of equal scores is the reverse of rows
    got, _, read = tied.best(np.arange(3), np.array([1, 1, 1]), 5)
    assert got.tolist() == [1999, 1998, 1997, 1996, 1995] and read >= n
