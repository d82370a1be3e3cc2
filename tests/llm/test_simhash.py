import random

import numpy as np
import pytest
import xxhash

from molfold.llm import simhash as S
from molfold.llm.components import components


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(rows):
    """component of each row, by all pairs."""
    prints = [plain_simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    groups = {find(i): best.get(find(i)) for i in range(len(rows))}
    return sorted(((d, format(prints[i], "016x"), best.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr), groups


def texts():
    rng = random.Random(5)
    vocabulary = ["Wort", "été", "the", "A", "x" * 30, "of", "ñ b", "İ"]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(25)]
    rows = list(enumerate(base)) + [(100 + i, t + "\tEND") for i, t in enumerate(base)] + [(200 + i, base[3]) for i in range(15)]
    return rows + [(300, None), (301, ""), (302, " \n"), (5, base[5]), (5, base[6]), (None, base[7]), (None, None), (303, "long " * 70000)]


def test_against_all_pairs(shared):
    rows = texts()
    df = shared.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root", "3 AS key")
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=repr)
    assert got == plain_groups(rows)[0]


def near_prints(n=300):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 6, dtype=np.int64)
    flips = [0, *(1 << int(b) for b in rng.integers(0, 63, 12))]
    out = {int(b) ^ flips[i] ^ flips[j] ^ flips[k] for b in base for i in range(13) for j in range(i) for k in range(0, 12, 4)}
    return sorted(out)[:n]


@pytest.mark.parametrize("gather", [4096, 8, 2])
def test_links_connect_exactly(shared, gather):
    """Gathered and finely cut meeting places give the same components as all pairs."""
    prints = near_prints()
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {(p, find(p)) for p in prints if any(q != p and find(q) == find(p) for q in prints)}
    links = S.near_links(shared.createDataFrame([(p,) for p in prints], "fp long"), gather=gather)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    assert {(r.node, r.root) for r in components(links).collect()} == want


def test_keep_one(shared):
    rows = texts()
    want = plain_groups(rows)[1].values()
    df = shared.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root")
    kept = S.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(c for c in want if c is not None)
    assert S.keep_one(df).columns == df.columns


def test_empty(shared):
    empty = shared.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == []
    assert S.keep_one(empty).collect() == []


def test_components_chain(shared):
    links = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (7, 7), (None, 3)]
    got = {(r.node, r.root) for r in components(shared.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 201)} | {(500, 500), (501, 500)}
