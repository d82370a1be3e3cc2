"""Spelling variants against comparisons of all pairs."""

import random
import re
import zlib
from collections import Counter

from molfold.llm import spelling as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs, damage=199):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def plain_groups(n):
    form, near = {}, {}
    for w in n:
        close = [v for v in n if is_near(v, w)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], near[w], form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def spelled(shared, n):
    df = shared.createDataFrame(list(n.items()), "word string, n long").selectExpr("*", "1 AS rank", "2 AS node")
    return sorted(map(tuple, S.spelling_groups(df).collect()))


def test_groups(shared):
    rng = random.Random(5)
    n = {}
    for _ in range(60):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 11)))
        for _ in range(8):
            n[word] = rng.choice([5, 6, 5, 30, 150, 151, 4000, 20000])
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcÿ") + word[at:], word[:at] + rng.choice("abcÿ") + word[at + 1 :]])
    n |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "bbbbbb": 5, "cccccccc": 9}
    assert spelled(shared, n) == plain_groups(n)


def test_long_words(shared):
    long = "".join(random.Random(2).choice("abcd") for _ in range(700))
    n = {long: 500, long[:300] + long[301:]: 6, long[:-1]: 5, "x" + long: 100, long[:64] + "z" + long[65:]: 7, long[::-1]: 9, "q" * 200: 50, "q" * 201: 5}
    assert spelled(shared, n) == plain_groups(n)


def test_all_words_of_one_place(shared):
    """One skipped place of as many words as there are letters."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    n = {f"wor{c}den": 5 + k for k, c in enumerate(letters)} | {"worden": 1000}
    assert spelled(shared, n) == plain_groups(n)


def test_counts(shared):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeÉé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    docs = [(i if i % 40 else None, " ".join(rng.choice([w, w.upper()]) for w in rng.choices(vocabulary, k=60)) + "_x1don't") for i in range(120)] + [(5, None), (6, ""), (7, "Straße" * 3), (7, "Straße" * 3)]
    df = shared.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS run")
    assert dict(map(tuple, S.word_counts(df).collect())) == plain_counts(docs)
    assert dict(map(tuple, S.word_counts(df, damage=None).collect())) == plain_counts(docs, None)
    assert any(h for h in (plain_counts(docs).keys() ^ plain_counts(docs, None).keys())) or plain_counts(docs) != plain_counts(docs, None)
    assert S.spelling_groups(S.word_counts(df.where("false"))).collect() == []
