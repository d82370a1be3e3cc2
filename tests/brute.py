"""Plain-Python brute force used only by tests."""

from __future__ import annotations

import random


def connected_without(n, bonds, skip, start, goal):
    seen, todo = {start}, [start]
    while todo:
        u = todo.pop()
        for k, (a, b) in enumerate(bonds):
            if k == skip or u not in (a, b):
                continue
            v = b if u == a else a
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return goal in seen


def ring_bonds(n, bonds):
    return [connected_without(n, bonds, k, a, b) for k, (a, b) in enumerate(bonds)]


def distances(n, bonds):
    far = 10**6
    d = [[0 if i == j else far for j in range(n)] for i in range(n)]
    for a, b in bonds:
        d[a][b] = d[b][a] = min(d[a][b], 1)
    for k in range(n):
        for i in range(n):
            for j in range(n):
                d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return [[-1 if v == far else v for v in row] for row in d]


def random_sets(seed, count, low, high, universe=2048):
    rng = random.Random(seed)
    return [{rng.randrange(universe) for _ in range(rng.randrange(low, high))} for _ in range(count)]


def words(bits, n_bits=2048):
    out = [0] * (n_bits // 64)
    for b in bits:
        out[b // 64] |= 1 << (b % 64)
    return [w - (1 << 64) if w >> 63 else w for w in out]


def tanimoto(a, b):
    union = len(a | b)
    return len(a & b) / union if union else 0.0
