"""Batch searches against one search at a time."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from molfold.functions import bitsearch as A
from molfold.functions.columnar import with_molecule


def search(n, bonds, start, skip=None):
    near = [[] for _ in range(n)]
    for k, (a, b) in enumerate(bonds):
        if k != skip:
            near[a].append(b)
            near[b].append(a)
    d, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in d:
                d[v] = d[u] + 1
                queue.append(v)
    return [d.get(v, -1) for v in range(n)]


def plain(mol):
    n, bonds = len(mol.atoms), [(x.a, x.b) for x in mol.bonds]
    matrix = [search(n, bonds, s) for s in range(n)]
    rings = [0] * n
    for k, (a, b) in enumerate(bonds):
        around = search(n, bonds, a, skip=k)[b]
        for end in (a, b):
            if around >= 0:
                rings[end] = min(rings[end] or around + 1, around + 1)
    z = [x.z for x in mol.atoms]
    pairs = {min(z[i], z[j]) * 1000000 + max(z[i], z[j]) * 1000 + matrix[i][j] for i in range(n) for j in range(i + 1, n) if matrix[i][j] > 0}
    return matrix, max((d for row in matrix for d in row), default=0), rings, sorted(pairs)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choices(["C", "N", "O", "(C)", "(CO)", "C1CC1", "c1ccccc1", "C1CC2CCC1CC2", "."], k=rng.randrange(1, 12))) + rng.choice(["C", "1", "C1CCCC1"]) for _ in range(150)]
    chains = ["C" * 64, "C" * 65, "C1" + "C" * 70 + "1", "C" * 140 + ".CC", "C1" * 1 + "C" * 130 + "1C1CC1", "C1.C1C2CC2"]
    cubane = "C12C3C4C1C5C2C3C45"
    return ["", None, "C(", "C", "[Na+].[Cl-]", cubane, *chains, *made]


def test_all_measures(spark, texts):
    df = with_molecule(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, smiles string").repartition(2))
    out = df.select("id", "smiles", "mol", A.distance_matrix("mol").alias("d"), A.graph_diameter("mol").alias("w"), A.smallest_ring_size("mol").alias("r"), A.atom_pairs("mol").alias("p"))
    seen = 0
    for r in out.collect():
        if r.mol is None:
            assert (r.d, r.w, r.r, r.p) == (None, None, None, None), r.smiles
        else:
            seen += 1
            assert (r.d, r.w, r.r, r.p) == plain(r.mol), r.smiles
    assert seen > 60


def test_molecules_without_bonds(spark):
    df = with_molecule(spark.createDataFrame([("C",), ("C.C",)], "smiles string"))
    got = {r.smiles: (r.d, r.w, r.r, r.p) for r in df.select("smiles", A.distance_matrix("mol").alias("d"), A.graph_diameter("mol").alias("w"), A.smallest_ring_size("mol").alias("r"), A.atom_pairs("mol").alias("p")).collect()}
    assert got == {"C": ([[0]], 0, [0], []), "C.C": ([[0, -1], [-1, 0]], 0, [0, 0], [])}
    assert df.where(F.lit(False)).select(A.distance_matrix("mol")).collect() == []
