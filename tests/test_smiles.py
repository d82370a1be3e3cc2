import random

import pytest
from pyspark.sql import functions as F

from molfold.functions import descriptors as D
from molfold.functions import graph as G
from molfold.functions import morgan as M
from molfold.functions.columnar import with_molecule

from . import brute


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, smiles string")
    return with_molecule(df)


def rows(df):
    return df.orderBy("id").collect()


GOOD = {
    # smiles: (atoms, bonds, formula, weight)
    "CCO": (3, 2, "C2H6O", 46.069),
    "c1ccccc1": (6, 6, "C6H6", 78.114),
    "CC(=O)Oc1ccccc1C(=O)O": (13, 13, "C9H8O4", 180.159),
    "ClCCBr": (4, 3, "C2H4BrCl", 143.407),
    "[NH4+]": (1, 0, "H4N", 18.039),
    "[13CH4]": (1, 0, "CH4", 16.043),
    "[Na+].[Cl-]": (2, 0, "ClNa", 58.44),
    "C%10CCCC%10": (5, 5, "C5H10", 70.135),
    "[Fe+2]": (1, 0, "Fe", 55.845),
    ".": (0, 0, "", 0.0),
}


def test_counts_formula_weight(spark):
    df = parsed(spark, list(GOOD))
    out = df.select("id", "smiles", F.size("mol.atoms").alias("n"), F.size("mol.bonds").alias("m"),
                    D.molecular_formula("mol").alias("f"), D.molecular_weight("mol").alias("w"))
    for r in rows(out):
        n, m, f, w = GOOD[r.smiles]
        assert (r.n, r.m, r.f) == (n, m, f), r.smiles
        assert r.w == pytest.approx(w, abs=2e-3)


BAD = {
    "": ("empty SMILES", 0),
    "CC(=O": ("unclosed '('", 5),
    "CCO)": ("unmatched ')'", 4),
    "c1cccc": ("unclosed ring bond", 6),
    "CCXO": ("unexpected character 'X'", 2),
    "[Xyz]": ("unknown element 'X'", 1),
    "[qq]": ("unknown aromatic atom 'Q'", 1),
    "[C": ("expected ']'", 2),
    "[13": ("unterminated bracket atom", 3),
    "[1?]": ("expected element symbol in bracket", 2),
    "C%a": ("expected digits after '%'", 2),
    "C%1": ("expected two digits after '%'", 3),
    "(C)": ("branch without preceding atom", 1),
    "1C": ("ring closure without preceding atom", 1),
    "C11": ("ring closure to itself", 3),
}


def test_errors(spark):
    for r in rows(parsed(spark, list(BAD)).select("id", "smiles", "mol", "error")):
        assert r.mol is None
        assert tuple(r.error) == BAD[r.smiles]


def test_null_input(spark):
    r = with_molecule(spark.createDataFrame([(None,)], "smiles string")).first()
    assert r.mol is None and r.error is None


def test_bracket_fields(spark):
    got = {r.smiles: r.mol.atoms[0] for r in rows(parsed(spark, ["[13CH4]", "[O--]", "[C@@H](C)N", "[C@H](C)N", "[nH]1cccc1", "[300CH4]", "[NH3+3:7]C"]))}
    assert (got["[13CH4]"].isotope, got["[13CH4]"].num_h) == (13, 4)
    assert got["[O--]"].charge == -2
    assert (got["[C@@H](C)N"].chirality, got["[C@H](C)N"].chirality) == (1, 2)
    assert got["[nH]1cccc1"].aromatic and got["[nH]1cccc1"].num_h == 1
    assert got["[300CH4]"].isotope == 0
    assert got["[NH3+3:7]C"].charge == 3


RINGS = ["Cc1ccccc1", "c1ccc2ccccc2c1", "C1CC2CCC1CC2", "C1.C1", "CC1.CC1", "C1CC1C2CC2", "C(C1)(C1)", "C1C2.C12",
         "C12.C1CC2", "C(C.C1)CC1", "C1CC(C2CC2)C1.C3.CC3", "C=1CCCCC=1", "C1CCCCC1C1CCC1", "CC(C)(C)C1CC12CC2"]


def test_ring_bonds_against_reachability(spark):
    for r in rows(parsed(spark, RINGS).where("mol IS NOT NULL")):
        bonds = [(b.a, b.b) for b in r.mol.bonds]
        want = brute.ring_bonds(len(r.mol.atoms), bonds)
        assert [b.in_ring for b in r.mol.bonds] == want, r.smiles
        for i, a in enumerate(r.mol.atoms):
            assert a.in_ring == any(w for w, b in zip(want, bonds) if i in b), r.smiles


def test_graph_against_brute_force(spark):
    df = parsed(spark, RINGS).where("mol IS NOT NULL")
    out = df.select("id", "smiles", "mol", G.distance_matrix("mol").alias("d"), G.graph_diameter("mol").alias("w"),
                    G.connected_components("mol").alias("c"), G.ring_count("mol").alias("r"), G.num_components("mol").alias("k"))
    for r in rows(out):
        n, bonds = len(r.mol.atoms), [(b.a, b.b) for b in r.mol.bonds]
        d = brute.distances(n, bonds)
        assert [list(x) for x in r.d] == d, r.smiles
        assert r.w == max(max(x) for x in d)
        seen = []
        for i in range(n):
            first = min(j for j in range(n) if d[i][j] >= 0)
            if first not in seen:
                seen.append(first)
            assert r.c[i] == seen.index(first)
        assert r.k == len(seen)
        assert r.r == len(bonds) - n + len(seen)


def test_smallest_rings(spark):
    got = {r.smiles: list(r.s) for r in rows(parsed(spark, ["Cc1ccccc1", "C1CC1C2CCC2", "C1CC2CCC1CC2"]).select("id", "smiles", G.smallest_ring_size("mol").alias("s")))}
    assert got["Cc1ccccc1"] == [0, 6, 6, 6, 6, 6, 6]
    assert got["C1CC1C2CCC2"] == [3, 3, 3, 4, 4, 4, 4]
    assert got["C1CC2CCC1CC2"] == [6] * 8


def test_aspirin_descriptors(spark):
    df = parsed(spark, ["CC(=O)Oc1ccccc1C(=O)O"]).withColumn("d", D.descriptors("mol"))
    r = df.select("d.*", D.lipinski_violations().alias("v"), D.qed_score().alias("q")).first()
    assert (r.hbd, r.hba, r.rotatable, r.n_rings, r.n_arom_rings, r.hetero_atoms, r.formal_charge, r.v) == (1, 4, 3, 1, 1, 4, 0, 0)
    assert r.tpsa == pytest.approx(63.60) and r.logp == pytest.approx(1.8239) and r.fraction_csp3 == pytest.approx(1 / 9)
    assert r.q == pytest.approx(0.7318, abs=1e-3)


def test_fingerprint_properties(spark):
    df = parsed(spark, ["CCO", "OCC", "CC(=O)Oc1ccccc1C(=O)O", "O=C(O)c1ccccc1OC(C)=O", ".", ""])
    out = rows(df.select("id", *[M.morgan_hashes("mol", radius=r).alias(f"h{r}") for r in (0, 1, 2)],
                         M.morgan_fingerprint("mol").alias("fp"), M.morgan_counts("mol").alias("c")))
    assert out[0].h2 == out[1].h2 and out[2].h2 == out[3].h2
    assert len(out[2].h0) == 7
    assert set(out[2].h0) < set(out[2].h1) < set(out[2].h2)
    assert sorted(out[2].c) == list(out[2].h2) and sum(out[2].c.values()) == 13 * 3
    assert list(out[2].fp) == brute.words({h % 2048 for h in out[2].h2})
    assert out[4].h2 == [] and set(out[4].fp) == {0}
    assert out[5].h2 is None and out[5].fp is None


def test_random_text_never_fails(spark):
    rng = random.Random(42)
    alphabet = "CNOPSFIBrlcnops[]()=#$:/\\.%0123456789+-@H*aqX"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(2000)]
    df = parsed(spark, texts).withColumn("d", D.descriptors("mol"))
    n = df.where("(mol IS NULL) = (error IS NULL)").count()
    assert n == 0
    assert df.where("mol IS NOT NULL AND d IS NULL").count() == 0


def test_long_chain_is_read_whole(spark):
    r = parsed(spark, ["C" * 3000 + "(O)N"]).select(F.size("mol.atoms").alias("n"), D.molecular_formula("mol").alias("f")).first()
    assert (r.n, r.f) == (3002, "C3000H6003NO")


def test_sql_names(spark):
    from molfold.functions.sqlapi import register_sql

    register_sql(spark)
    r = spark.sql(
        "SELECT s, mol_formula(s) AS f, round(mol_weight(s), 3) AS w, mol_rings(s) AS r, size(smiles_parse(s).mol.atoms) AS n "
        "FROM VALUES ('CCO'), ('c1ccccc1'), ('C(') AS t(s)"
    ).collect()
    got = {x.s: (x.f, x.w, x.r, x.n) for x in r}
    assert got["CCO"] == ("C2H6O", 46.069, 0, 3) and got["c1ccccc1"] == ("C6H6", 78.114, 1, 6)
    assert got["C("][:3] == (None, None, None)
