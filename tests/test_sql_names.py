"""Functions and table functions inside ``spark.sql``."""

import pytest
from pyspark.sql import functions as F

from molfold.functions import bits as B
from molfold.functions import descriptors as D
from molfold.functions import graph as G
from molfold.functions import morgan as M
from molfold.functions import text as T
from molfold.functions.columnar import with_molecule
from molfold.functions.sqlapi import register_sql

TEXTS = ["CCO", "OCC", "c1ccccc1", "CC(=O)Nc1ccc(O)cc1", "[Na+].[O-]C", "C(", None, "", "C" * 600]


@pytest.fixture(scope="module")
def library(spark):
    register_sql(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, s string")
    df.createOrReplaceTempView("library")
    return with_molecule(df, "s")


def test_atoms_and_bonds_in_lateral_joins(spark, library):
    got = spark.sql("SELECT l.id, a.atom, a.z, a.in_ring, a.degree FROM library l, LATERAL smiles_atoms(l.s) a")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    atoms = G.explode_atoms(library.where("mol IS NOT NULL"), "id")
    assert sorted((r.id, r.atom, r.z, r.in_ring) for r in got.collect()) == sorted((r.id, r.idx, r.z, r.in_ring) for r in atoms.collect())
    bonds = spark.sql("SELECT l.id, b.a, b.b, b.bond_order, b.in_ring FROM library l, LATERAL smiles_bonds(l.s) b").collect()
    want = library.select("id", F.inline("mol.bonds")).collect()
    assert sorted(map(tuple, bonds)) == sorted(map(tuple, want))


def test_tokens(spark, library):
    got = spark.sql("SELECT l.id, t.* FROM library l, LATERAL smiles_tokens(l.s) t").collect()
    want = library.select("id", F.posexplode(T.tokenize("s"))).select("id", "pos", "col.kind", "col.text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_scores(spark, library):
    got = {r.id: r for r in spark.sql("SELECT id, mol_qed(s) AS q, mol_ro5_violations(s) AS v, mol_descriptors(s).tpsa AS t, smiles_canonical(s) AS k FROM library").collect()}
    want = library.withColumn("d", D.descriptors("mol")).select("id", "s", D.qed_score().alias("q"), D.lipinski_violations().alias("v"), "d.tpsa").collect()
    for r in want:
        assert got[r.id].v == r.v and got[r.id].t == r.tpsa
        assert got[r.id].q == pytest.approx(r.q) if r.q is not None else got[r.id].q is None
    assert got[0].k == got[1].k and got[5].k is None and got[6].k is None


def test_fingerprints(spark, library):
    made = library.select("id", M.morgan_fingerprint("mol").alias("fp"))
    assert {r.id: r.fp for r in made.collect()} == {r.id: r.fp for r in spark.sql("SELECT id, smiles_fingerprint(s) AS fp FROM library").collect()}
    made.createOrReplaceTempView("prints")
    pairs = made.alias("x").join(made.alias("y"), F.col("x.id") % 2 == F.col("y.id") % 2).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    names = {"fp_tanimoto": B.tanimoto, "fp_dice": B.dice, "fp_cosine": B.cosine, "fp_contains": lambda a, b: B.is_subset(b, a), "fp_intersection": B.intersection}
    both = pairs.select("i", "j", *[F.expr(f"{n}(a, b)").alias(n) for n in names], F.expr("fp_tversky(a, b, 0.3, 0.7)").alias("fp_tversky"), *[f("a", "b").alias("want_" + n) for n, f in names.items()], B.tversky("a", "b", 0.3, 0.7).alias("want_fp_tversky"))
    for r in both.collect():
        if TEXTS[r.i] in ("C(", None, "") or TEXTS[r.j] in ("C(", None, ""):
            assert all(r[n] is None for n in [*names, "fp_tversky"])
            continue
        for n in [*names, "fp_tversky"]:
            assert r[n] == r["want_" + n] or r[n] == pytest.approx(r["want_" + n]), (r.i, r.j, n)
    on = spark.sql("SELECT p.id, collect_list(b.bit) AS bits FROM prints p, LATERAL fp_bits(p.fp) b GROUP BY p.id").collect()
    assert {r.id: sorted(r.bits) for r in on} == {r.id: r.b for r in made.select("id", B.on_bits("fp").alias("b")).collect() if r.b}
