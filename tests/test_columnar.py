"""The batch parser against the expression that reads one text at a time."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from molfold.functions import columnar as C
from molfold.functions import smiles as S

FIXED = [
    "C", "CC", "C=C", "C#N", "CCl", "ClCBr", "c1ccccc1", "C1CCCCC1", "C%10CCCC%10", "C%101CCCC%10CC1", "C(C)(C)C", "CC(=O)O", "C(((C)))C", "N1CCN(CC1)C", "[NH4+]", "[13CH3][C@@H](N)O",
    "[Fe++]", "[O-]C", "[O--]", "[nH]1cccc1", "c1cc2ccccc2cc1", "C12CCC(CC1)CC2", "C1CC1C1CC1", "C=1CCCCC1", "C1CCCCC=1", "C=1CCCCC#1", "F/C=C\\F", "C$C", "c1:c:c:c:c:c1", "[Na+].[Cl-]", "C.C.C", "C(.C)C", "C..C",
    ".C", "C.", "[H][H]", "[*]", "[2H]O", "[300C]", "[C+200]", "[CH300]", "[CH99999999999999999999]", "[C:12]", "[se]1cccc1", "BrBr", "B", "b1ccccc1", "s1cccc1", "p1ccccc1", "o1cccc1", "I", "P(=O)(O)O", "C==C", "C=-C", "C-(C)",
    "C(=)C", "C1C2C1C2", "C11", "C1C1", "CC11C", "C12CC12", "C1.C1", "C1CC.C1", "C1CC.C1CC", "C12.C1CC2", "C1.C1C2CC2", "C12.C1.C2", "C123.C1.C2.C3CC", "N1.C1.C1CC1", "c1ccccc1-c1ccncc1", "C0CC0", "CC(C)(", "CC)", "(C)", "C()C", "1CC1", "C1CC", "[C", "C]", "[]", "[C@@@]", "[Xx]", "[xx]", "CX", "Cl1", "%12", "C%1", "C%1C", "C%", "C[C", "C[[C]]",
    "", " ", "é", "C é", "[é]", "CC\n", "*", "=C", "=", "C=", "C=.C", "C(=O", "lC", "rB", "C1CC(C1", "C1(CC1)", "C(1)CC1", "(1)", "C(C1)CC1", "N#Cc1ccccc1C(=O)N[C@H](C)C(=O)[O-]", "C" * 300, "C" * 200 + "(C" * 60 + ")" * 60,
]


def made(rng):
    """A text of random pieces: mostly correct, some not."""
    pieces = ["C", "c", "N", "O", "n", "Cl", "Br", "[NH3+]", "[13C]", "[O-]", "=", "#", "-", ":", "/", ".", "1", "2", "3", "%11", "(", ")", "(C)", "(=O)", "c1ccccc1", "C1CC1", "[nH]", "S", "$"]
    return "".join(rng.choices(pieces, k=rng.randrange(1, 14)))


def test_same_as_one_at_a_time(spark):
    rng = random.Random(20)
    texts = FIXED + [None] + [made(rng) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, smiles string").repartition(3)
    one = {r.id: (r.smiles, r.p) for r in df.select("id", "smiles", S.parse_smiles("smiles").alias("p")).collect()}
    batch = {r.id: r for r in C.with_molecule(df).collect()}
    for i, (text, p) in one.items():
        assert (batch[i].mol, batch[i].error) == ((p.mol, p.error) if p is not None else (None, None)), text
    assert sum(p is not None and p.mol is not None for _, p in one.values()) > 300


def test_no_rows_and_sliced_batches():
    assert len(C.parse_batch(pa.array([], pa.string()))) == 0
    whole = pa.array(["CC", None, "c1ccccc1", "C(", "N"])
    assert C.parse_batch(whole.slice(2)).to_pylist() == C.parse_batch(whole).to_pylist()[2:]
    assert C.parse_batch(pa.array([None, ""], pa.string())).to_pylist() == [None, None]


def test_long_chains_take_linear_time():
    import time

    def seconds(n):
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            C.parse_batch(pa.array(["C" * n + "(C)" * n, "C1" + "C" * n + "1"]))
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(200_000) < 20 * seconds(20_000) + 0.2


@pytest.mark.parametrize("text, atom", [("[13CH3-]", (6, -1, 3, 13, False, 0)), ("[n+]", (7, 1, 0, 0, True, 0)), ("[C@@H2]", (6, 0, 2, 0, False, 1)), ("[CH]x]", None)])
def test_bracket_atoms(text, atom):
    assert C.bracket_atom(text) == atom


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([("C", 1), ("X", 2)], "smiles string, key int")
    got = C.with_molecule(df).select("key", "smiles", F.size("mol.atoms").alias("n"), "error.message").collect()
    assert {r.key: (r.smiles, r.message) for r in got} == {1: ("C", None), 2: ("X", "unexpected character 'X'")} and max(r.n or -1 for r in got) == 1
