"""Patterns against all ways to lay them on small graphs."""

import random
from itertools import permutations

import pyarrow as pa
import pytest

from molfold.functions import patterns as P
from molfold.functions.columnar import parse_batch, with_molecule
from molfold.operators import substructure as S

PATTERNS = {
    "benzene": "c1ccccc1", "nitro": "[N+](=O)[O-]", "carboxylic acid": "[CX3](=O)[OX2H1]", "aldehyde": "[CX3H1](=O)[#6]", "amide": "[NX3][CX3](=[OX1])", "primary amine": "[NX3;H2;!$(NC=O)]",
    "epoxide": "C1OC1", "azide": "[N-]=[N+]=N", "sulfonamide": "[SX4](=[OX1])(=[OX1])([NX3])", "any ring bond": "*@*", "halogen on ring": "[F,Cl,Br,I][R]", "chain": "[!c]~[!R]", "triple": "C#N", "three": "[D3]", "aromatic nitrogen": "n", "not ring": "[C;R0;!H0]",
}


def plain_places(mol, pattern):
    """Every one-to-one laying of the pattern's atoms, tried one by one."""
    batch = P.Batch(pa.array([mol["atoms"]], ATOMS), pa.array([mol["bonds"]], BONDS))
    fits = [test(batch) for test in pattern.atoms]
    bond = {}
    for x in mol["bonds"]:
        bond[x["a"], x["b"]] = bond[x["b"], x["a"]] = x
    out = set()
    for laid in permutations(range(len(mol["atoms"])), len(pattern.atoms)):
        if all(fits[k][a] for k, a in enumerate(laid)) and all(
            (x := bond.get((laid[a], laid[b]))) and bool(P._BONDS[kind](P.np.array([x["bond_order"]]), P.np.array([x["in_ring"]]))[0]) for a, b, kind in pattern.bonds
        ):
            out.add(tuple(sorted(laid)))
    return out


KIND = parse_batch(pa.array(["C"])).type
ATOMS, BONDS = KIND.field("atoms").type, KIND.field("bonds").type


def small_texts():
    rng = random.Random(11)
    pieces = ["C", "N", "O", "(=O)", "(C)", "C1CC1", "c1ccccc1", "C1OC1", "C#N", "[N+](=O)[O-]", "S(=O)(=O)", "[nH]", "Cl", "F", "=", "N=[N+]=[N-]"]
    texts = {"".join(rng.choices(pieces, k=rng.randrange(1, 4))) for _ in range(400)}
    kept = [t for t, m in zip(sorted(texts), parse_batch(pa.array(sorted(texts))).to_pylist(), strict=True) if m and len(m["atoms"]) <= 7]
    return kept + ["c1ccccc1", "CC=O", "NC(=O)C", "NCC", "C=C=C"]


@pytest.mark.parametrize("name", [n for n in PATTERNS])
def test_all_places(spark, name):
    texts = small_texts()
    mols = parse_batch(pa.array(texts)).to_pylist()
    pattern = P.compile_pattern(PATTERNS[name])
    batch = P.Batch(pa.array([m["atoms"] for m in mols], ATOMS), pa.array([m["bonds"] for m in mols], BONDS))
    got = [set() for _ in mols]
    for rows in pattern.places(batch):
        for row in rows:
            k = batch.molecule[row[0]]
            got[k].add(tuple(sorted(int(a - batch.base[k]) for a in row)))
    for text, mol, found in zip(texts, mols, got, strict=True):
        assert found == plain_places(mol, pattern), (name, text)


def test_blocks_of_places_change_nothing(monkeypatch):
    mols = parse_batch(pa.array(["c1ccccc1" * 3, "C" * 30, "CC(C)(C)C(C)(C)C"]))
    batch = P.Batch(mols.field("atoms"), mols.field("bonds"))
    pattern = P.compile_pattern("*~*~*~*")
    whole = sorted(map(tuple, P.np.concatenate(list(pattern.places(batch))).tolist()))
    monkeypatch.setattr(P, "BLOCK", 5)
    assert sorted(map(tuple, P.np.concatenate(list(pattern.places(batch))).tolist())) == whole


def test_columns(spark):
    texts = ["OC(=O)c1ccccc1C(=O)O", None, "C(", "", "C", "O=C(O)CC(=O)O"]
    df = with_molecule(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "mol_id int, smiles string").repartition(2))
    acid = PATTERNS["carboxylic acid"]
    got = {r.mol_id: r for r in df.select("mol_id", S.match_atoms("mol", acid).alias("a"), S.has_match("mol", acid).alias("h"), S.match_counts("mol", PATTERNS).alias("n")).collect()}
    assert got[0].a == [[1, 2, 0], [9, 10, 11]] and got[0].h and got[0].n[:3] == [1, 0, 2]
    assert [got[k].a for k in (1, 2)] == [None, None] and [got[k].h for k in (1, 2)] == [None, None] and got[4].a == [] and got[4].h is False
    hits = {(r.mol_id, r.pattern): r.n_matches for r in S.pattern_hits(df, {"acid": acid, "ring": "c1ccccc1"}).collect()}
    assert hits == {(0, "acid"): 2, (0, "ring"): 1, (5, "acid"): 2}


def test_counts_rule_out_no_molecule(spark):
    for text in PATTERNS.values():
        needs = P.compile_pattern(text).needs()
        for mol in parse_batch(pa.array(small_texts())).to_pylist():
            if plain_places(mol, P.compile_pattern(text)):
                z = [x["z"] for x in mol["atoms"]]
                have = {f"z{k}": z.count(k) for k in set(z)} | {"double": sum(x["bond_order"] == 2 for x in mol["bonds"]), "triple": sum(x["bond_order"] == 3 for x in mol["bonds"]), "rings": 99}
                assert all(have.get(k, 0) >= v for k, v in needs.items()), (text, needs)


def test_stored_library(spark, tmp_path):
    texts = small_texts()
    df = with_molecule(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "mol_id int, smiles string"))
    path = str(tmp_path / "library")
    S.write_library(df, path)
    for text in (PATTERNS["nitro"], PATTERNS["benzene"], PATTERNS["primary amine"]):
        found = S.search_library(spark, path, text)
        want = df.where("mol IS NOT NULL").select("mol_id", S.has_match("mol", text).alias("h")).where("h")
        assert {r.mol_id for r in found.collect()} == {r.mol_id for r in want.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "GreaterThanOrEqual(z" in plan


@pytest.mark.parametrize("text", ["", "C.C", "C1CC", "C(", "[", "[]", "[Qq]", "C=", "[C;]", "[$(C]"])
def test_errors(text):
    with pytest.raises((ValueError, IndexError)):
        P.compile_pattern(text)
