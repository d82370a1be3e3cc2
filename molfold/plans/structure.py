"""Queries that look for structures in molecules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import canonical as N
from ..functions.columnar import with_molecule
from ..operators import substructure as U
from ..operators.scratch import scratch_path
from . import tables as T
from .pieces import graph_cte
from .registry import query

# Structural alerts and other common groups.
PATTERNS = {
    "nitro": "[N+](=O)[O-]",
    "carboxylic acid": "[CX3](=O)[OX2H1]",
    "amide": "[NX3][CX3](=[OX1])",
    "primary amine": "[NX3;H2;!$(NC=O)]",
    "benzene": "c1ccccc1",
    "nitrile": "C#N",
    "trifluoromethyl": "[#6]C(F)(F)F",
    "sulfonyl": "[#6][SX4](=O)(=O)[!O]",
    "aromatic N next to CH": "n:[cH]",
    "saturated ring": "[C;R;H2]@[C;R;H2]",
}

# the same by hand: (conditions on each atom, (atom, atom, condition on the bond))
_ALIPHATIC = "z = {z} AND NOT aromatic"
_C, _N, _O, _F = (_ALIPHATIC.format(z=z) for z in (6, 7, 8, 9))
_PLAIN = "ord IN (1, 5)"
_BY_HAND = {
    "nitro": ([f"{_N} AND charge = 1", _O, f"{_O} AND charge = -1"], [(0, 1, "ord = 2"), (0, 2, _PLAIN)]),
    "carboxylic acid": ([f"{_C} AND x = 3", _O, f"{_O} AND x = 2 AND num_h = 1"], [(0, 1, "ord = 2"), (0, 2, _PLAIN)]),
    "amide": ([f"{_N} AND x = 3", f"{_C} AND x = 3", f"{_O} AND x = 1"], [(0, 1, _PLAIN), (1, 2, "ord = 2")]),
    "primary amine": ([f"{_N} AND x = 3 AND num_h = 2 AND NOT acyl"], []),
    "benzene": (["z = 6 AND aromatic"] * 6, [(k, k + 1, _PLAIN) for k in range(5)] + [(5, 0, _PLAIN)]),
    "nitrile": ([_C, _N], [(0, 1, "ord = 3")]),
    "trifluoromethyl": (["z = 6", _C, _F, _F, _F], [(0, 1, _PLAIN), (1, 2, _PLAIN), (1, 3, _PLAIN), (1, 4, _PLAIN)]),
    "sulfonyl": (["z = 6", _ALIPHATIC.format(z=16) + " AND x = 4", _O, _O, f"NOT ({_O})"], [(0, 1, _PLAIN), (1, 2, "ord = 2"), (1, 3, "ord = 2"), (1, 4, _PLAIN)]),
    "aromatic N next to CH": (["z = 7 AND aromatic", "z = 6 AND aromatic AND num_h = 1"], [(0, 1, "ord = 5")]),
    "saturated ring": ([f"{_C} AND in_ring AND num_h = 2"] * 2, [(0, 1, "ring")]),
}


def _laid(name: str) -> str:
    """Joins of one row of atoms for each laying of a pattern."""
    atoms, bonds = _BY_HAND[name]
    joins, placed = "ax a0", {0}
    for i, j, kind in sorted(bonds, key=lambda b: (max(b[:2]), b)):
        old, new = (i, j) if i in placed else (j, i)
        edge = f"e{i}_{j}"
        joins += f" JOIN ends {edge} ON {edge}.mol_id = a0.mol_id AND {edge}.idx = a{old}.idx AND {edge}.{kind}"
        if new in placed:
            joins += f" AND {edge}.nbr = a{new}.idx"
        else:
            joins += f" JOIN ax a{new} ON a{new}.mol_id = a0.mol_id AND a{new}.idx = {edge}.nbr"
            placed.add(new)
    conditions = [_of(k, text) for k, text in enumerate(atoms)] + [f"a{i}.idx <> a{j}.idx" for i in range(len(atoms)) for j in range(i)]
    listed = ", ".join(f"a{k}.idx" for k in range(len(atoms)))
    return f"SELECT a0.mol_id, '{name}' AS pattern, CAST(count(DISTINCT list_sort([{listed}])) AS INTEGER) AS n_matches FROM {joins} WHERE {' AND '.join(conditions)} GROUP BY a0.mol_id"


def _of(k: int, text: str) -> str:
    return "(" + re.sub(r"\b(z|aromatic|charge|x|num_h|acyl|in_ring)\b", rf"a{k}.\1", text) + ")"


_AX = f"""WITH {graph_cte()},
 acyls AS (SELECT DISTINCT e.mol_id, e.idx FROM ends e JOIN atoms c ON c.mol_id = e.mol_id AND c.idx = e.nbr AND c.z = 6 AND NOT c.aromatic
   JOIN ends f ON f.mol_id = e.mol_id AND f.idx = e.nbr AND f.ord = 2 JOIN atoms o ON o.mol_id = f.mol_id AND o.idx = f.nbr AND o.z = 8 WHERE e.ord = 1),
 ax AS (SELECT a.*, a.num_h + (SELECT count(*) FROM ends e WHERE e.mol_id = a.mol_id AND e.idx = a.idx) AS x, (a.mol_id, a.idx) IN (SELECT (mol_id, idx) FROM acyls) AS acyl FROM atoms a)"""


@query("k17_substructure_hits", _AX + " " + " UNION ALL ".join(map(_laid, PATTERNS)))
def substructure_hits(spark, sf):
    """How often each molecule holds each of the patterns."""
    return U.pattern_hits(T.molecules(spark, sf).where("mol IS NOT NULL"), PATTERNS)


@query("k18_stored_substructures", f"{_AX} SELECT mol_id, idx_list AS atoms FROM (SELECT a0.mol_id, [a0.idx, a1.idx, a2.idx] AS idx_list FROM ax a0 JOIN ends e ON e.mol_id = a0.mol_id AND e.idx = a0.idx AND e.ord = 2 "
       f"JOIN ax a1 ON a1.mol_id = a0.mol_id AND a1.idx = e.nbr JOIN ends f ON f.mol_id = a0.mol_id AND f.idx = a0.idx AND f.{_PLAIN} JOIN ax a2 ON a2.mol_id = a0.mol_id AND a2.idx = f.nbr "
       f"WHERE {_of(0, _BY_HAND['carboxylic acid'][0][0])} AND {_of(1, _O)} AND {_of(2, _BY_HAND['carboxylic acid'][0][2])})", arrays=("atoms",))
def stored_substructures(spark, sf):
    """Places of a pattern in a stored library, its element and bond counts compared by the scan."""
    path = scratch_path(spark, "structures")
    U.write_library(T.molecules(spark, sf), path)
    return U.search_library(spark, path, PATTERNS["carboxylic acid"])


@query("r09_structural_alerts", f"""{_AX}, hits AS ({_laid('nitro')} UNION ALL {_laid('nitrile')} UNION ALL {_laid('primary amine')})
  SELECT s.mol_id, coalesce(n, 0) AS alerts FROM smi s LEFT JOIN (SELECT mol_id, CAST(count(*) AS INTEGER) AS n FROM hits GROUP BY mol_id) h ON h.mol_id = s.mol_id WHERE NOT broken""", ints=("alerts",))
def structural_alerts(spark, sf):
    """Number of alerts of each molecule, those without any included."""
    wanted = {n: PATTERNS[n] for n in ("nitro", "nitrile", "primary amine")}
    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    return m.select("mol_id", F.size(F.filter(U.match_counts("mol", wanted), lambda n: n > 0)).alias("alerts"))


# classes of atoms split by their neighbours eight times: a key of the structure that needs no labelling
_CLASSES = "c0 AS MATERIALIZED (SELECT mol_id, idx, md5(concat_ws(' ', z, charge, num_h, isotope, aromatic)) AS c FROM atoms)" + "".join(
    f""", c{k + 1} AS MATERIALIZED (SELECT x.mol_id, x.idx, md5(any_value(x.c) || coalesce(string_agg(e.ord || y.c, ' ' ORDER BY e.ord, y.c), '')) AS c
   FROM c{k} x LEFT JOIN ends e ON e.mol_id = x.mol_id AND e.idx = x.idx LEFT JOIN c{k} y ON y.mol_id = e.mol_id AND y.idx = e.nbr GROUP BY x.mol_id, x.idx)"""
    for k in range(8)
)


@query("p17_written_molecules", f"""WITH {graph_cte()}, of_atoms AS (SELECT mol_id, count(*) AS n_atoms, sum(z * (num_h + 1) + 1000 * charge)::BIGINT AS atom_sum, count(*) FILTER (in_ring) AS ring_atoms FROM atoms GROUP BY 1),
  of_bonds AS (SELECT b.mol_id, count(*) AS n_bonds, sum(ord * x.z * y.z)::BIGINT AS bond_sum FROM bonds b JOIN atoms x ON x.mol_id = b.mol_id AND x.idx = b.a JOIN atoms y ON y.mol_id = b.mol_id AND y.idx = b.b GROUP BY 1)
  SELECT mol_id, n_atoms, coalesce(n_bonds, 0) AS n_bonds, atom_sum, coalesce(bond_sum, 0) AS bond_sum, ring_atoms FROM of_atoms LEFT JOIN of_bonds USING (mol_id)""", ints=("n_atoms", "n_bonds", "ring_atoms"))
def written_molecules(spark, sf):
    """Molecules written as canonical text and read again: their sizes and sums over atoms and bonds."""
    texts = T.molecules(spark, sf).where("mol IS NOT NULL").select("mol_id", N.canonical_smiles("mol").alias("smiles"))
    zs = "transform(mol.atoms, x -> x.z)"
    return with_molecule(texts).selectExpr(
        "mol_id", "size(mol.atoms) AS n_atoms", "size(mol.bonds) AS n_bonds", "aggregate(mol.atoms, 0L, (s, x) -> s + x.z * (x.num_h + 1) + 1000 * x.charge) AS atom_sum",
        f"aggregate(mol.bonds, 0L, (s, b) -> s + b.bond_order * {zs}[b.a] * {zs}[b.b]) AS bond_sum", "size(filter(mol.atoms, x -> x.in_ring)) AS ring_atoms",
    )


@query("t05_structures", f"WITH {graph_cte()}, {_CLASSES}, keys AS (SELECT mol_id, md5(string_agg(c, ' ' ORDER BY c)) AS k FROM c8 GROUP BY 1) SELECT min(mol_id) AS first_id, count(*) AS n_molecules FROM keys GROUP BY k")
def structures(spark, sf):
    """Distinct structures, however written: the first molecule of each and how many there are."""
    m = T.molecules(spark, sf).where("mol IS NOT NULL").select("mol_id", N.canonical_smiles("mol").alias("structure"))
    return m.groupBy("structure").agg(F.min("mol_id").alias("first_id"), F.count(F.lit(1)).alias("n_molecules")).drop("structure")
