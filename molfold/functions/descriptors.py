"""Physicochemical descriptors of a parsed molecule (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elements import SYMBOLS, WEIGHTS
from .graph import RING_COUNT_SQL
from .smiles import let

_W = "array(" + ", ".join(f"{w!r}D" for w in WEIGHTS) + ")"
_SYMS = "array(" + ", ".join(f"'{s}'" for s in SYMBOLS) + ")"
_H_WEIGHT = f"{WEIGHTS[1]!r}D"

# Polar surface of nitrogen and oxygen types; first match wins.
# h = attached hydrogens, q = charge, dbl/tri/aro = bonds of that order.
TPSA_NITROGEN = (
    ("x.aromatic AND aro = 2 AND h = 0 AND q = 0", 12.89),
    ("x.aromatic AND aro = 2 AND h = 1 AND q = 0", 15.79),
    ("x.aromatic AND aro >= 3 AND h = 0 AND q = 0", 4.41),
    ("x.aromatic AND q = 1", 14.14),
    ("x.aromatic", 12.89),
    ("q > 0 AND h = 3", 27.64),
    ("q > 0 AND h = 2", 25.59),
    ("q > 0 AND h = 1", 19.03),
    ("q > 0", 0.00),
    ("tri = 1", 23.79),
    ("dbl = 1 AND h = 0", 12.36),
    ("dbl = 1 AND h = 1", 23.85),
    ("h = 2", 26.02),
    ("h = 1", 12.03),
    ("true", 3.24),
)
TPSA_OXYGEN = (
    ("x.aromatic", 13.14),
    ("q < 0", 23.06),
    ("dbl = 1", 17.07),
    ("h = 1", 20.23),
    ("true", 9.23),
)

# logP contribution by atom type; first match wins.
# het = neighbours other than carbon and hydrogen.
LOGP_TYPES = (
    ("x.z = 6 AND x.aromatic AND het > 0", 0.1360),
    ("x.z = 6 AND x.aromatic", 0.1581),
    ("x.z = 6 AND het = 0", 0.1441),
    ("x.z = 6 AND het = 1", 0.0000),
    ("x.z = 6", -0.2035),
    ("x.z = 7 AND x.aromatic", -0.3187),
    ("x.z = 7 AND x.num_h = 2", -1.0190),
    ("x.z = 7 AND x.num_h = 1", -0.7096),
    ("x.z = 7", -0.3187),
    ("x.z = 8 AND x.aromatic", 0.1552),
    ("x.z = 8 AND x.num_h = 1", -0.2893),
    ("x.z = 8", 0.1552),
    ("x.z = 9", 0.4202),
    ("x.z = 15", 0.8612),
    ("x.z = 16", 0.6482),
    ("x.z = 17", 0.6895),
    ("x.z = 35", 0.8456),
    ("x.z = 53", 0.8857),
)
LOGP_CATION_N = -0.5
LOGP_ANION_O = -1.0
LOGP_PER_HYDROGEN = 0.1230

# Fixed values: (descriptor, best, low, high) of the drug-likeness curves.
QED_CURVES = (
    ("mw", 300.0, 150.0, 500.0),
    ("logp", 2.5, -2.0, 6.0),
    ("hba", 4.0, 0.0, 12.0),
    ("hbd", 1.5, 0.0, 6.0),
    ("tpsa", 70.0, 0.0, 150.0),
    ("rotatable", 4.0, 0.0, 12.0),
    ("n_arom_rings", 2.0, 0.0, 5.0),
)

# Rule-of-five limits.
RO5_LIMITS = (("mw", 500.0), ("logp", 5.0), ("hbd", 5), ("hba", 10))


def _case(rules) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v!r}D" for c, v in rules) + " ELSE 0.0D END"


def _count(array: str, var: str, cond: str) -> str:
    return f"size(filter({array}, {var} -> {cond}))"


def _bonds_of(order: int) -> str:
    return f"size(filter(m.adj[i], w -> w.bond_order = {order}))"


def _sum(values: str) -> str:
    return f"aggregate({values}, 0.0D, (acc, v) -> acc + v)"


MW_SQL = f"aggregate(m.atoms, 0.0D, (acc, x) -> acc + {_W}[x.z] + x.num_h * {_H_WEIGHT})"
HEAVY_MW_SQL = f"aggregate(m.atoms, 0.0D, (acc, x) -> acc + {_W}[x.z])"
HBD_SQL = _count("m.atoms", "x", "x.z IN (7, 8) AND x.num_h > 0")
HBA_SQL = _count("m.atoms", "x", "x.z IN (7, 8) AND x.charge <= 0 AND NOT (x.z = 7 AND x.aromatic AND x.num_h > 0)")


def _heavy_degree(i: str) -> str:
    return f"size(filter(m.adj[{i}], w -> m.atoms[w.atom].z > 1))"


def _amide(c: str, n: str) -> str:
    return (
        f"(m.atoms[{c}].z = 6 AND m.atoms[{n}].z = 7 AND "
        f"exists(m.adj[{c}], w -> w.bond_order = 2 AND m.atoms[w.atom].z = 8))"
    )


ROTATABLE_SQL = _count(
    "m.bonds",
    "b",
    f"b.bond_order = 1 AND NOT b.in_ring AND {_heavy_degree('b.a')} >= 2 AND {_heavy_degree('b.b')} >= 2 "
    f"AND NOT {_amide('b.a', 'b.b')} AND NOT {_amide('b.b', 'b.a')}",
)


def _with_bonds(rules) -> str:
    """Substitute the bond counts only into rules that mention them."""
    out = []
    for cond, v in rules:
        for name, order in (("aro", 5), ("tri", 3), ("dbl", 2)):
            cond = cond.replace(f"{name} ", f"{_bonds_of(order)} ")
        for name, field in (("h", "num_h"), ("q", "charge")):
            cond = " ".join(f"x.{field}" if t == name else t for t in cond.split(" "))
        out.append((cond, v))
    return _case(out)


TPSA_SQL = _sum(
    f"transform(m.atoms, (x, i) -> CASE x.z WHEN 7 THEN {_with_bonds(TPSA_NITROGEN)} "
    f"WHEN 8 THEN {_with_bonds(TPSA_OXYGEN)} ELSE 0.0D END)"
)
_HET = "size(filter(m.adj[i], w -> m.atoms[w.atom].z NOT IN (1, 6)))"
LOGP_SQL = _sum(
    "transform(m.atoms, (x, i) -> "
    + _case([(c.replace("het ", f"{_HET} "), v) for c, v in LOGP_TYPES])
    + f" + IF(x.z = 7 AND x.charge > 0, {LOGP_CATION_N!r}D, 0.0D)"
    + f" + IF(x.z = 8 AND x.charge < 0, {LOGP_ANION_O!r}D, 0.0D) + x.num_h * {LOGP_PER_HYDROGEN!r}D)"
)
_SP3 = (
    "size(filter(transform(m.atoms, (x, i) -> x.z = 6 AND NOT x.aromatic AND "
    "NOT exists(m.adj[i], w -> w.bond_order IN (2, 3, 5))), v -> v))"
)
_CARBONS = _count("m.atoms", "x", "x.z = 6")
FSP3_SQL = f"IF({_CARBONS} = 0, 0.0D, cast({_SP3} as double) / {_CARBONS})"
AROM_RINGS_SQL = f"cast(floor({_count('m.bonds', 'b', 'b.bond_order = 5')} / 6) as int)"

# element counts, hydrogens of every atom included, in Hill order
_HYDROGENS = "aggregate(m.atoms, 0, (acc, x) -> acc + x.num_h)"
FORMULA_SQL = let(
    "array_distinct(concat(transform(filter(m.atoms, x -> x.z > 0), x -> x.z), "
    f"IF({_HYDROGENS} > 0, array(1), cast(array() as array<int>))))",
    "zs",
    "array_join(transform(array_sort(transform(zs, z -> named_struct("
    "'rank', CASE WHEN NOT array_contains(zs, 6) THEN 2 WHEN z = 6 THEN 0 WHEN z = 1 THEN 1 ELSE 2 END, "
    f"'sym', {_SYMS}[z], 'n', size(filter(m.atoms, x -> x.z = z)) + IF(z = 1, {_HYDROGENS}, 0)))), "
    "e -> concat(e.sym, IF(e.n > 1, cast(e.n as string), ''))), '')",
)

DESCRIPTOR_SQL = {
    "mw": MW_SQL,
    "heavy_mw": HEAVY_MW_SQL,
    "logp": LOGP_SQL,
    "tpsa": TPSA_SQL,
    "fraction_csp3": FSP3_SQL,
    "heavy_atoms": _count("m.atoms", "x", "x.z > 1"),
    "hetero_atoms": _count("m.atoms", "x", "x.z NOT IN (1, 6)"),
    "hbd": HBD_SQL,
    "hba": HBA_SQL,
    "rotatable": ROTATABLE_SQL,
    "n_rings": RING_COUNT_SQL,
    "n_arom_rings": AROM_RINGS_SQL,
    "n_stereo": _count("m.atoms", "x", "x.chirality <> 0"),
    "formal_charge": "aggregate(m.atoms, 0, (acc, x) -> acc + x.charge)",
}

DESCRIPTORS_SQL = "named_struct(" + ", ".join(f"'{n}', {body}" for n, body in DESCRIPTOR_SQL.items()) + ")"
# over a descriptor struct bound to ``d``
RO5_SQL = " + ".join(f"IF(d.{n} > {limit}, 1, 0)" for n, limit in RO5_LIMITS)
QED_SQL = "pow(" + " * ".join(f"exp(-0.5D * pow((d.{n} - {best}D) / IF(d.{n} < {best}D, {(best - low) / 2.0}D, {(high - best) / 2.0}D), 2))" for n, best, low, high in QED_CURVES) + ", 1.0D / 7.0D)"

# the nine columns of the batch matrix, in its order
MATRIX_COLUMNS = (
    "mw", "logp", "tpsa", "hbd", "hba", "rotatable", "n_rings", "heavy_atoms", "fraction_csp3",
)


def _on(mol: str, body: str) -> Column:
    return F.expr(f"IF({mol} IS NULL, NULL, {let(mol, 'm', body)})")


def molecular_weight(mol: str) -> Column:
    return _on(mol, MW_SQL)


def molecular_formula(mol: str) -> Column:
    return _on(mol, FORMULA_SQL)


def descriptor(mol: str, name: str) -> Column:
    """One descriptor by name."""
    return _on(mol, DESCRIPTOR_SQL[name])


def descriptors(mol: str, names=tuple(DESCRIPTOR_SQL)) -> Column:
    """Struct of the named descriptors; NULL where the parse failed."""
    fields = ", ".join(f"'{n}', {DESCRIPTOR_SQL[n]}" for n in names)
    return _on(mol, f"named_struct({fields})")


def lipinski_violations(d: str = "d") -> Column:
    """Rule-of-five violations of a descriptor struct column."""
    flags = [(F.col(f"{d}.{n}") > limit).cast("int") for n, limit in RO5_LIMITS]
    return sum(flags[1:], flags[0])


def passes_ro5(d: str = "d") -> Column:
    return lipinski_violations(d) <= 1


def qed_score(d: str = "d") -> Column:
    """Geometric mean of seven one-sided Gaussian desirabilities."""
    product = F.lit(1.0)
    for name, best, low, high in QED_CURVES:
        x = F.col(f"{d}.{name}").cast("double")
        sigma = F.when(x < best, (best - low) / 2.0).otherwise((high - best) / 2.0)
        t = (x - best) / sigma
        product = product * F.exp(F.lit(-0.5) * t * t)
    return F.pow(product, F.lit(1.0 / 7.0))


def ligand_efficiency(activity: Column, mw: Column) -> Column:
    """Activity per estimated heavy atom; 0 when the weight is not positive."""
    return F.when(mw <= 0, F.lit(0.0)).otherwise(activity * 1.37 / (mw / 13.0))


def estimated_fraction_csp3(rings: Column, heavy_atoms: Column) -> Column:
    """Estimate from ring and heavy-atom counts; 0 without heavy atoms."""
    return F.when(heavy_atoms == 0, F.lit(0.0)).otherwise(1.0 - (rings * 6).cast("double") / heavy_atoms)
