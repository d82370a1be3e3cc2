"""Names for use inside ``spark.sql``.

Scalars take the text of a molecule, or fingerprints; ``fp_*`` functions are
SQL expressions.  Table functions give the parts of a text as rows and stand in
lateral joins:

    SELECT t.id, a.atom, a.z FROM library t, LATERAL smiles_atoms(t.smiles) a WHERE a.in_ring

Spark runs them as a projection of the row they belong to, without a join.
Texts that do not parse give NULL, or no rows.  ``LEFT JOIN LATERAL`` does not
keep rows without parts, as Spark plans a generator there like an inner join;
join the result to the table where they are wanted.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import canonical as N
from . import descriptors as D
from . import graph as G
from . import morgan as M
from . import smiles as S
from .columnar import parse_batch
from .smiles import _parse_sql, let
from .text import TOKEN_KINDS, TOKENS

# SQL function name -> body over a molecule bound to ``m``
_MOLECULE_FUNCTIONS = {
    "mol_weight": D.MW_SQL,
    "mol_formula": D.FORMULA_SQL,
    "mol_logp": D.LOGP_SQL,
    "mol_tpsa": D.TPSA_SQL,
    "mol_rings": G.RING_COUNT_SQL,
    "mol_descriptors": D.DESCRIPTORS_SQL,
    "mol_qed": let(D.DESCRIPTORS_SQL, "d", D.QED_SQL),
    "mol_ro5_violations": let(D.DESCRIPTORS_SQL, "d", D.RO5_SQL),
}

_COMMON = "aggregate(zip_with(a, b, (x, y) -> bit_count(x & y)), 0, (s, n) -> s + n)"
_ON = "aggregate(transform({}, w -> bit_count(w)), 0, (s, n) -> s + n)"


def _of_counts(ratio: str) -> str:
    counts = f"named_struct('common', {_COMMON}, 'na', {_ON.format('a')}, 'nb', {_ON.format('b')})"
    return let(counts, "k", ratio)


def _share(above: str, below: str) -> str:
    return f"IF({below} = 0, 0.0D, cast({above} AS DOUBLE) / ({below}))"


_FP = "ARRAY<BIGINT>"
# name -> (parameters, body)
_FINGERPRINT_FUNCTIONS = {
    "fp_popcount": (f"a {_FP}", _ON.format("a")),
    "fp_intersection": (f"a {_FP}, b {_FP}", _COMMON),
    "fp_tanimoto": (f"a {_FP}, b {_FP}", _of_counts(_share("k.common", "k.na + k.nb - k.common"))),
    "fp_dice": (f"a {_FP}, b {_FP}", _of_counts(_share("2 * k.common", "k.na + k.nb"))),
    "fp_cosine": (f"a {_FP}, b {_FP}", _of_counts(_share("k.common", "sqrt(cast(k.na AS DOUBLE) * k.nb)"))),
    "fp_tversky": (f"a {_FP}, b {_FP}, alpha DOUBLE, beta DOUBLE", _of_counts(_share("k.common", "alpha * (k.na - k.common) + beta * (k.nb - k.common) + k.common"))),
    "fp_contains": (f"a {_FP}, b {_FP}", "forall(zip_with(a, b, (x, y) -> x & y = y), t -> t)"),
}

_KIND = "CASE " + " ".join(f"WHEN t rlike r'{pattern}' THEN '{kind}'" for pattern, kind in TOKEN_KINDS) + " ELSE 'Unknown' END"
_ATOM = ", ".join(f"'{c}', x.{c}" for c in ("z", "charge", "num_h", "isotope", "aromatic", "in_ring"))
# name -> (parameter, columns, rows); one generator over one row, so that no join is planned
_TABLE_FUNCTIONS = {
    "smiles_atoms": (
        "txt STRING",
        "atom INT, z INT, charge INT, num_h INT, isotope INT, aromatic BOOLEAN, in_ring BOOLEAN, degree INT",
        "SELECT i, x.z, x.charge, x.num_h, x.isotope, x.aromatic, x.in_ring, x.degree FROM (SELECT posexplode("
        + let("smiles_mol(txt)", "m", f"zip_with(m.atoms, m.adj, (x, n) -> named_struct({_ATOM}, 'degree', size(n)))")
        + ") AS (i, x))",
    ),
    "smiles_bonds": ("txt STRING", "a INT, b INT, bond_order INT, in_ring BOOLEAN", "SELECT x.a, x.b, x.bond_order, x.in_ring FROM (SELECT explode(smiles_mol(txt).bonds) AS x)"),
    "smiles_tokens": ("txt STRING", "nth INT, kind STRING, token STRING", f"SELECT i, {_KIND}, t FROM (SELECT posexplode(regexp_extract_all(txt, r'{TOKENS}', 0)) AS (i, t))"),
    "fp_bits": (f"fp {_FP}", "bit INT", "SELECT explode(flatten(transform(fp, (word, w) -> transform(filter(sequence(0, 63), b -> getbit(word, b) = 1), b -> w * 64 + b))))"),
}


def _of_text(kind: str, run: Callable[[pa.Array, pa.Array], pa.Array]):
    """Arrow function of texts from one of atoms and bonds."""

    @F.arrow_udf(kind)
    def of_text(texts: pa.Array) -> pa.Array:
        atoms, bonds, _ = parse_batch(texts).flatten()
        return run(atoms, bonds)

    return of_text


def _molecule():
    @F.arrow_udf(S.MOL_T)
    def molecule(texts: pa.Array) -> pa.Array:
        return parse_batch(texts)

    return molecule


def register_sql(spark: SparkSession) -> list[str]:
    """Define session functions and tell their names.

    ``smiles_parse(text)`` gives ``struct<mol, error>`` as an SQL expression;
    ``smiles_mol``, ``smiles_canonical`` and ``smiles_fingerprint`` (radius 2,
    2048 bits) read Arrow batches.  The ``mol_*`` functions take text, ``fp_*``
    arrays of words of one length; ratios are 0 where both are
    empty, NULL where one is NULL, and
    ``fp_contains(a, b)`` asks whether ``a`` has all bits of ``b``.  Table functions:
    ``smiles_atoms``, ``smiles_bonds``, ``smiles_tokens`` and ``fp_bits``.
    """
    arrow = {
        "smiles_mol": _molecule(),
        "smiles_canonical": _of_text("string", N.texts(canonical=True)),
        "smiles_fingerprint": _of_text("array<bigint>", lambda atoms, bonds: M.fold_layers(atoms, bonds, M.RADIUS, M.N_BITS)),
    }
    for name, function in arrow.items():
        spark.udf.register(name, function)

    def define(name: str, parameters: str, body: str, returns: str = "") -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) {returns} RETURN {body}")

    define("smiles_parse", "txt STRING", _parse_sql("txt"))
    for name, body in _MOLECULE_FUNCTIONS.items():
        define(name, "txt STRING", let("smiles_mol(txt)", "m", f"IF(m IS NULL, NULL, {body})"))
    for name, (parameters, body) in _FINGERPRINT_FUNCTIONS.items():
        define(name, parameters, body)
    for name, (parameters, columns, rows) in _TABLE_FUNCTIONS.items():
        define(name, parameters, rows, f"RETURNS TABLE ({columns})")
    return [*arrow, "smiles_parse", *_MOLECULE_FUNCTIONS, *_FINGERPRINT_FUNCTIONS, *_TABLE_FUNCTIONS]
