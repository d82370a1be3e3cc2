"""Substructure search: which molecules hold a pattern, where and how often."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import ring_count
from ..functions.patterns import Batch, compile_pattern

#: Elements whose numbers a stored library keeps: the common ones of organic molecules.
COUNTED = (6, 7, 8, 9, 15, 16, 17, 35, 53)
_COUNTS = {f"z{z}": f"size(filter(mol.atoms, x -> x.z = {z}))" for z in COUNTED} | {"double": "size(filter(mol.bonds, x -> x.bond_order = 2))", "triple": "size(filter(mol.bonds, x -> x.bond_order = 3))"}


def _on_graph(mol: str, kind: str, run) -> Column:
    return F.arrow_udf(kind)(run).asNondeterministic()(F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds"))


def match_atoms(mol: str, pattern: str) -> Column:
    """``array<array<int>>``: atoms of every place, in the order of the pattern.

    Places on the same set of atoms count once, with the smallest atom numbers
    first; places are in that order too.  NULL for a NULL molecule.
    """
    wanted = compile_pattern(pattern)
    size = len(wanted.atoms)

    def run(atoms: pa.Array, bonds: pa.Array) -> pa.Array:
        batch = Batch(atoms, bonds)
        rows = np.concatenate([np.empty((0, size), np.int64), *wanted.places(batch)])
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.sort(np.unique(np.sort(rows, axis=1), axis=0, return_index=True)[1])]
        owner = batch.molecule[rows[:, 0]]
        local = (rows - batch.base[owner][:, None]).astype(np.int32)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(local.ravel()))
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(batch.n_molecules + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner.take(pa.array(order)), mask=atoms.is_null())

    return _on_graph(mol, "array<array<int>>", run)


def match_counts(mol: str, patterns: dict[str, str]) -> Column:
    """``array<int>``: how many sets of atoms hold each pattern, in the order of ``patterns``."""
    wanted = [compile_pattern(p) for p in patterns.values()]

    def run(atoms: pa.Array, bonds: pa.Array) -> pa.Array:
        batch = Batch(atoms, bonds)
        counts = np.zeros((batch.n_molecules, len(wanted)), np.int32)
        for k, p in enumerate(wanted):
            sets = [np.unique(np.sort(rows, axis=1), axis=0) for rows in p.places(batch)]
            if sets:
                rows = np.unique(np.concatenate(sets), axis=0) if len(sets) > 1 else sets[0]
                counts[:, k] = np.bincount(batch.molecule[rows[:, 0]], minlength=batch.n_molecules)
        ends = np.arange(batch.n_molecules + 1) * len(wanted)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts.ravel()), mask=atoms.is_null())

    return _on_graph(mol, "array<int>", run)


def has_match(mol: str, pattern: str) -> Column:
    """Whether a molecule holds a pattern; stops at the first place of each molecule."""
    wanted = compile_pattern(pattern)

    def run(atoms: pa.Array, bonds: pa.Array) -> pa.Array:
        batch = Batch(atoms, bonds)
        found = np.zeros(batch.n_molecules, bool)
        for rows in wanted.places(batch, each=False):
            found[batch.molecule[rows[:, 0]]] = True
        return pa.array(found, mask=atoms.is_null().to_numpy(zero_copy_only=False))

    return _on_graph(mol, "boolean", run)


def pattern_hits(mols: DataFrame, patterns: dict[str, str], id_col: str = "mol_id", mol: str = "mol") -> DataFrame:
    """One row per molecule and pattern it holds: id, pattern, n_matches."""
    names = F.array(*[F.lit(n) for n in patterns])
    found = mols.select(F.col(id_col), F.explode(F.arrays_zip(names.alias("pattern"), match_counts(mol, patterns).alias("n_matches"))).alias("m"))
    return found.select(id_col, "m.pattern", "m.n_matches").where("n_matches > 0")


def write_library(mols: DataFrame, path: str, id_col: str = "mol_id") -> None:
    """Store molecules with the counts that rule patterns out, sorted so that row groups differ in them.

    Rows without a molecule are left out.
    """
    counted = mols.where("mol IS NOT NULL").select(F.col(id_col), "mol", *[F.expr(text).alias(name) for name, text in _COUNTS.items()], ring_count("mol").alias("rings"))
    counted.repartitionByRange("rings", "double", "z7", id_col).sortWithinPartitions("rings", "double", "z7").write.parquet(path)


def candidates(library: DataFrame, pattern: str) -> DataFrame:
    """Rows whose counts allow the pattern: comparisons of plain columns, which reach the scan."""
    for name, least in compile_pattern(pattern).needs().items():
        if name in library.columns:
            library = library.where(F.col(name) >= least)
    return library


def search_library(spark: SparkSession, path: str, pattern: str, id_col: str = "mol_id") -> DataFrame:
    """id, atoms: every place of a pattern in a stored library."""
    return candidates(spark.read.parquet(path), pattern).select(id_col, F.explode(match_atoms("mol", pattern)).alias("atoms"))
