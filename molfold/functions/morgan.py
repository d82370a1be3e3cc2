"""Circular (Morgan) fingerprints.

Neighbourhood hashing needs wrapping 32-bit arithmetic, so it runs as an
Arrow-native function.  Each Arrow batch is handled as flat numpy arrays over
all atoms of all molecules in it; nothing loops over molecules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import popcount
from .once import with_once

# Fixed values of the hash functions.
GOLDEN = np.uint32(0x9E3779B9)
MIX_1 = np.uint32(0x85EBCA6B)
MIX_2 = np.uint32(0xC2B2AE35)

RADIUS = 2
N_BITS = 2048


def combine(seed, value):
    """Fold one unsigned 32-bit value into a seed (arrays or scalars)."""
    return seed ^ (value + GOLDEN + (seed << np.uint32(6)) + (seed >> np.uint32(2)))


def mix(x):
    """Avalanche the bits of unsigned 32-bit values."""
    x = (x ^ (x >> np.uint32(16))) * MIX_1
    x = (x ^ (x >> np.uint32(13))) * MIX_2
    return x ^ (x >> np.uint32(16))


def _u32(values) -> np.ndarray:
    return np.asarray(values).astype(np.int64).astype(np.uint32)


def _lists(column: pa.Array):
    """Flat values and per-row lengths of a list column (NULL counts as empty)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), lengths


def _field(structs: pa.StructArray, name: str) -> np.ndarray:
    return structs.field(name).to_numpy(zero_copy_only=False)


def _invariants(at, heavy_degree, order_sum, features: bool, chirality: bool) -> np.ndarray:
    z, q, h = at["z"], at["charge"], at["num_h"]
    if features:
        polar = (z == 7) | (z == 8)
        flags = (polar & (h > 0), polar, at["aromatic"], q > 0, q < 0, np.isin(z, (6, 9, 17, 35)))
        return mix(_u32(sum(f.astype(np.int64) << i for i, f in enumerate(flags))))
    parts = [heavy_degree, order_sum, z, at["isotope"], q.astype(np.int64) + 128, h, at["in_ring"]]
    if chirality:
        parts.append(at["chirality"])
    seed = np.zeros(len(z), dtype=np.uint32)
    for part in parts:
        seed = combine(seed, _u32(part))
    return mix(seed)


def hash_layers(atom_lists, bond_lists, radius: int, features: bool, chirality: bool):
    """Row number of each atom and one hash array per radius 0..radius."""
    atoms, n_atoms = _lists(atom_lists)
    bonds, n_bonds = _lists(bond_lists)
    row = np.repeat(np.arange(len(n_atoms)), n_atoms)
    at = {f: _field(atoms, f) for f in
          ("z", "charge", "num_h", "isotope", "aromatic", "in_ring", "chirality")}
    base = np.repeat(np.cumsum(n_atoms) - n_atoms, n_bonds)
    a, b, order = _field(bonds, "a") + base, _field(bonds, "b") + base, _field(bonds, "bond_order")
    src, dst, code = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([order, order])
    keep = at["z"][dst] != 1
    src, dst, code = src[keep].astype(np.int64), dst[keep].astype(np.int64), code[keep]
    n = len(row)
    heavy_degree = np.bincount(src, minlength=n)
    order_sum = np.bincount(src, weights=np.where(code == 5, 1, code), minlength=n).astype(np.int64)
    current = _invariants(at, heavy_degree, order_sum, features, chirality)
    layers = [current]
    starts = np.cumsum(heavy_degree) - heavy_degree
    for r in range(1, radius + 1):
        # neighbours of each atom in (bond order, hash) order
        nb = current[dst]
        by_atom = np.lexsort((nb, code, src))
        code_s, nb_s = _u32(code[by_atom]), nb[by_atom]
        seed = combine(np.full(n, r, dtype=np.uint32), current)
        for k in range(int(heavy_degree.max()) if n else 0):
            who = np.flatnonzero(heavy_degree > k)
            at_k = starts[who] + k
            seed[who] = combine(combine(seed[who], code_s[at_k]), nb_s[at_k])
        current = mix(seed)
        layers.append(current)
    return row, layers


def _as_lists(rows: np.ndarray, values: np.ndarray, mol: pa.Array, keys=None):
    """List column from sorted row numbers; NULL molecules give NULL."""
    bounds = np.searchsorted(rows, np.arange(len(mol) + 1)).astype(np.int32)
    null = mol.is_null().to_numpy(zero_copy_only=False)
    mask = pa.array(null) if null.any() else None
    if keys is None:
        values = values if isinstance(values, pa.Array) else pa.array(values)
        return pa.ListArray.from_arrays(pa.array(bounds), values, mask=mask)
    offsets = pa.array(bounds)
    if mask is not None:
        offsets = pa.array([None if i < len(null) and null[i] else int(v) for i, v in enumerate(bounds)], pa.int32())
    return pa.MapArray.from_arrays(offsets, pa.array(keys), pa.array(values))


def _sorted_features(atoms, bonds, radius, features, chirality):
    row, layers = hash_layers(atoms, bonds, radius, features, chirality)
    rows = np.tile(row, len(layers)).astype(np.uint64)
    keys = (rows << np.uint64(32)) | np.concatenate(layers).astype(np.uint64)
    return np.unique(keys, return_counts=True)


def morgan_hashes(mol: str, radius: int = RADIUS, features: bool = False, chirality: bool = False) -> Column:
    """Sorted distinct 32-bit neighbourhood hashes (as bigint)."""

    @F.arrow_udf("array<bigint>")
    def hashes(m: pa.Array, bonds: pa.Array) -> pa.Array:
        keys, _ = _sorted_features(m, bonds, radius, features, chirality)
        return _as_lists((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), m)

    return hashes(F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds"))


def morgan_first_radii(mol: str, radius: int = RADIUS, features: bool = False, chirality: bool = False) -> Column:
    """Distinct hashes with the smallest radius that gives each: all smaller sweeps in one pass."""

    @F.arrow_udf("array<struct<h:bigint,r:int>>")
    def first(m: pa.Array, bonds: pa.Array) -> pa.Array:
        row, layers = hash_layers(m, bonds, radius, features, chirality)
        rows = np.tile(row, len(layers)).astype(np.uint64)
        # layers follow each other, so the first place of a hash is in its smallest radius
        keys, at = np.unique((rows << np.uint64(32)) | np.concatenate(layers).astype(np.uint64), return_index=True)
        values = pa.StructArray.from_arrays(
            [pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array((at // max(len(row), 1)).astype(np.int32))], names=["h", "r"]
        )
        return _as_lists((keys >> np.uint64(32)).astype(np.int64), values, m)

    return first(F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds"))


def morgan_counts(mol: str, radius: int = RADIUS, features: bool = False, chirality: bool = False) -> Column:
    """Neighbourhood hash -> number of atoms and radii producing it."""

    @F.arrow_udf("map<bigint,int>")
    def counts(m: pa.Array, bonds: pa.Array) -> pa.Array:
        keys, n = _sorted_features(m, bonds, radius, features, chirality)
        return _as_lists(
            (keys >> np.uint64(32)).astype(np.int64), n.astype(np.int32), m,
            keys=(keys & np.uint64(0xFFFFFFFF)).astype(np.int64),
        )

    return counts(F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds"))


def fold_layers(m: pa.Array, bonds: pa.Array, radius: int, n_bits: int, features: bool = False, chirality: bool = False) -> pa.Array:
    """Hashes of a batch folded to words of bits."""
    words = n_bits // 64
    row, layers = hash_layers(m, bonds, radius, features, chirality)
    bit = (np.concatenate(layers) % np.uint32(n_bits)).astype(np.int64)
    packed = np.zeros(len(m) * words, dtype=np.uint64)
    np.bitwise_or.at(packed, np.tile(row, len(layers)) * words + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return _as_lists(np.repeat(np.arange(len(m)), words), packed.view(np.int64), m)


def morgan_fingerprint(
    mol: str, radius: int = RADIUS, n_bits: int = N_BITS, features: bool = False, chirality: bool = False
) -> Column:
    """Folded fingerprint: ``n_bits / 64`` words, bit b in word b div 64."""
    if n_bits <= 0:
        n_bits = N_BITS
    if n_bits % 64:
        raise ValueError("n_bits must be a multiple of 64")

    @F.arrow_udf("array<bigint>")
    def folded(m: pa.Array, bonds: pa.Array) -> pa.Array:
        return fold_layers(m, bonds, radius, n_bits, features, chirality)

    return folded(F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds"))


def fingerprint_table(df: DataFrame, ident: str = "id", mol: str = "mol", **options) -> DataFrame:
    """(id, fp, popcnt) of the rows that have a molecule."""
    rows = df.where(F.col(mol).isNotNull()).select(F.col(ident).alias("id"), morgan_fingerprint(mol, **options).alias("_fp"))
    return with_once(rows, "fp", F.col("_fp")).select("id", "fp", popcount("fp").alias("popcnt"))


# --- the same two hash steps as Catalyst expressions -------------------------

_MASK = (1 << 32) - 1


def combine_column(seed: Column, value: Column) -> Column:
    """:func:`combine` on bigint columns holding unsigned 32-bit values."""
    added = (value + int(GOLDEN) + F.shiftleft(seed, 6) + F.shiftright(seed, 2)).bitwiseAND(F.lit(_MASK))
    return seed.bitwiseXOR(added)


def _times(x: Column, factor: int) -> Column:
    # 16-bit halves keep every product inside a signed 64-bit integer
    high = (x * (factor >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (x * (factor & 0xFFFF) + F.shiftleft(high, 16)).bitwiseAND(F.lit(_MASK))


def mix_column(x: Column) -> Column:
    """:func:`mix` on a bigint column holding unsigned 32-bit values."""
    x = _times(x.bitwiseXOR(F.shiftright(x, 16)), int(MIX_1))
    x = _times(x.bitwiseXOR(F.shiftright(x, 13)), int(MIX_2))
    return x.bitwiseXOR(F.shiftright(x, 16))


def collision_report(hashes: str, sizes=(256, 512, 1024, 2048, 4096)) -> Column:
    """Per folded size: features, bits set and collisions."""
    def entry(n):
        n_set = F.size(F.array_distinct(F.transform(F.col(hashes), lambda h: h % n)))
        return F.struct(
            F.lit(n).alias("n_bits"), F.size(hashes).alias("features"), n_set.alias("bits_set"),
            (F.size(hashes) - n_set).alias("collisions"),
        )

    return F.array(*[entry(n) for n in sizes])
