"""Breadth-first searches of all molecules of an Arrow batch at once.

Every atom has a row of bits, one for each search of its molecule that has
reached it.  A step ors the rows of all neighbours into each atom's; the bits
that are new were reached at this distance.  Molecules go together by the
number of 64-bit words their rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .morgan import _as_lists, _field, _lists

WORD = 64


class Bonds:
    """Both directions of all bonds of a batch, sorted by the atom they leave."""

    def __init__(self, atoms: pa.Array, bonds: pa.Array, rings_only: bool = False) -> None:
        self.atoms, self.n_atoms = _lists(atoms)
        flat, n_bonds = _lists(bonds)
        self.base = np.cumsum(self.n_atoms) - self.n_atoms
        owner = np.repeat(np.arange(len(n_bonds)), n_bonds)
        a, b = (_field(flat, c).astype(np.int64) + self.base[owner] for c in "ab")
        if rings_only:
            keep = _field(flat, "in_ring").astype(bool)
            owner, a, b = owner[keep], a[keep], b[keep]
        self.owner, self.a, self.b = owner, a, b
        bond = np.tile(np.arange(len(a)), 2)
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        self.src, self.dst, self.bond = np.concatenate([a, b])[order], np.concatenate([b, a])[order], bond[order]

    def groups(self, searches: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Molecules with some searches, by words of their rows (a power of two)."""
        words = 1 << np.ceil(np.log2(np.maximum(1, -(-searches // WORD)))).astype(np.int64)
        for width in np.unique(words[searches > 0]):
            yield np.flatnonzero((words == width) & (searches > 0)), int(width)

    def steps(self, molecules: np.ndarray, words: int, atom: np.ndarray, bit: np.ndarray, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(atoms, their rows of new bits) of each distance from 1 on.

        Search ``bit[i]`` starts at ``atom[i]``; ``own`` names for each bond the
        bit that may not cross it.
        """
        inside = np.zeros(len(self.n_atoms), bool)
        inside[molecules] = True
        edges = np.flatnonzero(inside[np.searchsorted(self.base + self.n_atoms, self.src, side="right")])
        src, dst = self.src[edges], self.dst[edges]
        atoms, starts = np.unique(src, return_index=True)
        place = np.zeros(len(self.atoms), np.int64)  # of an atom that has bonds
        place[atoms] = np.arange(len(atoms))
        rows = np.zeros((len(atoms), words), np.uint64)
        bonded = np.isin(atom, atoms)
        np.bitwise_or.at(rows, (place[atom[bonded]], bit[bonded] // WORD), np.uint64(1) << (bit[bonded] % WORD).astype(np.uint64))
        allowed = None
        if own is not None:
            crossing = own[self.bond[edges]]
            allowed = np.full((len(edges), words), ~np.uint64(0))
            allowed[np.arange(len(edges)), crossing // WORD] = ~(np.uint64(1) << (crossing % WORD).astype(np.uint64))
        while len(atoms):
            sent = rows[place[dst]]
            if allowed is not None:
                sent &= allowed
            new = np.bitwise_or.reduceat(sent, starts, axis=0) & ~rows
            fresh = np.flatnonzero(new.any(axis=1))
            if not len(fresh):
                return
            rows |= new
            yield atoms[fresh], new[fresh]


def _set_bits(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of every bit that is on."""
    return np.nonzero(np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little"))


def _distances(g: Bonds) -> np.ndarray:
    """All matrices row by row, -1 where there is no way."""
    size = g.n_atoms**2
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(g.n_atoms)), g.n_atoms)
    out = np.full(size.sum(), -1, np.int32)
    local = np.arange(len(owner)) - g.base[owner]
    row = first[owner] + local * g.n_atoms[owner]
    out[row + local] = 0
    for molecules, words in g.groups(g.n_atoms):
        mine = np.flatnonzero(np.isin(owner, molecules))
        for k, (atoms, new) in enumerate(g.steps(molecules, words, mine, local[mine]), 1):
            which, bit = _set_bits(new)
            out[row[atoms[which]] + bit] = k
    return out


def distance_matrix(mol: str) -> Column:
    """All-pairs bond distances, one row array per atom."""

    @F.arrow_udf("array<array<int>>")
    def matrices(atoms: pa.Array, bonds: pa.Array) -> pa.Array:
        g = Bonds(atoms, bonds)
        owner = np.repeat(np.arange(len(g.n_atoms)), g.n_atoms)
        ends = np.concatenate([[0], np.cumsum(g.n_atoms[owner])])
        return _as_lists(owner, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_distances(g))), atoms)

    return matrices(F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds"))


def graph_diameter(mol: str) -> Column:
    """Largest finite distance; 0 for an empty molecule."""

    @F.arrow_udf("int")
    def diameters(atoms: pa.Array, bonds: pa.Array) -> pa.Array:
        g = Bonds(atoms, bonds)
        owner = np.repeat(np.arange(len(g.n_atoms)), g.n_atoms)
        most = np.zeros(len(g.n_atoms), np.int32)
        for molecules, words in g.groups(g.n_atoms):
            mine = np.flatnonzero(np.isin(owner, molecules))
            for k, (reached, _) in enumerate(g.steps(molecules, words, mine, mine - g.base[owner[mine]]), 1):
                most[owner[reached]] = k
        return pa.array(most, mask=atoms.is_null().to_numpy(zero_copy_only=False))

    return diameters(F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds"))


def smallest_ring_size(mol: str) -> Column:
    """Size of the smallest ring through each atom; 0 outside rings."""

    @F.arrow_udf("array<int>")
    def sizes(atoms: pa.Array, bonds: pa.Array) -> pa.Array:
        g = Bonds(atoms, bonds, rings_only=True)
        n_rings = np.bincount(g.owner, minlength=len(g.n_atoms))
        bit = np.arange(len(g.a)) - (np.cumsum(n_rings) - n_rings)[g.owner]
        least = np.full(len(g.atoms), np.iinfo(np.int32).max, np.int32)
        bond_of = np.cumsum(n_rings) - n_rings
        owner = np.repeat(np.arange(len(g.n_atoms)), g.n_atoms)
        for molecules, words in g.groups(n_rings):
            mine = np.flatnonzero(np.isin(g.owner, molecules))
            # from one end of each ring bond to the other without crossing it
            for k, (reached, new) in enumerate(g.steps(molecules, words, g.a[mine], bit[mine], own=bit), 1):
                which, found = _set_bits(new)
                at = reached[which]
                bond = bond_of[owner[at]] + found
                back = g.b[bond] == at
                for end in (g.a[bond[back]], at[back]):
                    np.minimum.at(least, end, k + 1)
        least[least == np.iinfo(np.int32).max] = 0
        return _as_lists(owner, least, atoms)

    return sizes(F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds"))


def atom_pairs(mol: str) -> Column:
    """Atom-pair features ``z_low * 1000000 + z_high * 1000 + distance`` of all
    pairs of connected atoms, sorted and distinct."""

    @F.arrow_udf("array<int>")
    def pairs(atoms: pa.Array, bonds: pa.Array) -> pa.Array:
        g = Bonds(atoms, bonds)
        d, z = _distances(g), _field(g.atoms, "z").astype(np.int64)
        owner = np.repeat(np.arange(len(g.n_atoms)), g.n_atoms)
        i = np.repeat(np.arange(len(owner)), g.n_atoms[owner])
        lengths = g.n_atoms[owner]
        j = np.arange(len(i)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(g.base[owner], lengths)
        keep = (j > i) & (d > 0)
        i, j, d = i[keep], j[keep], d[keep]
        feature = np.minimum(z[i], z[j]) * 1000000 + np.maximum(z[i], z[j]) * 1000 + d
        keys = np.unique(owner[i] << 32 | feature)
        return _as_lists(keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32), atoms)

    return pairs(F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds"))
