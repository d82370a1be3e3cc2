"""Substructure patterns and their places in molecules.

A pattern is written like SMILES with conditions in place of atoms and bonds:

=============================  ==================================================
``C N Cl c n`` ...             that element, aliphatic or aromatic as written
``*``, ``A``, ``a``            any atom, any aliphatic, any aromatic one
``[#6]``, ``[13C]``            atomic number, isotope
``[D2]``, ``[X3]``, ``[H1]``   neighbours, neighbours and hydrogens, hydrogens
``[R]``, ``[R0]``              in a ring, in none
``[+]``, ``[-2]``              charge
``[!C]``, ``[N,O]``, ``[C;R]`` not, or, and (``&`` or nothing binds tighter)
``[$(NC=O)]``                  an atom where that pattern begins
nothing, ``- = # : ~ @``       bond: single or aromatic, single, double, triple,
                               aromatic, any, any in a ring
=============================  ==================================================

Matching works on the flat arrays of an Arrow batch.  Places of the first
pattern atom in all molecules are extended atom by atom along the bonds;
blocks of partial places wait on a stack, so memory stays bounded however many
ways there are to place a pattern.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .elements import SYMBOLS, Z
from .morgan import _field, _lists

#: Partial places extended at a time.
BLOCK = 1 << 17

AROMATIC = 5
_TOKEN = re.compile(r"\[|Cl|Br|[BCNOFPSIbcnops*Aa]|%[0-9]{2}|[0-9]|[-=#:~@]|[().]")
_TWO = sorted((s for s in SYMBOLS if len(s) == 2), key=len)
_PRIMITIVE = re.compile(
    r"(?P<z>#[0-9]+)|(?P<isotope>[0-9]+)|(?P<count>[DXH][0-9]*)|(?P<ring>R0?)|(?P<charge>[+]+[0-9]*|-+[0-9]*)|(?P<symbol>" + "|".join(_TWO) + r"|as|se|[A-Z*]|[a-z])"
)


class Batch:
    """Atoms and bonds of a batch of molecules, with what patterns ask of them."""

    def __init__(self, atoms: pa.Array, bonds: pa.Array) -> None:
        flat, n_atoms = _lists(atoms)
        edges, n_bonds = _lists(bonds)
        self.n_molecules, self.molecule = len(n_atoms), np.repeat(np.arange(len(n_atoms)), n_atoms)
        self.base = np.cumsum(n_atoms) - n_atoms
        shift = np.repeat(self.base, n_bonds)
        a, b = _field(edges, "a") + shift, _field(edges, "b") + shift
        order, ring = _field(edges, "bond_order").astype(np.int64), _field(edges, "in_ring").astype(bool)
        n = self.n = len(self.molecule)
        src, dst = np.concatenate([a, b]).astype(np.int64), np.concatenate([b, a]).astype(np.int64)
        by_pair = np.lexsort((dst, src))
        self.src, self.dst = src[by_pair], dst[by_pair]
        self.order, self.bond_ring = np.tile(order, 2)[by_pair], np.tile(ring, 2)[by_pair]
        self.degree = np.bincount(self.src, minlength=n)
        self.starts = np.cumsum(self.degree) - self.degree
        self.key = self.src * max(n, 1) + self.dst
        self.z, self.charge, self.isotope = (_field(flat, c).astype(np.int64) for c in ("z", "charge", "isotope"))
        self.aromatic, self.in_ring = (_field(flat, c).astype(bool) for c in ("aromatic", "in_ring"))
        self.hydrogens = _field(flat, "num_h").astype(np.int64) + np.bincount(self.src, self.z[self.dst] == 1, minlength=n).astype(np.int64)
        self.connections = self.degree + _field(flat, "num_h").astype(np.int64)


Test = Callable[[Batch], np.ndarray]
_BONDS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "": lambda order, ring: (order == 1) | (order == AROMATIC),
    "-": lambda order, ring: order == 1,
    "=": lambda order, ring: order == 2,
    "#": lambda order, ring: order == 3,
    ":": lambda order, ring: order == AROMATIC,
    "~": lambda order, ring: order > 0,
    "@": lambda order, ring: ring,
}


@dataclass
class Pattern:
    """Conditions on atoms, and bonds (atom, atom, kind)."""

    text: str
    atoms: list[Test] = field(default_factory=list)
    #: atomic number that an atom must have, where there is one
    elements: list[int | None] = field(default_factory=list)
    bonds: list[tuple[int, int, str]] = field(default_factory=list)

    def needs(self) -> dict[str, int]:
        """Least counts a molecule must have: of elements, of double and triple bonds, of rings."""
        least = {f"z{z}": k for z, k in Counter(z for z in self.elements if z).items()}
        least |= {name: k for name, sign in (("double", "="), ("triple", "#")) if (k := sum(kind == sign for *_, kind in self.bonds))}
        loops = len(self.bonds) - len(self.atoms) + 1
        return least | ({"rings": loops} if loops > 0 else {})

    def steps(self) -> list[tuple[int, int, str, list[tuple[int, str]]]]:
        """(atom, earlier neighbour, bond, other bonds to earlier atoms) for each atom after the first."""
        placed, out = [0], []
        while len(placed) < len(self.atoms):
            links = [(b if a in placed else a, a if a in placed else b, kind) for a, b, kind in self.bonds if (a in placed) != (b in placed)]
            new, to, kind = links[0]
            out.append((new, placed.index(to), kind, [(placed.index(other), k) for n, other, k in links[1:] if n == new]))
            placed.append(new)
        return out

    def places(self, batch: Batch, each: bool = True) -> Iterator[np.ndarray]:
        """Blocks of places, one row of atoms per place in the order of the pattern.

        Every way to lay the pattern is a place of its own.  With ``each``
        false, a molecule gives one place or a few, and none if it has none.
        """
        fits = [test(batch) for test in self.atoms]
        steps = self.steps()
        order = np.argsort([0, *(s[0] for s in steps)])
        found = np.zeros(batch.n_molecules, bool)
        waiting = [np.flatnonzero(fits[0])[:, None]]
        while waiting:
            rows = waiting.pop()
            if not each:
                rows = rows[~found[batch.molecule[rows[:, 0]]]]
            if len(rows) > BLOCK:
                waiting += np.array_split(rows, -(-len(rows) // BLOCK))
                continue
            depth = rows.shape[1]
            if depth > len(steps):
                found[batch.molecule[rows[:, 0]]] = True
                yield rows[:, order]
                continue
            new, to, kind, others = steps[depth - 1]
            at = rows[:, to]
            lengths = batch.degree[at]
            edge = np.repeat(batch.starts[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            row, atom = np.repeat(np.arange(len(rows)), lengths), batch.dst[edge]
            keep = fits[new][atom] & _BONDS[kind](batch.order[edge], batch.bond_ring[edge])
            row, atom = row[keep], atom[keep]
            keep = (rows[row] != atom[:, None]).all(axis=1)
            for other, kind in others:
                key = rows[row, other] * batch.n + atom
                edge = np.minimum(np.searchsorted(batch.key, key), max(len(batch.key) - 1, 0))
                keep &= (batch.key[edge] == key) & _BONDS[kind](batch.order[edge], batch.bond_ring[edge])
            row, atom = row[keep], atom[keep]
            if len(row):
                waiting.append(np.column_stack([rows[row], atom]))

    def starts_at(self, batch: Batch) -> np.ndarray:
        """Atoms where some place of the pattern begins."""
        out = np.zeros(batch.n, bool)
        for rows in self.places(batch):
            out[rows[:, 0]] = True
        return out


def _primitive(text: str, at: int, alone: bool) -> tuple[Test, int | None, int]:
    """(condition, the element it demands, end) of the condition at a place of a bracket."""
    if text.startswith("$(", at):
        depth = end = 0
        for end in range(at + 1, len(text)):
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            if depth == 0:
                break
        inner = compile_pattern(text[at + 2 : end])
        return inner.starts_at, inner.elements[0], end + 1
    m = _PRIMITIVE.match(text, at)
    if m is None:
        raise ValueError(f"pattern condition not understood: {text[at:]!r}")
    kind, word, end = m.lastgroup, m.group(), m.end()
    if kind == "z":
        z = int(word[1:])
        return lambda b: b.z == z, z, end
    if kind == "isotope":
        return lambda b: b.isotope == int(word), None, end
    if kind == "count" and not (word == "H" and alone):
        k, name = int(word[1:] or 1), {"D": "degree", "X": "connections", "H": "hydrogens"}[word[0]]
        return lambda b: getattr(b, name) == k, None, end
    if kind == "ring":
        return lambda b: b.in_ring == (word == "R"), None, end
    if kind == "charge":
        size = int(word.lstrip("+-") or len(word))
        return lambda b: b.charge == (size if word[0] == "+" else -size), None, end
    if word in ("*", "A", "a"):
        return {"*": lambda b: b.z >= 0, "A": lambda b: ~b.aromatic, "a": lambda b: b.aromatic}[word], None, end
    if word.capitalize() not in Z:
        raise ValueError(f"pattern condition not understood: {text[at:]!r}")
    z = Z[word.capitalize()]
    return lambda b: (b.z == z) & (b.aromatic == word[0].islower()), z, end


def _condition(text: str) -> tuple[Test, int | None]:
    """Condition of the inside of a bracket, and the element it demands."""
    alone = re.fullmatch(r"[0-9]*H[-+0-9]*", text) is not None
    groups, at = [[[]]], 0  # ";" of "," of "&"
    while at < len(text):
        if text[at] in ";,&":
            if text[at] == ";":
                groups.append([[]])
            elif text[at] == ",":
                groups[-1].append([])
            at += 1
            continue
        negated = 0
        while text.startswith("!", at):
            negated, at = negated ^ 1, at + 1
        test, z, at = _primitive(text, at, alone)
        groups[-1][-1].append(((lambda b, test=test: ~test(b)) if negated else test, None if negated else z))
    if not all(part for group in groups for part in group):
        raise ValueError(f"empty pattern condition: [{text}]")
    demanded = [{next((z for _, z in part if z is not None), None) for part in group} for group in groups]
    element = next((z for zs in demanded if len(zs) == 1 for z in zs if z is not None), None)
    every = lambda masks: np.logical_and.reduce(list(masks))
    return lambda b: every(np.logical_or.reduce([every(test(b) for test, _ in part) for part in group]) for group in groups), element


def compile_pattern(text: str) -> Pattern:
    """Read a pattern; one connected part only."""
    pattern, stack, rings, current, kind, at = Pattern(text), [], {}, None, "", 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or m.group() == ".":
            raise ValueError(f"pattern not understood from {text[at:]!r}")
        token, at = m.group(), m.end()
        if token in _BONDS:
            kind = token
        elif token == "(":
            stack.append(current)
        elif token == ")":
            current = stack.pop()
        elif token[0] in "%0123456789":
            if token in rings:
                other, before = rings.pop(token)
                pattern.bonds.append((other, current, kind or before))
            else:
                rings[token] = (current, kind)
            kind = ""
        else:
            if token == "[":
                depth, end = 1, at
                while depth:
                    if end == len(text):
                        raise ValueError(f"unclosed bracket in pattern {text!r}")
                    depth += {"[": 1, "]": -1}.get(text[end], 0)
                    end += 1
                token, at = text[at : end - 1], end
            test, z = _condition(token)
            pattern.atoms.append(test)
            pattern.elements.append(z)
            if current is not None:
                pattern.bonds.append((current, len(pattern.atoms) - 1, kind))
            current, kind = len(pattern.atoms) - 1, ""
    if not pattern.atoms or rings or stack or kind:
        raise ValueError(f"pattern is not complete: {text!r}")
    return pattern
