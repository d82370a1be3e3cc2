"""A whole Arrow batch of SMILES parsed at once.

All texts of a batch are one array of bytes.  Characters are classed by a
table, tokens are cut by masks, and what a left-to-right parser keeps on a
stack is found for all tokens together:

* the atom a token attaches to is reached by pointers (a closing parenthesis
  points before its opening one, everything but an atom to the token before)
  that are doubled until all end at atoms;
* parentheses and ring numbers are paired by sorting;
* a bond is in a ring if a ring closure's two ends meet above it: both ends
  walk towards the root of the spanning tree, all closures at a time.

Distinct bracket atoms are read once each.  Where a ring number ties two
fragments (``C1.C1``) the closure is no cycle of the tree; the bonds of such a
molecule are searched for bridges.  Texts in error are read once more, one at a
time, to tell what is wrong and where.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import smiles as S
from .elements import VALENCES, Z

ATOM, OPEN, CLOSE, RING, BOND, DOT, PERCENT = range(1, 8)

_KIND = np.zeros(256, np.uint8)
_ATOMIC = np.zeros(256, np.int32)
for _symbol, _z in S._ORGANIC + S._AROMATIC_ORGANIC:
    if len(_symbol) == 1:
        _KIND[ord(_symbol)], _ATOMIC[ord(_symbol)] = ATOM, _z
for _chars, _kind in (("(", OPEN), (")", CLOSE), ("0123456789", RING), ("-=#$:/\\", BOND), (".", DOT), ("%", PERCENT)):
    _KIND[[ord(x) for x in _chars]] = _kind
_ORDER = np.ones(256, np.int32)
_ORDER[[ord(x) for x in "=#$:"]] = (2, 3, 4, S.AROMATIC)
_VALENCE = np.zeros(256, np.int32)
_VALENCE[[Z[s] for s in VALENCES]] = list(VALENCES.values())
_BRACKET = re.compile(S._BRACKET[:-1] + r"\Z", re.ASCII)

_BRACKET_START, _TOKEN = re.compile(S._BRACKET_PREFIX, re.ASCII), re.compile(S._TOKEN, re.ASCII)
_ISOTOPE, _RING = re.compile(r"\[[0-9]*"), re.compile(r"%[0-9][0-9]\Z")
_ATOM_TOKENS, _BONDS = frozenset(S._ATOM_TOKENS), frozenset("-=#$:/\\")

ATOM_FIELDS = [("z", pa.int32()), ("charge", pa.int32()), ("num_h", pa.int32()), ("isotope", pa.int32()), ("aromatic", pa.bool_()), ("in_ring", pa.bool_()), ("explicit_h", pa.bool_()), ("chirality", pa.int32())]
BOND_FIELDS = [("a", pa.int32()), ("b", pa.int32()), ("bond_order", pa.int32()), ("in_ring", pa.bool_())]
NEIGHBOUR_FIELDS = [("atom", pa.int32()), ("bond", pa.int32()), ("bond_order", pa.int32()), ("in_ring", pa.bool_())]


def _number(digits: str, most: int) -> int:
    return most if len(digits) > 18 else min(int(digits), most)


def bracket_atom(text: str) -> tuple[int, int, int, int, bool, int] | None:
    """(z, charge, hydrogens, isotope, aromatic, chirality) of ``[...]``, None if it is malformed."""
    m = _BRACKET.match(text)
    if m is None:
        return None
    isotope, symbol, chirality, hydrogens, charge, _ = m.groups()
    h = 0 if hydrogens is None else 1 if hydrogens == "H" else _number(hydrogens[1:], 2**31 - 1)
    q = 0 if charge is None else _number(charge[1:], 10**9) if charge[1:].isdigit() else len(charge)
    q = -q if charge and charge[0] == "-" else q
    mass = _number(isotope, 256) if isotope else 0
    return Z[symbol.capitalize()] if symbol != "*" else 0, (q + 128) % 256 - 128, h % 256, 0 if mass > 255 else mass, symbol[0].islower(), {None: 0, "@": 2, "@@": 1}[chirality]


def _running(steps: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sums from the start of each row, its own step included."""
    total = np.cumsum(steps)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(row))))


def _before(row: np.ndarray) -> np.ndarray:
    """The place before each one of the same row, len(row) if there is none."""
    at = np.arange(-1, len(row) - 1)
    return np.where(np.diff(row, prepend=-1) != 0, len(row), at)


def _ended(step: np.ndarray) -> np.ndarray:
    """Where pointers end that are followed until they stay."""
    while True:
        further = step[step]
        if np.array_equal(further, step):
            return step
        step = further


def _struct(fields, *columns, mask=None) -> pa.StructArray:
    arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, k) for n, k in fields], mask=mask)


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each text)."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[bounds[0] : bounds[-1]], np.diff(bounds).astype(np.int64)


class _Tokens:
    """Tokens of all texts that are correct as far as one can see from the tokens."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray) -> None:
        self.bad = lengths == 0
        row = np.repeat(np.arange(len(lengths)), lengths)
        opened, closed = data == ord("["), data == ord("]")
        level = _running(opened.astype(np.int64) - closed, row)
        self.bad[row[(level < 0) | (level > 1)]] = True
        last = np.cumsum(lengths)[~self.bad] - 1
        self.bad[row[last[level[last] != 0]]] = True
        outside = (level == 0) & ~closed
        following = np.append(data[1:], np.uint8(0))
        same = np.append(row[1:] == row[:-1], False)
        pair = outside & same & (((data == ord("C")) & (following == ord("l"))) | ((data == ord("B")) & (following == ord("r"))))
        percent = np.flatnonzero(outside & (data == ord("%")))
        inner = np.zeros(len(data) + 2, bool)
        inner[1:-1] = pair
        owner = np.append(row, [-1, -1])
        for k in (1, 2):
            inner[(percent + k)[owner[percent + k] == row[percent]]] = True
        at = np.flatnonzero(opened | (outside & ~inner[:-2]))
        kind = _KIND[data[at]]
        kind[opened[at]] = ATOM
        value = np.where(kind == RING, data[at].astype(np.int32) - ord("0"), _ORDER[data[at]])
        if len(percent):
            digits = np.append(data, [0, 0])[percent[:, None] + [1, 2]].astype(np.int32) - ord("0")
            right = ((digits >= 0) & (digits <= 9)).all(axis=1) & (owner[percent + 2] == row[percent])
            self.bad[row[percent[~right]]] = True
            where = np.searchsorted(at, percent[right])
            kind[where], value[where] = RING, digits[right, 0] * 10 + digits[right, 1]
        self.bad[row[at[kind == 0]]] = True
        self.z = _ATOMIC[data[at]]
        self.z[pair[at]] = np.where(data[at[pair[at]]] == ord("C"), Z["Cl"], Z["Br"])
        self.aromatic = data[at] >= ord("a")
        self.charge, self.num_h, self.isotope, self.chirality = (np.zeros(len(at), np.int32) for _ in range(4))
        self.explicit = opened[at]
        self._brackets(data, at, np.flatnonzero(closed), row)
        keep = ~self.bad[row[at]]
        for name in ("z", "aromatic", "charge", "num_h", "isotope", "chirality", "explicit"):
            setattr(self, name, getattr(self, name)[keep])
        self.row, self.kind, self.value = row[at][keep], kind[keep], value[keep]

    def _brackets(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray, row: np.ndarray) -> None:
        """Read each distinct bracket atom once."""
        which = np.flatnonzero(self.explicit)
        which = which[~self.bad[row[at[which]]]]
        if not len(which):
            return
        starts = at[which]
        stops = ends[np.searchsorted(ends, starts)] + 1
        whole = data.tobytes()
        texts = [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        numbers = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        read = [bracket_atom(t.decode("utf-8", "replace")) for t in numbers]
        number = np.fromiter(map(numbers.__getitem__, texts), np.int64, len(texts))
        self.bad[row[starts[np.array([r is None for r in read])[number]]]] = True
        fields = np.array([r or (0,) * 6 for r in read], np.int32)[number]
        for k, name in enumerate(("z", "charge", "num_h", "isotope", "aromatic", "chirality")):
            getattr(self, name)[which] = fields[:, k]


def _bridges(n: int, a: list[int], b: list[int]) -> np.ndarray:
    """Which bonds of a graph lie on no cycle."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for bond, (x, y) in enumerate(zip(a, b, strict=True)):
        near[x].append((y, bond))
        near[y].append((x, bond))
    seen, low, bridge = [-1] * n, [0] * n, np.zeros(len(a), bool)
    count = 0
    for start in range(n):
        if seen[start] >= 0:
            continue
        path = [(start, -1, iter(near[start]))]
        seen[start] = low[start] = count
        count += 1
        while path:
            at, came, rest = path[-1]
            for to, bond in rest:
                if bond == came:
                    continue
                if seen[to] >= 0:
                    low[at] = min(low[at], seen[to])
                    continue
                seen[to] = low[to] = count
                count += 1
                path.append((to, bond, iter(near[to])))
                break
            else:
                path.pop()
                if path:
                    above = path[-1][0]
                    low[above] = min(low[above], low[at])
                    bridge[came] = low[at] > seen[above]
    return bridge


def _bad_token(token: str, at: int) -> tuple[str, int]:
    if token[0] == "[":
        digits = len(_ISOTOPE.match(token).group())
        if len(token) == digits:
            return "unterminated bracket atom", at + digits
        if start := _BRACKET_START.match(token):
            return "expected ']'", at + start.end()
        letter = token[digits]
        if "a" <= letter <= "z":
            return f"unknown aromatic atom '{letter.upper()}'", at + digits
        if "A" <= letter <= "Z":
            return f"unknown element '{letter}'", at + digits
        return "expected element symbol in bracket", at + digits
    if token[0] == "%":
        return ("expected two digits after '%'", at + 2) if token[1:2] in tuple("0123456789") else ("expected digits after '%'", at + 1)
    return f"unexpected character '{token}'", at


def error_of(text: str) -> tuple[str, int] | None:
    """(message, position) of the first error of a text, None if there is none."""
    if not text:
        return "empty SMILES", 0
    atom, n, stack, rings, at = -1, 0, [], {}, 0
    for match in _TOKEN.finditer(text):
        token, code = match.group(), 0
        at = match.start()
        if token in _ATOM_TOKENS or (token[0] == "[" and _BRACKET.match(token)):
            atom, n = n, n + 1
        elif token == "(":
            code = 2 * (atom < 0)
            stack.append(atom)
        elif token == ")":
            code = 3 * (not stack)
            atom = stack.pop() if stack else atom
        elif token[0] in "0123456789" or (token[0] == "%" and _RING.match(token)):
            number = int(token.lstrip("%"))
            if atom < 0:
                code = 4
            elif number not in rings:
                rings[number] = atom
            elif rings.pop(number) == atom:
                code = 5
        elif token == ".":
            atom = -1
        elif token not in _BONDS:
            return _bad_token(token, at)
        if code:
            return S._ERR_TEXT[code], match.end()
    if stack:
        return "unclosed '('", len(text)
    return ("unclosed ring bond", len(text)) if rings else None


def parse_batch(texts: pa.Array) -> pa.StructArray:
    """``mol`` of each text as a struct, null where the text is null or in error."""
    t = _Tokens(*_bytes(texts))
    bad, row, kind = t.bad, t.row, t.kind
    n = len(row)
    if texts.null_count:
        bad[texts.is_null().to_numpy(zero_copy_only=False)] = True

    # parentheses in pairs
    turn = (kind == OPEN).astype(np.int64) - (kind == CLOSE)
    depth = _running(turn, row)
    bad[row[depth < 0]] = True
    final = np.flatnonzero(np.diff(row, append=-1))
    bad[row[final[depth[final] != 0]]] = True
    before = _before(row)
    step = np.append(np.where(kind == ATOM, np.arange(n), np.where(kind == DOT, n, before)), n)
    parens = np.flatnonzero((turn != 0) & ~bad[row])
    parens = parens[np.lexsort((parens, depth[parens] + (kind[parens] == CLOSE), row[parens]))]
    step[parens[1::2]] = before[parens[::2]]
    state = _ended(step)  # the atom that is current after each token
    current = state[before]  # and before it

    # ring numbers in pairs
    rings = np.flatnonzero(kind == RING)
    bad[row[current == n] [np.isin(kind[current == n], (OPEN, RING))]] = True
    rings = rings[np.lexsort((rings, t.value[rings], row[rings]))]
    key = row[rings] * 100 + t.value[rings]
    nth = _running(np.ones(len(rings), np.int64), key)
    odd = (nth % 2 == 1) & (np.diff(key, append=-1) != 0)
    bad[row[rings[odd]]] = True
    rings = rings[~bad[row[rings]]]
    first, second = rings[::2], rings[1::2]
    bad[row[first[current[first] == current[second]]]] = True
    root = _ended(np.append(np.where((kind == ATOM) & (current < n), current, np.arange(n)), n))
    tying = np.zeros(len(bad), bool)
    tying[row[first[root[current[first]] != root[current[second]]]]] = True
    good = ~bad[row[first]]
    first, second = first[good], second[good]

    # bond symbols wait for the next atom or ring number
    plain = np.flatnonzero(turn == 0)
    earlier = np.append(plain, n)[_before(row[plain])] if len(plain) else plain
    pending = np.zeros(n + 1, np.int32)
    pending[plain] = np.where(np.append(kind, 0)[earlier] == BOND, np.append(t.value, 0)[earlier], 0)

    # atoms of the rows that remain
    atoms = np.flatnonzero((kind == ATOM) & ~bad[row])
    number = np.full(n + 1, -1)
    number[atoms] = np.arange(len(atoms))
    n_atoms = np.bincount(row[atoms], minlength=len(bad))
    base = np.cumsum(n_atoms) - n_atoms
    parent = number[current[atoms]]

    # bonds in the order of the text: to the atom before, and of closing rings
    linked = atoms[parent >= 0]
    at = np.concatenate([linked, second])
    a = np.concatenate([parent[parent >= 0], number[current[first]]])
    b = np.concatenate([number[linked], number[current[second]]])
    given = np.concatenate([pending[linked], np.where(pending[second] != 0, pending[second], pending[first])])
    in_text = np.argsort(at, kind="stable")
    closing = np.repeat([False, True], [len(linked), len(second)])[in_text]
    a, b, given, owner = a[in_text], b[in_text], given[in_text], row[at[in_text]]
    aromatic = t.aromatic[atoms]
    order = np.where(given != 0, given, np.where(aromatic[a] & aromatic[b], S.AROMATIC, 1)).astype(np.int32)

    # ends of closures walk up until they meet
    on_cycle = np.zeros(len(atoms), bool)
    walked = closing & ~tying[owner]
    u, v = a[walked], b[walked]
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        apart = low != high
        on_cycle[high[apart]] = True
        u, v = low[apart], parent[high[apart]]
    in_ring = closing | on_cycle[b]
    for one in np.flatnonzero(tying & ~bad):
        its = np.flatnonzero(owner == one)
        in_ring[its] = ~_bridges(int(n_atoms[one]), (a[its] - base[one]).tolist(), (b[its] - base[one]).tolist())

    # neighbours by atom, in bond order
    n_bonds = np.bincount(owner, minlength=len(bad))
    nth_bond = np.arange(len(a)) - np.repeat(np.cumsum(n_bonds) - n_bonds, n_bonds)
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    bond = np.tile(np.arange(len(a)), 2)
    by_atom = np.lexsort((bond, ends))
    bond, others, ends = bond[by_atom], others[by_atom], ends[by_atom]
    degree = np.bincount(ends, minlength=len(atoms))
    tenths = np.bincount(ends, np.where(order[bond] == S.AROMATIC, 15, order[bond] * 10), minlength=len(atoms)).astype(np.int64)
    atom_ring = np.bincount(ends, in_ring[bond], minlength=len(atoms)) > 0
    z, explicit = t.z[atoms], t.explicit[atoms]
    wanted = _VALENCE[z]
    num_h = np.where(explicit | (wanted == 0), t.num_h[atoms], np.maximum(0, wanted - (tenths + 5 * aromatic + 4) // 10))

    shift = base[row[atoms]]
    atom_rows = _struct(ATOM_FIELDS, z, t.charge[atoms], num_h.astype(np.int32), t.isotope[atoms], aromatic, atom_ring, explicit, t.chirality[atoms])
    bond_rows = _struct(BOND_FIELDS, (a - base[owner]).astype(np.int32), (b - base[owner]).astype(np.int32), order, in_ring)
    neighbours = _struct(NEIGHBOUR_FIELDS, (others - shift[ends]).astype(np.int32), nth_bond[bond].astype(np.int32), order[bond], in_ring[bond])
    columns = [_lists(n_atoms, atom_rows), _lists(n_bonds, bond_rows), _lists(n_atoms, _lists(degree, neighbours))]
    return pa.StructArray.from_arrays(columns, names=["atoms", "bonds", "adj"], mask=pa.array(bad))


def parse_smiles(column: str) -> Column:
    """Parse a SMILES column into ``struct<mol, error>``.

    Exactly one of the two fields is set; both are NULL for a NULL input.
    ``error.position`` counts characters from 0.
    """

    @F.arrow_udf(f"struct<mol:{S.MOL_T},error:{S.ERROR_T}>")
    def parsed(texts: pa.Array) -> pa.Array:
        molecules = parse_batch(texts)
        failed = molecules.is_null().to_numpy(zero_copy_only=False)
        told = [error_of(t) if bad and t is not None else None for t, bad in zip(texts.to_pylist(), failed.tolist(), strict=True)] if failed.any() else [None] * len(texts)
        message, position = (pa.array([t and t[k] for t in told], kind) for k, kind in ((0, pa.string()), (1, pa.int32())))
        errors = pa.StructArray.from_arrays([message, position], names=["message", "position"], mask=message.is_null())
        return pa.StructArray.from_arrays([molecules, errors], names=["mol", "error"])

    return parsed.asNondeterministic()(F.col(column))


def with_molecule(df: DataFrame, column: str = "smiles") -> DataFrame:
    """Add ``mol`` and ``error`` columns for a SMILES column."""
    return df.withColumn("_parsed", parse_smiles(column)).withColumns({"mol": F.col("_parsed.mol"), "error": F.col("_parsed.error")}).drop("_parsed")
