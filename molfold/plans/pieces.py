"""SQL view of the composed molecules, for checking only.

The graphs of the SMILES pieces are written out by hand below and joined into
whole molecules with plain SQL.  Nothing here uses the parser.
"""

from __future__ import annotations

# An atom is (z, charge, hydrogens, isotope, aromatic, chirality); hydrogens
# None means "fill up to the default valence".  A bond is (a, b, order, ring).
C = (6, 0, None, 0, False, 0)
c = (6, 0, None, 0, True, 0)
N = (7, 0, None, 0, False, 0)
n = (7, 0, None, 0, True, 0)
O = (8, 0, None, 0, False, 0)  # noqa: E741
S = (16, 0, None, 0, False, 0)
F_ = (9, 0, None, 0, False, 0)
CL = (17, 0, None, 0, False, 0)
BR = (35, 0, None, 0, False, 0)

# (atoms, bonds, atom that the next piece attaches to), in the order of tables.LEFT
LEFT = (
    ([C], [], 0),
    ([O], [], 0),
    ([N], [], 0),
    ([CL], [], 0),
    ([(7, 1, 3, 0, False, 0)], [], 0),
    ([C, C, O, O], [(0, 1, 1, False), (1, 2, 2, False), (1, 3, 1, False)], 3),
    ([N, C], [(0, 1, 3, False)], 1),
    ([(11, 1, 0, 0, False, 0), (8, -1, 0, 0, False, 0)], [], 1),
)
CARBON = ([C], [], 0)
CORE = (
    ([c] * 6, [(0, 1, 5, True), (1, 2, 5, True), (2, 3, 5, True), (3, 4, 5, True), (4, 5, 5, True), (0, 5, 5, True)], 3),
    ([c] * 10, [(0, 1, 5, True), (1, 2, 5, True), (2, 3, 5, True), (3, 4, 5, True), (4, 5, 5, True), (5, 6, 5, True),
                (6, 7, 5, True), (2, 7, 5, True), (7, 8, 5, True), (8, 9, 5, True), (0, 9, 5, True)], 9),
    ([C] * 6, [(0, 1, 1, True), (1, 2, 1, True), (2, 3, 1, True), (3, 4, 1, True), (4, 5, 1, True), (0, 5, 1, True)], 3),
    ([N, C, C, N, C, C], [(0, 1, 1, True), (1, 2, 1, True), (2, 3, 1, True), (3, 4, 1, True), (4, 5, 1, True), (0, 5, 1, True)], 3),
    ([c, c, c, n, c], [(0, 1, 5, True), (1, 2, 5, True), (2, 3, 5, True), (3, 4, 5, True), (0, 4, 5, True)], 3),
    ([c, c, n, c, c, c], [(0, 1, 5, True), (1, 2, 5, True), (2, 3, 5, True), (3, 4, 5, True), (4, 5, 5, True), (0, 5, 5, True)], 4),
    ([C, O, N], [(0, 1, 2, False), (0, 2, 1, False)], 2),
    ([C, C, C, O, C, C, C], [(0, 1, 2, True), (1, 2, 1, True), (2, 3, 2, False), (2, 4, 1, True), (4, 5, 2, True),
                             (5, 6, 1, True), (0, 6, 1, True)], 6),
    ([(6, 0, 1, 0, False, 1), N], [(0, 1, 1, False)], 0),
    ([C] * 8, [(0, 1, 1, True), (1, 2, 1, True), (2, 3, 1, True), (3, 4, 1, True), (4, 5, 1, True), (0, 5, 1, True),
               (3, 6, 1, True), (6, 7, 1, True), (0, 7, 1, True)], 7),
    ([S, O, O], [(0, 1, 2, False), (0, 2, 2, False)], 0),
    ([C, C], [(0, 1, 2, False)], 1),
)
RIGHT = (
    ([C], [], 0),
    ([O], [], 0),
    ([C, O, O], [(0, 1, 2, False), (0, 2, 1, False)], 0),
    ([N], [], 0),
    ([c] * 6, [(0, 1, 5, True), (1, 2, 5, True), (2, 3, 5, True), (3, 4, 5, True), (4, 5, 5, True), (0, 5, 5, True)], 0),
    ([(7, 1, 0, 0, False, 0), O, (8, -1, 0, 0, False, 0)], [(0, 1, 2, False), (0, 2, 1, False)], 0),
    ([C, F_, F_, F_], [(0, 1, 1, False), (0, 2, 1, False), (0, 3, 1, False)], 0),
    ([C, N], [(0, 1, 3, False)], 0),
    ([BR], [], 0),
    ([(6, 0, 3, 13, False, 0)], [], 0),
    ([c, c, c, n, c, c], [(0, 1, 5, True), (1, 2, 5, True), (2, 3, 5, True), (3, 4, 5, True), (4, 5, 5, True), (0, 5, 5, True)], 0),
)
# cores and ends written with their own bond symbol (``/C=C/`` on both sides, ``-c1ccncc1`` before it)
LINK_BEFORE = {("core", 11), ("right", 10)}
LINK_AFTER = {("core", 11)}

_LIB = (("left", LEFT), ("pad", (CARBON,)), ("core", CORE), ("right", RIGHT))


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in r) + ")" for r in rows)


def _values():
    atoms, bonds, pieces = [], [], []
    for slot, lib in _LIB:
        for k, (at, bd, exit_) in enumerate(lib):
            pieces.append((slot, k, len(at), exit_, (slot, k) in LINK_BEFORE, (slot, k) in LINK_AFTER))
            atoms += [(slot, k, i, *a) for i, a in enumerate(at)]
            bonds += [(slot, k, *b) for b in bd]
    return atoms, bonds, pieces


def smiles_cte(key: str = "p_partkey", pad: str = "p_size", source: str = "part", extra: str = "") -> str:
    """``smi(mol_id, left_k, core_k, right_k, pad, smiles, whole)``."""
    from .tables import CORE as CORE_T
    from .tables import LEFT as LEFT_T
    from .tables import RIGHT as RIGHT_T

    def pick(values, k):
        return "CASE " + k + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"

    nl, nc, nr = len(LEFT_T), len(CORE_T), len(RIGHT_T)
    return f"""
  keyed AS (SELECT {key} AS mol_id, CAST({pad} AS BIGINT) % 4 AS pad, CAST({key} AS BIGINT) % {nl} AS left_k,
    (CAST({key} AS BIGINT) // {nl}) % {nc} AS core_k, (CAST({key} AS BIGINT) // {nl * nc}) % {nr} AS right_k {extra} FROM {source}),
  whole AS (SELECT *, {pick(LEFT_T, 'left_k')} || repeat('C', pad::INT) || {pick(CORE_T, 'core_k')} || {pick(RIGHT_T, 'right_k')} AS whole FROM keyed),
  smi AS (SELECT *, whole || CASE mol_id % 50 WHEN 9 THEN '(' WHEN 19 THEN ')' WHEN 29 THEN 'X' WHEN 39 THEN '[C'
    WHEN 49 THEN '%12' ELSE '' END AS smiles, mol_id % 10 = 9 AS broken FROM whole)"""


def graph_cte(**kw) -> str:
    """``atoms`` and ``bonds`` of every unbroken molecule, hydrogens filled in.

    atoms(mol_id, idx, z, charge, num_h, isotope, aromatic, chirality, in_ring)
    bonds(mol_id, a, b, ord, ring)
    """
    atoms, bonds, pieces = _values()
    return f"""{smiles_cte(**kw)},
  lib_atoms(slot, k, i, z, charge, h, isotope, aromatic, chirality) AS (VALUES {_rows(atoms)}),
  lib_bonds(slot, k, a, b, ord, ring) AS (VALUES {_rows(bonds)}),
  lib(slot, k, n, exit_at, link_before, link_after) AS (VALUES {_rows(pieces)}),
  used AS (
    SELECT mol_id, 0 AS seq, 'left' AS slot, left_k AS k FROM smi WHERE NOT broken
    UNION ALL SELECT mol_id, j, 'pad', 0 FROM (SELECT mol_id, unnest(generate_series(1, pad)) AS j FROM smi WHERE NOT broken)
    UNION ALL SELECT mol_id, 10, 'core', core_k FROM smi WHERE NOT broken
    UNION ALL SELECT mol_id, 11, 'right', right_k FROM smi WHERE NOT broken),
  placed AS (
    SELECT mol_id, seq, u.slot, u.k, l.n, exit_at, link_before, link_after,
      CAST(coalesce(sum(l.n) OVER (PARTITION BY mol_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base
    FROM used u JOIN lib l ON u.slot = l.slot AND u.k = l.k),
  linked AS (
    SELECT *, lag(base + exit_at) OVER w AS from_at, lag(link_after) OVER w AS after_prev
    FROM placed WINDOW w AS (PARTITION BY mol_id ORDER BY seq)),
  raw AS (
    SELECT p.mol_id, p.base + a.i AS idx, z, charge, h, isotope, aromatic, chirality
    FROM placed p JOIN lib_atoms a ON p.slot = a.slot AND p.k = a.k),
  bonds AS (
    SELECT p.mol_id, p.base + b.a AS a, p.base + b.b AS b, ord, ring
    FROM placed p JOIN lib_bonds b ON p.slot = b.slot AND p.k = b.k
    UNION ALL
    SELECT l.mol_id, from_at, base, CASE WHEN x.aromatic AND y.aromatic AND NOT l.link_before AND NOT after_prev THEN 5 ELSE 1 END, false
    FROM linked l JOIN raw x ON x.mol_id = l.mol_id AND x.idx = from_at JOIN raw y ON y.mol_id = l.mol_id AND y.idx = base
    WHERE from_at IS NOT NULL),
  ends AS (
    SELECT mol_id, a AS idx, b AS nbr, ord, ring FROM bonds UNION ALL SELECT mol_id, b, a, ord, ring FROM bonds),
  totals AS (
    SELECT mol_id, idx, sum(CASE ord WHEN 5 THEN 15 ELSE ord * 10 END) AS tenths, bool_or(ring) AS ring FROM ends GROUP BY ALL),
  atoms AS (
    SELECT r.mol_id, r.idx, z, charge, isotope, aromatic, chirality, coalesce(t.ring, false) AS in_ring, h IS NOT NULL AS explicit_h,
      coalesce(h, greatest(0, CASE z WHEN 1 THEN 1 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 3 WHEN 8 THEN 2 WHEN 9 THEN 1
        WHEN 15 THEN 3 WHEN 16 THEN 2 WHEN 17 THEN 1 WHEN 35 THEN 1 WHEN 53 THEN 1 ELSE 0 END
        - CAST(coalesce(t.tenths, 0) + CASE WHEN aromatic THEN 5 ELSE 0 END + 4 AS BIGINT) // 10)) AS num_h
    FROM raw r LEFT JOIN totals t ON t.mol_id = r.mol_id AND t.idx = r.idx)"""
