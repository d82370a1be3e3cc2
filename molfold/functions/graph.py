"""Graph measures of a parsed molecule, as Catalyst array expressions.

Every function takes the name of a ``mol`` column and returns a Column.
The search from one atom is a fold whose state is the set of atoms already
reached, the step at which each was reached, and the current frontier; once
the frontier is empty the remaining steps do nothing.  Searches from all atoms
are in :mod:`molfold.functions.bitsearch`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitsearch import distance_matrix, graph_diameter, smallest_ring_size  # noqa: F401
from .smiles import let


def _bfs(start: str) -> str:
    """SQL for struct(seen, steps) of a search over ``m.adj`` from ``start``."""
    return (
        "aggregate(sequence(1, greatest(size(m.atoms), 1)), "
        f"named_struct('seen', array({start}), 'steps', array(0), 'front', array({start})), "
        "(s, k) -> IF(size(s.front) = 0, s, "
        + let(
            "array_except(flatten(transform(s.front, u -> transform(m.adj[u], w -> w.atom))), s.seen)",
            "fresh",
            "named_struct('seen', concat(s.seen, fresh), 'steps', "
            "concat(s.steps, array_repeat(k, size(fresh))), 'front', fresh)",
        )
        + "))"
    )


def _distances(start: str) -> str:
    return let(
        _bfs(start),
        "q",
        "transform(sequence(0, size(m.atoms) - 1), v -> "
        "IF(array_contains(q.seen, v), q.steps[cast(array_position(q.seen, v) as int) - 1], -1))",
    )


_NO_ATOMS = "size(m.atoms) = 0"
_INT_ARRAY = "cast(array() as array<int>)"


def _on(mol: str, body: str) -> Column:
    return F.expr(f"IF({mol} IS NULL, NULL, {let(mol, 'm', body)})")


def shortest_paths_from(mol: str, start: int) -> Column:
    """Bond distance from one atom to every atom; -1 when unreachable."""
    body = (
        f"CASE WHEN {_NO_ATOMS} THEN {_INT_ARRAY} "
        f"WHEN {int(start)} < 0 OR {int(start)} >= size(m.atoms) THEN array_repeat(-1, size(m.atoms)) "
        f"ELSE {_distances(str(int(start)))} END"
    )
    return _on(mol, body)


# each atom carries the smallest atom number of its fragment; when every atom
# but the first has a lower-numbered neighbour there is a single fragment
_LABELS = (
    "IF(forall(sequence(0, size(m.atoms) - 1), i -> i = 0 OR exists(m.adj[i], w -> w.atom < i)), "
    "array_repeat(0, size(m.atoms)), "
    "aggregate(m.bonds, sequence(0, size(m.atoms) - 1), (lab, b) -> IF(lab[b.a] = lab[b.b], lab, "
    "transform(lab, v -> IF(v = greatest(lab[b.a], lab[b.b]), least(lab[b.a], lab[b.b]), v)))))"
)
COMPONENT_COUNT_SQL = f"IF({_NO_ATOMS}, 0, size(array_distinct({_LABELS})))"
RING_COUNT_SQL = f"IF({_NO_ATOMS}, 0, size(m.bonds) - size(m.atoms) + {COMPONENT_COUNT_SQL})"


def connected_components(mol: str) -> Column:
    """Fragment number of each atom, numbered in order of first appearance."""
    numbered = let(
        _LABELS,
        "lab",
        let(
            "array_distinct(lab)",
            "roots",
            "transform(lab, v -> cast(array_position(roots, v) as int) - 1)",
        ),
    )
    return _on(mol, f"IF({_NO_ATOMS}, {_INT_ARRAY}, {numbered})")


def num_components(mol: str) -> Column:
    return _on(mol, COMPONENT_COUNT_SQL)


def ring_count(mol: str) -> Column:
    """Independent cycles: bonds - atoms + fragments."""
    return _on(mol, RING_COUNT_SQL)


def degrees(mol: str) -> Column:
    """Neighbours of each atom, hydrogens included."""
    return F.expr(f"transform({mol}.adj, n -> size(n))")


def heavy_degrees(mol: str) -> Column:
    """Neighbours of each atom heavier than hydrogen."""
    return _on(mol, "transform(m.adj, n -> size(filter(n, w -> m.atoms[w.atom].z > 1)))")


def explode_atoms(df: DataFrame, key: str, mol: str = "mol") -> DataFrame:
    """Long form: one row per atom."""
    return df.select(key, F.posexplode(f"{mol}.atoms").alias("idx", "atom")).select(key, "idx", "atom.*")


def explode_bonds(df: DataFrame, key: str, mol: str = "mol") -> DataFrame:
    """Long form: one row per bond."""
    return df.select(key, F.posexplode(f"{mol}.bonds").alias("bond_idx", "bond")).select(
        key, "bond_idx", "bond.*"
    )


def describe(mol: str, error: str, smiles: str) -> Column:
    """Readable listing of the atoms and bonds, or of the parse error."""
    from .elements import SYMBOLS

    syms = "array(" + ", ".join(f"'{s}'" for s in SYMBOLS) + ")"
    atom_line = (
        f"format_string('[%d] %s H%d q%+d%s%s deg=%d', i, {syms}[x.z], x.num_h, x.charge, "
        "IF(x.aromatic, ' arom', ''), IF(x.in_ring, ' ring', ''), size(m.adj[i]))"
    )
    bond_line = (
        "concat(y.a, CASE y.bond_order WHEN 1 THEN '-' WHEN 2 THEN '=' WHEN 3 THEN '#' WHEN 4 THEN '$' "
        "WHEN 5 THEN ':' ELSE '?' END, y.b, IF(y.in_ring, ' (ring)', ''))"
    )
    body = f"array_join(concat(transform(m.atoms, (x, i) -> {atom_line}), transform(m.bonds, y -> {bond_line})), '\\n')"
    return F.expr(
        f"concat({smiles}, '\\n', IF({error} IS NULL, {let(mol, 'm', body)}, "
        f"format_string('PARSE ERROR: %s at %d', {error}.message, {error}.position)))"
    )
