"""SMILES to molecular graph, as one Catalyst expression.

The text is cut into tokens with a regular expression, the tokens are folded
left to right with ``aggregate``, and the result is finished with
``transform``.  No Python runs per row, and no shuffle is needed.

Fold state (all indices are 0-based atom numbers)

``path``   atoms from the root of the current fragment to the current atom,
``stack``  saved paths, one per open parenthesis,
``open``   ring digits waiting for their partner, each with its own path,
``bonds``  bonds so far,
``hit``    atoms whose bond to their predecessor lies on a closed cycle.

When a ring closes between atoms whose paths are P and Q, the bonds on the
cycle are those leading to the atoms in (P \\ Q) + (Q \\ P), plus the closing
bond itself, so ring membership falls out of the fold.  Only when a ring digit
ties two dot-separated fragments together (``C1.C1``) does that not hold; such
rows are marked ``tied`` and their bonds are tested by reachability.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elements import SYMBOLS, VALENCES, Z
from .once import with_once

# Bond order codes: 1 single, 2 double, 3 triple, 4 quadruple, 5 aromatic.
AROMATIC = 5

ATOM_T = (
    "struct<z:int,charge:int,num_h:int,isotope:int,aromatic:boolean,in_ring:boolean,"
    "explicit_h:boolean,chirality:int>"
)
BOND_T = "struct<a:int,b:int,bond_order:int,in_ring:boolean>"
NBR_T = "struct<atom:int,bond:int,bond_order:int,in_ring:boolean>"
MOL_T = f"struct<atoms:array<{ATOM_T}>,bonds:array<{BOND_T}>,adj:array<array<{NBR_T}>>>"
ERROR_T = "struct<message:string,position:int>"

_TWO = [s for s in SYMBOLS if len(s) == 2]
_ONE = [s for s in SYMBOLS if len(s) == 1]


def _alternatives() -> str:
    upper = _TWO + _ONE
    lower = [s[0].lower() + s[1:] for s in upper]
    return "|".join([r"\*"] + _two_first(upper) + _two_first(lower))


def _two_first(symbols):
    return sorted(symbols, key=lambda s: -len(s))


_SYM = _alternatives()
_CHARGE = r"\+(?:[0-9]+|\+*)|-(?:[0-9]+|-*)"
# groups: 1 isotope, 2 symbol, 3 chirality, 4 hydrogens, 5 charge, 6 class
_BRACKET_BODY = rf"\[([0-9]*)({_SYM})(@@?)?(H[0-9]*)?({_CHARGE})?(:[0-9]*)?"
_BRACKET = rf"^{_BRACKET_BODY}\]$"
_BRACKET_PREFIX = rf"^({_BRACKET_BODY})"
_NC = _BRACKET_BODY.replace("(", "(?:").replace("(?:?:", "(?:")
_TOKEN = rf"(?s){_NC}\]|\[.*|Cl|Br|%[0-9][0-9]|%.*|."

_ORGANIC = [(t, Z[t]) for t in ("Cl", "Br", "B", "C", "N", "O", "F", "P", "S", "I")]
_AROMATIC_ORGANIC = [(t.lower(), Z[t]) for t in ("B", "C", "N", "O", "P", "S")]
_ATOM_TOKENS = [t for t, _ in _ORGANIC] + [t for t, _ in _AROMATIC_ORGANIC]

_FIELDS = ("n", "atoms", "path", "stack", "open", "bonds", "hit", "pend", "tied", "err", "at")

# error codes kept in the fold; texts are attached once at the end
_ERR_TEXT = {
    2: "branch without preceding atom",
    3: "unmatched ')'",
    4: "ring closure without preceding atom",
    5: "ring closure to itself",
}


def _next(**changes: str) -> str:
    parts = [f"'{f}', {changes.get(f, 's.' + f)}" for f in _FIELDS]
    return "named_struct(" + ", ".join(parts) + ")"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _sql_regex(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """SQL text binding ``name`` to ``value`` inside ``body`` (evaluated once)."""
    return f"transform(array({value}), {name} -> {body})[0]"


_IS_BRACKET = f"left(x, 1) = '[' AND x rlike {_sql_regex(_BRACKET)}"

_ZERO = (
    "named_struct('n', 0, 'atoms', cast(array() as array<string>), 'path', cast(array() as array<int>), 'stack', cast(array() as array<array<int>>), "
    "'open', cast(array() as array<struct<id:int,path:array<int>,o:int>>), "
    "'bonds', cast(array() as array<struct<a:int,b:int,o:int,cl:boolean>>), "
    "'hit', cast(array() as array<int>), 'pend', 0, 'tied', false, 'err', 0, 'at', 0)"
)

_STEP_ATOM = _next(
    n="s.n + 1",
    atoms="array_append(s.atoms, x)",
    at="s.at + 1",
    path="array_append(s.path, s.n)",
    bonds="IF(size(s.path) = 0, s.bonds, array_append(s.bonds, "
    "named_struct('a', element_at(s.path, -1), 'b', s.n, 'o', s.pend, 'cl', false)))",
    pend="0",
)
_STEP_BOND = _next(
    pend="CASE x WHEN '=' THEN 2 WHEN '#' THEN 3 WHEN '$' THEN 4 WHEN ':' THEN 5 ELSE 1 END",
    at="s.at + 1",
)


def _fail(code: int) -> str:
    return _next(err=str(code))


_STEP_OPEN = f"IF(size(s.path) = 0, {_fail(2)}, {_next(stack='array_append(s.stack, s.path)', at='s.at + 1')})"
_STEP_CLOSE = (
    f"IF(size(s.stack) = 0, {_fail(3)}, "
    + _next(path="element_at(s.stack, -1)", stack="slice(s.stack, 1, size(s.stack) - 1)", at="s.at + 1")
    + ")"
)
_STEP_DOT = _next(path="cast(array() as array<int>)", pend="0", at="s.at + 1")

_RING_OPENED = _next(
    open="array_append(s.open, named_struct('id', k, 'path', s.path, 'o', s.pend))",
    pend="0",
    at="s.at + 1",
)
_RING_CLOSED = _next(
    open="filter(s.open, w -> w.id <> k)",
    bonds="array_append(s.bonds, named_struct('a', element_at(p.path, -1), 'b', element_at(s.path, -1), "
    "'o', IF(s.pend <> 0, s.pend, p.o), 'cl', true))",
    hit="concat(s.hit, array_except(p.path, s.path), array_except(s.path, p.path))",
    tied="s.tied OR p.path[0] <> s.path[0]",
    pend="0",
    at="s.at + 1",
)
_STEP_RING = (
    f"IF(size(s.path) = 0, {_fail(4)}, "
    + let(
        "cast(ltrim('%', x) as int)",
        "k",
        let(
            "filter(s.open, w -> w.id = k)",
            "m",
            f"CASE WHEN size(m) = 0 THEN {_RING_OPENED} "
            f"WHEN element_at(m[0].path, -1) = element_at(s.path, -1) THEN {_fail(5)} "
            f"ELSE {let('m[0]', 'p', _RING_CLOSED)} END",
        ),
    )
    + ")"
)

_STEP = f"""CASE
  WHEN s.err <> 0 THEN s
  WHEN x IN ({_quoted(_ATOM_TOKENS)}) THEN {_STEP_ATOM}
  WHEN x = '(' THEN {_STEP_OPEN}
  WHEN x = ')' THEN {_STEP_CLOSE}
  WHEN x rlike '^(?:[0-9]|%[0-9][0-9])$' THEN {_STEP_RING}
  WHEN x IN ('-','=','#','$',':','/','\\\\') THEN {_STEP_BOND}
  WHEN {_IS_BRACKET} THEN {_STEP_ATOM}
  WHEN x = '.' THEN {_STEP_DOT}
  ELSE {_fail(1)} END"""

_Z_BY_SYMBOL = (
    "array_position(array(" + ", ".join(f"'{s}'" for s in SYMBOLS[1:]) + "), {sym})"
)


def _group(k: int) -> str:
    return f"regexp_extract(x, {_sql_regex(_BRACKET)}, {k})"


def _digits(text: str, most: int) -> str:
    """Digits to int; digit runs too long for an int are held at ``most``."""
    return f"cast(least(coalesce(try_cast({text} as bigint), {most}), {most}) as int)"


def _wrap_u8(v: str) -> str:
    return f"(({v}) & 255)"


def _wrap_i8(v: str) -> str:
    return f"((({v}) + 128) & 255) - 128"


_ISO = f"IF({_group(1)} = '', 0, {_digits(_group(1), 256)})"
_H_TEXT = f"substr({_group(4)}, 2)"
_H = (
    f"CASE WHEN {_group(4)} = '' THEN 0 WHEN {_H_TEXT} = '' THEN 1 "
    f"ELSE {_digits(_H_TEXT, 2147483647)} END"
)
_CHARGE_TEXT = f"substr({_group(5)}, 2)"
_MAG = (
    f"CASE WHEN {_group(5)} = '' THEN 0 WHEN {_CHARGE_TEXT} rlike '^[0-9]' "
    f"THEN {_digits(_CHARGE_TEXT, 1000000000)} ELSE length({_group(5)}) END"
)

_BRACKET_ATOM = (
    "named_struct('z', cast("
    + _Z_BY_SYMBOL.format(sym=f"initcap({_group(2)})")
    + f" as int), 'charge', {_wrap_i8(f'IF(left({_group(5)}, 1) = ' + chr(39) + '-' + chr(39) + f', -({_MAG}), {_MAG})')}, "
    f"'num_h', {_wrap_u8(_H)}, 'isotope', IF({_ISO} > 255, 0, {_ISO}), "
    f"'aromatic', {_group(2)} rlike '^[a-z]', 'explicit_h', true, "
    f"'chirality', CASE {_group(3)} WHEN '@@' THEN 1 WHEN '@' THEN 2 ELSE 0 END)"
)
_PLAIN_ATOM = (
    "named_struct('z', CASE x "
    + " ".join(f"WHEN '{t}' THEN {z}" for t, z in sorted(_ORGANIC + _AROMATIC_ORGANIC, key=lambda p: p[0].upper() != "C"))
    + " ELSE 0 END, 'charge', 0, 'num_h', 0, 'isotope', 0, "
    "'aromatic', x >= 'a', 'explicit_h', false, 'chirality', 0)"
)
_RAW_ATOM = f"IF(left(x, 1) = '[', {_BRACKET_ATOM}, {_PLAIN_ATOM})"

# ring flag of bond number j when fragments are tied by a ring digit: follow
# the remaining bonds from one end and see whether the other end is reached
_REACHED = (
    "aggregate(sequence(1, greatest(f.n, 1)), array(y.a), (seen, _i) -> "
    "array_union(seen, flatten(transform(filter(f.bonds, (w, wi) -> wi <> j AND "
    "array_contains(seen, w.a) <> array_contains(seen, w.b)), w -> array(w.a, w.b)))))"
)
_BOND_ROWS = (
    "transform(f.bonds, (y, j) -> named_struct('a', y.a, 'b', y.b, 'bond_order', "
    f"CASE WHEN y.o <> 0 THEN y.o WHEN raw[y.a].aromatic AND raw[y.b].aromatic THEN {AROMATIC} ELSE 1 END, "
    f"'in_ring', CASE WHEN f.tied THEN array_contains({_REACHED}, y.b) "
    "ELSE y.cl OR array_contains(f.hit, y.b) END))"
)

def _adjacency(n: str, bonds: str) -> str:
    """Neighbours of each atom in bond order, as (atom, bond, bond_order, in_ring)."""
    return (
        f"transform(sequence(0, {n} - 1), i -> filter(transform({bonds}, (y, j) -> "
        "IF(y.a = i, named_struct('atom', y.b, 'bond', j, 'bond_order', y.bond_order, 'in_ring', y.in_ring), "
        "IF(y.b = i, named_struct('atom', y.a, 'bond', j, 'bond_order', y.bond_order, 'in_ring', y.in_ring), NULL))), "
        "w -> w IS NOT NULL))"
    )


_VALENCE = "CASE r.z " + " ".join(f"WHEN {Z[s]} THEN {v}" for s, v in VALENCES.items()) + " ELSE 0 END"
# order sum in tenths, so that the arithmetic is exact: aromatic bonds count
# 1.5, an aromatic atom gives another 0.5, and 0.4 is added before truncation
_USED = (
    "cast(floor((aggregate(adj[i], 0, (acc, w) -> acc + IF(w.bond_order = 5, 15, w.bond_order * 10)) "
    "+ IF(r.aromatic, 5, 0) + 4) / 10) as int)"
)
_FINISHED = (
    "named_struct('atoms', transform(raw, (r, i) -> named_struct('z', r.z, 'charge', r.charge, "
    f"'num_h', IF(r.explicit_h OR ({_VALENCE}) = 0, r.num_h, greatest(0, ({_VALENCE}) - {_USED})), "
    "'isotope', r.isotope, 'aromatic', r.aromatic, "
    "'in_ring', exists(adj[i], w -> w.in_ring), "
    "'explicit_h', r.explicit_h, 'chirality', r.chirality)), 'bonds', bonds, 'adj', adj)"
)
_EMPTY_MOL = f"cast(named_struct('atoms', array(), 'bonds', array(), 'adj', array()) as {MOL_T})"

_BUILD = let(
    f"transform(f.atoms, x -> {_RAW_ATOM})",
    "raw",
    let(
        _BOND_ROWS,
        "bonds",
        let(_adjacency("size(raw)", "bonds"), "adj", _FINISHED),
    ),
)

# --- error text and position -------------------------------------------------
_BAD_POS = "length(array_join(slice(tok, 1, f.at), ''))"
_BAD_END = "length(array_join(slice(tok, 1, f.at + 1), ''))"
_ISO_LEN = "length(regexp_extract(bad, '^\\\\[[0-9]*', 0))"
_GOOD_LEN = f"length(regexp_extract(bad, {_sql_regex(_BRACKET_PREFIX)}, 1))"
_AFTER_ISO = f"substr(bad, {_ISO_LEN} + 1, 1)"


def _err(message: str, position: str) -> str:
    return f"named_struct('message', {message}, 'position', cast({position} as int))"


_BAD_TOKEN = f"""CASE
  WHEN left(bad, 1) = '[' THEN CASE
    WHEN length(bad) = {_ISO_LEN} THEN {_err("'unterminated bracket atom'", f"{_BAD_POS} + {_ISO_LEN}")}
    WHEN {_GOOD_LEN} > 0 THEN {_err('''"expected ']'"''', f"{_BAD_POS} + {_GOOD_LEN}")}
    WHEN {_AFTER_ISO} rlike '[a-z]' THEN
      {_err('''concat("unknown aromatic atom '", upper(''' + _AFTER_ISO + '''), "'")''', f"{_BAD_POS} + {_ISO_LEN}")}
    WHEN {_AFTER_ISO} rlike '[A-Z]' THEN
      {_err('''concat("unknown element '", ''' + _AFTER_ISO + ''', "'")''', f"{_BAD_POS} + {_ISO_LEN}")}
    ELSE {_err("'expected element symbol in bracket'", f"{_BAD_POS} + {_ISO_LEN}")} END
  WHEN left(bad, 1) = '%' THEN IF(bad rlike '^%[0-9]',
    {_err('''"expected two digits after '%'"''', f"{_BAD_POS} + 2")},
    {_err('''"expected digits after '%'"''', f"{_BAD_POS} + 1")})
  ELSE {_err('''concat("unexpected character '", bad, "'")''', _BAD_POS)} END"""

_KNOWN = "CASE f.err " + " ".join(f"WHEN {c} THEN \"{m}\"" for c, m in _ERR_TEXT.items()) + " END"

_ERROR = f"""CASE
  WHEN smi = '' THEN {_err("'empty SMILES'", "0")}
  WHEN f.err = 1 THEN {let("tok[f.at]", "bad", _BAD_TOKEN)}
  WHEN f.err <> 0 THEN {_err(_KNOWN, _BAD_END)}
  WHEN size(f.stack) > 0 THEN {_err('''"unclosed '('"''', "length(smi)")}
  WHEN size(f.open) > 0 THEN {_err("'unclosed ring bond'", "length(smi)")}
  END"""

_RESULT = let(
    _ERROR,
    "e",
    f"named_struct('mol', IF(e IS NULL, IF(f.n = 0, {_EMPTY_MOL}, {_BUILD}), NULL), 'error', e)",
)

_TOKENS = f"regexp_extract_all(smi, {_sql_regex(_TOKEN)}, 0)"


def _parse_sql(column: str) -> str:
    inner = let(_TOKENS, "tok", let(f"aggregate(tok, {_ZERO}, (s, x) -> {_STEP})", "f", _RESULT))
    return f"IF({column} IS NULL, NULL, {let(column, 'smi', inner)})"


def parse_smiles(column: str) -> Column:
    """Parse a SMILES column into ``struct<mol, error>``.

    Exactly one of the two fields is set; both are NULL for a NULL input.
    ``error.position`` counts characters from 0.
    """
    return F.expr(_parse_sql(column))


def with_molecule(df, column: str = "smiles"):
    """Add ``mol`` and ``error`` columns for a SMILES column."""
    return (
        with_once(df, "_parsed", parse_smiles(column))
        .withColumns({"mol": F.col("_parsed.mol"), "error": F.col("_parsed.error")})
        .drop("_parsed")
    )
