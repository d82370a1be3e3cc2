"""Structure-data (SDF, V2000) files.

A record is cut at its ``$$$$`` line by the text source, split into lines and
read with array expressions over fixed column positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import SYMBOLS
from ..functions.smiles import MOL_T, _adjacency, let

_SYMS = "array(" + ", ".join(f"'{s}'" for s in SYMBOLS[1:]) + ")"
# program line of written records
WRITER = "  molfold"


def _int_field(text: str, start: int, length: int) -> str:
    return f"try_cast(regexp_extract(substr({text}, {start}, {length}), '^ *(-?[0-9]+)', 1) as int)"


def _float_field(text: str, start: int, length: int) -> str:
    return (
        f"coalesce(try_cast(regexp_extract(substr({text}, {start}, {length}), "
        "'^[ \\\\t]*(-?(?:[0-9]+\\\\.?[0-9]*|\\\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) as double), 0.0D)"
    )


def _lines(column: str) -> str:
    return f"transform(split({column}, '\\n', -1), t -> regexp_replace(t, '\\\\r$', ''))"


_ATOM_LINES = "filter(slice(ln, 5, na), t -> length(t) >= 34)"
_BOND_LINES = (
    f"filter(slice(ln, 5 + na, nb), t -> length(t) >= 9 AND {_int_field('t', 1, 3)} IS NOT NULL "
    f"AND {_int_field('t', 4, 3)} IS NOT NULL)"
)
# lines after the bonds, up to and after the end mark
_REST = "slice(ln, 5 + na + nb, greatest(size(ln), 1))"
_END = "coalesce(array_position(transform(rest, t -> startswith(t, 'M  END')), true), 0)"
_CHARGES = (
    "flatten(transform(filter(IF(cut > 0, slice(rest, 1, cast(cut as int)), rest), t -> startswith(t, 'M  CHG')), t -> "
    + let(
        "filter(split(substr(t, 7), '[ \\\\t]+'), v -> v <> '')",
        "v",
        "IF(size(v) < 3 OR coalesce(try_cast(v[0] as int), 0) < 1, cast(array() as array<struct<i:int,q:int>>), "
        "transform(sequence(1, least(coalesce(try_cast(v[0] as int), 0), cast((size(v) - 1) div 2 as int))), "
        "k -> named_struct('i', try_cast(v[2 * k - 1] as int), 'q', try_cast(v[2 * k] as int))))",
    )
    + "))"
)
_MOL = (
    let(
        f"transform({_BOND_LINES}, t -> named_struct('a', {_int_field('t', 1, 3)} - 1, 'b', {_int_field('t', 4, 3)} - 1, "
        f"'bond_order', CASE coalesce({_int_field('t', 7, 3)}, 1) WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 ELSE 1 END, "
        "'in_ring', false))",
        "bonds",
        let(
            f"transform({_ATOM_LINES}, (t, i) -> named_struct("
            f"'z', cast(array_position({_SYMS}, trim(both ' \\t\\r' from substr(t, 32, 3))) as int), "
            "'charge', coalesce(try_element_at(filter(chg, c -> c.i = i + 1), -1).q, 0), 'num_h', 0, 'isotope', 0, "
            "'aromatic', false, 'in_ring', false, 'explicit_h', false, 'chirality', 0))",
            "atoms",
            f"cast(named_struct('atoms', atoms, 'bonds', bonds, 'adj', {_adjacency('size(atoms)', 'bonds')}) as {MOL_T})",
        ),
    )
)
_PROP_T = "struct<k:string,v:string>"
# fold over the property lines: finished pairs, current key, current value
_PROPS = (
    "aggregate(IF(cut > 0, slice(rest, cast(cut as int) + 1, size(rest)), cast(array() as array<string>)), "
    f"named_struct('done', cast(array() as array<{_PROP_T}>), 'k', '', 'v', ''), (s, t) -> CASE "
    "WHEN length(t) > 3 AND left(t, 1) = '>' THEN named_struct('done', IF(s.k = '', s.done, "
    "array_append(s.done, named_struct('k', s.k, 'v', s.v))), 'k', "
    "IF(t rlike '<[^>]*>', regexp_extract(t, '<([^>]*)>', 1), ''), 'v', IF(s.k = '', s.v, '')) "
    "WHEN s.k = '' THEN s "
    "WHEN t = '' THEN named_struct('done', array_append(s.done, named_struct('k', s.k, 'v', s.v)), 'k', '', 'v', '') "
    "ELSE named_struct('done', s.done, 'k', s.k, 'v', IF(s.v = '', t, concat(s.v, '\\n', t))) END, "
    "s -> IF(s.k = '', s.done, array_append(s.done, named_struct('k', s.k, 'v', s.v))))"
)
# the first of two equal keys wins
_PROP_MAP = let(
    _PROPS,
    "ps",
    "map_from_entries(filter(ps, (p, i) -> cast(array_position(transform(ps, q -> q.k), p.k) as int) = i + 1))",
)
_RECORD = let(
    _REST,
    "rest",
    let(
        _END,
        "cut",
        let(
            _CHARGES,
            "chg",
            "named_struct('name', trim(both ' \\t' from ln[0]), "
            f"'mol', {_MOL}, "
            f"'x', transform({_ATOM_LINES}, t -> {_float_field('t', 1, 10)}), "
            f"'y', transform({_ATOM_LINES}, t -> {_float_field('t', 11, 10)}), "
            f"'z', transform({_ATOM_LINES}, t -> {_float_field('t', 21, 10)}), "
            f"'props', {_PROP_MAP})",
        ),
    ),
)


def parse_record(column: str) -> Column:
    """Struct of one record's text (without its ``$$$$`` line); NULL when the
    counts line cannot be read or fewer lines follow than it announces."""
    counts = let(
        _int_field("ln[3]", 1, 3),
        "na",
        let(
            _int_field("ln[3]", 4, 3),
            "nb",
            f"IF(na IS NULL OR nb IS NULL OR size(ln) < 4 + na + nb, NULL, {_RECORD})",
        ),
    )
    return F.expr(let(_lines(column), "ln", f"IF(size(ln) < 4 OR length(get(ln, 3)) < 6, NULL, {counts})"))


def records_from_texts(texts: DataFrame, column: str = "value") -> DataFrame:
    """(name, mol, x, y, z, props) of record texts; records without atoms are
    skipped, other columns are kept."""
    return (
        texts.withColumn("_r", parse_record(column))
        .drop(column)
        .select("*", "_r.*")
        .drop("_r")
        .where("mol IS NOT NULL AND size(mol.atoms) > 0")
    )


# a record's end mark: the rest of its line is ignored
_END_MARK = r"(?m)^\$\$\$\$[^\n]*(?:\n|\z)"


def read_sdf(spark: SparkSession, path: str, stop_at_broken: bool = True, line_end: str = "\n") -> DataFrame:
    """All records of one or more files.

    Files are cut at ``$$$$`` + ``line_end``, so large files are read by many
    tasks; give ``"\\r\\n"`` for files with CRLF line ends (either kind is
    read correctly, but only the matching one splits inside a file).

    With ``stop_at_broken`` nothing after a record whose counts line cannot be
    read is returned from that file; otherwise such records are skipped.
    """
    raw = spark.read.text(path, lineSep="$$$$" + line_end).select(
        F.posexplode(F.split("value", _END_MARK, -1)).alias("pos", "value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    parsed = raw.where("value <> ''").withColumn("_r", parse_record("value"))
    if stop_at_broken:
        broken = (
            parsed.where(F.col("_r").isNull())
            .groupBy("file")
            .agg(F.min(F.struct("block", "row", "pos")).alias("first"))
        )
        parsed = parsed.join(broken, "file", "left").where(
            "first IS NULL OR struct(block, row, pos) < first"
        )
    return parsed.select("_r.*").where("mol IS NOT NULL AND size(mol.atoms) > 0")


def prop_double(key: str, props: str = "props") -> Column:
    """A property as a double; NULL when absent or not a number."""
    text = F.col(props).getItem(key)
    return F.regexp_extract(text, r"^[ \t]*(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def format_record(name: str, mol: str, x: str, y: str, z: str, props: str) -> Column:
    """V2000 text of a record, ``$$$$`` included (charges are not written).

    The format counts atoms and bonds in three digits; a molecule of more
    raises an error.
    """
    syms = "array(" + ", ".join(f"'{s}'" for s in SYMBOLS) + ")"
    atom = (
        f"format_string('%10.4f%10.4f%10.4f %-3s 0  0  0  0  0  0  0  0  0  0  0  0', "
        f"coalesce(get({x}, i), 0.0D), coalesce(get({y}, i), 0.0D), coalesce(get({z}, i), 0.0D), {syms}[t.z])"
    )
    bond = (
        "format_string('%3d%3d%3d  0', t.a + 1, t.b + 1, "
        "CASE t.bond_order WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 4 ELSE 1 END)"
    )
    most = f"greatest(size({mol}.atoms), size({mol}.bonds))"
    return F.expr(
        f"CASE WHEN {most} > 999 THEN raise_error(concat('V2000 holds 999 atoms and bonds at most, ', {name}, ' has ', {most})) ELSE "
        f"array_join(concat(array({name}, '{WRITER}', '', "
        f"format_string('%3d%3d  0  0  0  0  0  0  0  0999 V2000', size({mol}.atoms), size({mol}.bonds))), "
        f"transform({mol}.atoms, (t, i) -> {atom}), transform({mol}.bonds, t -> {bond}), array('M  END'), "
        f"flatten(transform(array_sort(map_entries({props})), e -> array(concat('>  <', e.key, '>'), e.value, ''))), "
        "array('$$$$')), '\\n') END"
    )


def write_sdf(df: DataFrame, path: str) -> None:
    """Write (name, mol, x, y, z, props) rows."""
    df.select(format_record("name", "mol", "x", "y", "z", "props").alias("value")).write.mode("overwrite").text(path)
