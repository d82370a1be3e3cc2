"""Measures taken from SMILES text without building a graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = r"(?s)\[[^\]]*\]|\[.*|Cl|Br|[BCNOPSFIbcnops]|[-=#$:/\\]|%[0-9]*|."

# Single-letter element codes.
LETTER_Z = {"C": 6, "N": 7, "O": 8, "S": 16, "P": 15, "F": 9, "B": 5, "I": 53,
            "c": 6, "n": 7, "o": 8, "s": 16, "p": 15, "b": 5}

# Kinds reported by the simple checker.
PARSE_ERROR_KINDS = ("EmptyInput", "UnbalancedParen", "UnbalancedBracket",
                     "UnknownAtom", "UnclosedRing", "InvalidCharacter")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_texts(s) -> Column:
    return F.regexp_extract_all(_col(s), F.lit(TOKENS), 0)


TOKEN_KINDS = (
    (r"^(\[[^\]]*\]|Cl|Br|[BCNOPSFIbcnops])$", "Atom"),
    (r"^[-=#$:/\\]$", "Bond"),
    (r"^(%[0-9]*|[0-9])$", "RingBond"),
    (r"^\($", "BranchOpen"),
    (r"^\)$", "BranchClose"),
    (r"^[.]$", "Dot"),
)


def _token_kind(t: Column) -> Column:
    kind = F
    for pattern, name in TOKEN_KINDS:
        kind = kind.when(t.rlike(pattern), name)
    return kind.otherwise("Unknown")


def tokenize(s) -> Column:
    """``array<struct<kind,text>>``; an unclosed bracket takes the rest of the text."""
    return F.transform(token_texts(s), lambda t: F.struct(_token_kind(t).alias("kind"), t.alias("text")))


def brackets_balanced(s) -> Column:
    """Both bracket kinds close, and neither ever closes too early."""
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(True).alias("ok"))

    def step(a, c):
        p = a.p + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        q = a.q + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(p.alias("p"), q.alias("q"), (a.ok & (p >= 0) & (q >= 0)).alias("ok"))

    marks = F.regexp_extract_all(_col(s), F.lit(r"[()\[\]]"), 0)
    return F.aggregate(marks, start, step, lambda a: a.ok & (a.p == 0) & (a.q == 0))


def _outside_brackets(s) -> Column:
    return F.regexp_replace(_col(s), r"\[[^\]]*\]?", " ")


def count_heavy_atoms(s) -> Column:
    """Atoms by text alone; every bracket counts once."""
    return F.regexp_count(_col(s), F.lit(r"\[")) + F.regexp_count(
        _outside_brackets(s), F.lit("Cl|Br|[BCNOPSFIbcnops]")
    )


def count_aromatic(s) -> Column:
    return F.regexp_count(_outside_brackets(s), F.lit("[bcnops]"))


def max_branch_depth(s) -> Column:
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("best"))

    def step(a, c):
        d = a.d + F.when(c == "(", 1).otherwise(-1)
        return F.struct(d.alias("d"), F.greatest(a.best, d).alias("best"))

    marks = F.regexp_extract_all(_col(s), F.lit("[()]"), 0)
    return F.aggregate(marks, start, step, lambda a: a.best)


def ring_digit_pairs(s) -> Column:
    return F.floor(F.regexp_count(_col(s), F.lit("[1-9]")) / 2).cast("int")


def letter_atomic_number(c) -> Column:
    out = None
    for letter, z in LETTER_Z.items():
        out = F.when(_col(c) == letter, z) if out is None else out.when(_col(c) == letter, z)
    return out.otherwise(0)


def _error(kind: str, pos: Column, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), pos.cast("int").alias("position"), detail.alias("detail"))


_ERR_T = "struct<kind:string,position:int,detail:string>"


def check_smiles(s) -> Column:
    """Simple syntax check: ``struct<atoms,ring_bonds,branches,error>``.

    Digits 1-9 toggle ring bonds, brackets count as one atom, bond and charge
    marks are skipped.  The first problem in reading order is reported; open
    parentheses, brackets and rings are reported at the end, in that order.
    """
    s = _col(s)
    none = F.lit(None).cast(_ERR_T)
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("branches"), F.lit(False).alias("inside"),
        F.lit(0).alias("rings"), F.lit(0).alias("closed"), F.lit(0).alias("atoms"), none.alias("error"),
    )

    def step(a, c):
        digit = c.rlike("^[1-9]$")
        bit = F.call_function("shiftleft", F.lit(1), F.expr("0") + F.when(digit, c.cast("int")).otherwise(0))
        outer = ~a.inside
        live = a.error.isNull()
        toggled = live & outer & digit
        opened = live & outer & (c == "(")
        closed = live & outer & (c == ")")
        error = (
            F.when(~live, a.error)
            .when((c == "[") & a.inside, _error("UnbalancedBracket", a.i, F.lit("nested '['")))
            .when((c == "]") & outer, _error("UnbalancedBracket", a.i, F.lit("unexpected ']'")))
            .when(a.inside, none)
            .when((c == ")") & (a.depth == 0), _error("UnbalancedParen", a.i, F.lit("extra ')'")))
            .when(~c.rlike(r"^[\[\]()1-9BCNOPSFIHbcnops\-=#$:/\\.@+]$"), _error("InvalidCharacter", a.i, c))
            .otherwise(none)
        )
        return F.struct(
            (a.i + 1).alias("i"),
            (a.depth + F.when(opened, 1).when(closed, -1).otherwise(0)).alias("depth"),
            (a.branches + opened.cast("int")).alias("branches"),
            F.when(~live, a.inside).when(c == "[", True).when(c == "]", False).otherwise(a.inside).alias("inside"),
            F.when(toggled, a.rings.bitwiseXOR(bit)).otherwise(a.rings).alias("rings"),
            (a.closed + (toggled & (a.rings.bitwiseAND(bit) != 0)).cast("int")).alias("closed"),
            (a.atoms + (live & ((c == "]") & a.inside | outer & c.rlike("^[BCNOPSFIHbcnops]$"))).cast("int")).alias("atoms"),
            error.alias("error"),
        )

    def finish(a):
        end = F.length(s)
        first_open = F.element_at(
            F.filter(F.sequence(F.lit(1), F.lit(9)), lambda r: F.getbit(a.rings.cast("bigint"), r) == 1), 1
        )
        error = (
            F.when(a.error.isNotNull(), a.error)
            .when(s == "", _error("EmptyInput", F.lit(0), F.lit("")))
            .when(a.depth != 0, _error("UnbalancedParen", end, F.concat(a.depth.cast("string"), F.lit(" unclosed"))))
            .when(a.inside, _error("UnbalancedBracket", end, F.lit("unclosed '['")))
            .when(a.rings != 0, _error("UnclosedRing", end, F.concat(F.lit("ring "), first_open.cast("string"))))
            .otherwise(none)
        )
        ok = error.isNull()
        return F.struct(
            F.when(ok, a.atoms).alias("atoms"), F.when(ok, a.closed).alias("ring_bonds"),
            F.when(ok, a.branches).alias("branches"), error.alias("error"),
        )

    return F.aggregate(F.regexp_extract_all(s, F.lit("(?s)."), 0), start, step, finish)


def describe_tree(s) -> Column:
    """Nested listing: ``Branch(Atom(C) Branch(Atom(O) ) )``."""
    parts = F.transform(
        tokenize(s),
        lambda t: F.when(t.kind == "Atom", F.concat(F.lit("Atom("), t.text, F.lit(") ")))
        .when(t.kind == "BranchOpen", F.lit("Branch("))
        .when(t.kind == "BranchClose", F.lit(") "))
        .otherwise(F.lit("")),
    )
    return F.concat(F.lit("Branch("), F.array_join(parts, ""), F.lit(")"))


def tree_atom_count(s) -> Column:
    return F.size(F.filter(tokenize(s), lambda t: t.kind == "Atom"))
