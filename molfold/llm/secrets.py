"""Secrets in texts, with built-in functions only.

Two kinds of evidence are joined.  Fixed patterns find assignments to
password-like names, access key ids and long hexadecimal runs.  Beyond them,
every run of one character class long enough for the window is a candidate: a
window slides over it, the count of each character in the window is kept up
to date as one character enters and one leaves, and so is the window's
Shannon entropy.  Windows at or above the threshold of the class are joined
to one span per run; runs on the allow-list (words, numbers, UUIDs) are passed
over, and so are those whose parts between separators are all ordinary: words,
camel case, numbers, a word with a few digits, time stamps.  Paths, slugs and
file names are made of such parts.

Everything is one expression per row: no shuffle, and no Python on the way.
A regular expression has no positions in SQL, so matches are fenced with a
control character, the text is cut there, and lengths are added up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Fixed patterns: kind, regular expression, group and least length.  A greedy
#: run of one class is long enough exactly if the class repeats that often.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16))

DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Entropy is computed from c * log2(c) in millionths, so that sums are exact.
UNIT = 1_000_000
FENCE, STAND_IN = "\x01", "\x02"
#: Matches are numbered in blocks, which keeps very long texts from quadratic cost.
BLOCK = 512


@dataclass(frozen=True)
class CharacterClass:
    """Characters that make up a candidate run, and the bits per character that give one away."""

    kind: str
    alphabet: str
    pattern: str
    threshold: float


#: Bits a window of random characters of the class nearly always reaches.
CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdefABCDEF", "[0-9A-Fa-f]", 2.9),
    CharacterClass("entropy_base64", DIGITS + LETTERS + "+/_-", "[0-9A-Za-z+/_-]", 3.6),
)
WINDOW = 20
ALLOWED = (
    "[A-Za-z]+",  # words
    "[0-9]+",  # numbers
    "[A-Za-z]+([-_/+][A-Za-z]+)+[-_/+]?",  # compounds and paths of words
    "[-_/+]+[A-Za-z]*",  # rules and flags
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",  # UUIDs
    "[0-9]+([-_/+][0-9]+)+",  # dates and number lists
)
SEPARATORS = "[-_/+]+"
#: One part of a path, slug or file name; repetitions are bounded, as Java's matcher recurses.
ORDINARY = (
    "",
    "([A-Z]?[a-z]+|[A-Z]+)([A-Z][a-z]{2,}){0,7}[0-9]{0,6}",  # words, camel case, a few digits after
    "[0-9]+[a-z]{0,2}",  # numbers with a unit or an ending
    "[0-9]{1,8}[Tx][0-9]{1,6}Z?",  # times and sizes
)


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of struct(start, end, found), in code points."""
    fenced = F.regexp_replace(F.translate(text, FENCE, STAND_IN), f"({pattern})", f"{FENCE}$0{FENCE}")

    def walk(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("hits"))

        def step(state: Column, piece: Column) -> Column:
            end = state["at"] + F.length(piece["text"])
            hit = F.struct(state["at"].alias("start"), end.alias("end"), piece["text"].alias("found"))
            return F.struct(end.alias("at"), F.when(piece["odd"], F.array_append(state["hits"], hit)).otherwise(state["hits"]).alias("hits"))

        numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("odd")))

        def place(numbered: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.size(numbered) - 1) / BLOCK).cast("int"))
            local = F.transform(blocks, lambda b: F.aggregate(F.slice(numbered, b * BLOCK + 1, BLOCK), start, step))

            def shift(local: Column) -> Column:
                before = lambda b: F.aggregate(F.slice(local, 1, b), F.lit(0), lambda n, x: n + x["at"])
                moved = lambda x, by: F.transform(
                    x["hits"], lambda h: F.struct((h["start"] + by).alias("start"), (h["end"] + by).alias("end"), h["found"].alias("found"))
                )
                return F.flatten(F.transform(local, lambda x, b: let(before(b), lambda by: moved(x, by))))

            return let(local, shift)

        return let(numbered, place)

    return let(F.split(fenced, FENCE, -1), walk)


def base_matches(text: Column, pattern: str, group: int, least: int) -> Column:
    found = match_spans(text, pattern)
    kept = lambda m: F.length(F.regexp_extract(m["found"], f"({pattern})" if group == 0 else pattern, group)) >= least
    return F.filter(found, kept)


def char_cost(window: int) -> list[int]:
    """c * log2(c) for each count c in a window, in UNIT."""
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, window + 1)]


def most_cost(window: int, bits: float) -> int:
    """The largest sum of char_cost at which a window still has ``bits`` per character."""
    return math.floor((math.log2(window) - bits) * window * UNIT)


def dense_windows(run: Column, kind: CharacterClass, window: int) -> Column:
    """struct(first, last) of the run's dense windows: start of the first, end of the last; null if none."""
    costs = F.array(*[F.lit(c).cast("long") for c in char_cost(window)])
    limit = most_cost(window, kind.threshold)
    size = len(kind.alphabet)
    index = lambda i: F.instr(F.lit(kind.alphabet), F.substring(run, i + 1, F.lit(1))) - 1
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"),
        F.lit(0).cast("long").alias("cost"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def step(state: Column, i: Column) -> Column:
        comes, goes = index(i), F.when(i >= window, index(i - window)).otherwise(-1)

        def slide(at: Column) -> Column:
            comes, goes = at["comes"], at["goes"]
            n_in = F.get(state["counts"], comes)
            n_out = F.get(state["counts"], goes)
            change = (
                F.when(comes == goes, F.lit(0).cast("long"))
                .when(goes < 0, F.get(costs, n_in + 1) - F.get(costs, n_in))
                .otherwise(F.get(costs, n_in + 1) - F.get(costs, n_in) + F.get(costs, n_out - 1) - F.get(costs, n_out))
            )
            counts = F.transform(
                state["counts"], lambda c, j: c + F.when(j == comes, 1).otherwise(0) - F.when(j == goes, 1).otherwise(0)
            )

            def note(cost: Column) -> Column:
                dense = (i >= window - 1) & (cost <= limit)
                return F.struct(
                    counts.alias("counts"),
                    cost.alias("cost"),
                    F.when(dense & state["first"].isNull(), i - (window - 1)).otherwise(state["first"]).alias("first"),
                    F.when(dense, i + 1).otherwise(state["last"]).alias("last"),
                )

            return let(state["cost"] + change, note)

        return let(F.struct(comes.cast("int").alias("comes"), goes.cast("int").alias("goes")), slide)

    ended = lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last")))
    return F.aggregate(F.sequence(F.lit(0), F.length(run) - 1), start, step, ended)


def entropy_matches(text: Column, kind: CharacterClass, window: int, allowed: tuple[str, ...], ordinary: tuple[str, ...]) -> Column:
    """array of struct(start, end) of dense stretches in runs of the class."""
    asked = match_spans(text, f"{kind.pattern}{{{window},}}")
    whole = lambda text, listed: F.rlike(text, F.lit(f"^({'|'.join(listed)})$"))
    if allowed:
        asked = F.filter(asked, lambda m: ~whole(m["found"], allowed))
    if ordinary:
        asked = F.filter(asked, lambda m: ~F.forall(F.split(m["found"], SEPARATORS, -1), lambda part: whole(part, ordinary)))
    dense = F.transform(
        asked,
        lambda m: let(
            dense_windows(m["found"], kind, window),
            lambda d: F.when(d.isNotNull(), F.struct((m["start"] + d["first"]).alias("start"), (m["start"] + d["last"]).alias("end"))),
        ),
    )
    return F.filter(dense, lambda d: d.isNotNull())


def secret_spans(
    text: Column,
    window: int = WINDOW,
    classes: tuple[CharacterClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
    ordinary: tuple[str, ...] = ORDINARY,
) -> Column:
    """All spans of a text, sorted: array of struct(start, rank, end, kind).

    Null and empty texts have none.  Kinds of equal start keep the order
    assign, access, hex, then the entropy classes.
    """
    text = F.coalesce(text, F.lit(""))
    kinds = [(kind, base_matches(text, pattern, group, least)) for kind, pattern, group, least in BASE]
    kinds += [(c.kind, entropy_matches(text, c, window, allowed, ordinary)) for c in classes]

    def shaped(rank: int, kind: str, spans: Column) -> Column:
        one = lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))
        return F.transform(spans, one)

    return F.array_sort(F.flatten(F.array(*[shaped(rank, *k) for rank, k in enumerate(kinds)])))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per document, repeated rows included."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(secret_spans(F.col(text_col), **options))).alias("all"))
    base = F.filter("all", lambda s: s["rank"] < len(BASE))
    count = lambda rank: F.size(F.filter("all", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(BASE)],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("all")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one.

    A null text stays null.  ``length_col``, if given, is set to the new
    length.  Other columns are left alone, whatever their names.
    """
    others = [c for c in docs.columns if c != text_col]
    with_spans = docs.select(
        *[F.col(f"`{c}`") for c in others],
        F.explode(F.array(F.struct(F.col(f"`{text_col}`").alias("text"), secret_spans(F.col(f"`{text_col}`"), **options).alias("spans")))).alias("__found__"),
    )
    found = F.col("__found__")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(found["text"], state["at"] + 1, span["start"] - state["at"])
        return (
            F.when(span["end"] <= state["at"], state)
            .when(span["start"] < state["at"], F.struct(span["end"].alias("at"), state["out"].alias("out")))
            .otherwise(F.struct(span["end"].alias("at"), F.concat(state["out"], between, F.lit(mark)).alias("out")))
        )

    ended = lambda s: F.concat(s["out"], F.substring(found["text"], s["at"] + 1, F.length(found["text"])))
    clean = F.when(F.size(found["spans"]) == 0, found["text"]).otherwise(F.aggregate(found["spans"], start, step, ended))
    result = with_spans.withColumn(text_col, F.when(found["text"].isNotNull(), clean)).select(*[F.col(f"`{c}`") for c in docs.columns])
    if length_col:
        result = result.withColumn(length_col, F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType))
    return result
