"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to words and cut into windows of
consecutive words.  All windows go into one automaton; each document is
normalised the same way and scanned once, and every occurrence is mapped back
to word numbers and to character offsets of the original text.

The scan is a narrow map over the documents: no shuffle, so no document key
can be hot.  Only the automaton travels.  Its size is measured first, and a
test set beyond ``automaton_bytes`` is cut into several automata, each a pass
of its own over a checkpointed table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, checkpointed, lower_ascii, utf8, words_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")

SPAN = T.StructType(
    [
        T.StructField("first_word", T.IntegerType()),
        T.StructField("last_word", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window, items): each distinct window of words with the ids it comes from."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    cut = items.select(F.col(id_col).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(width), F.lit(0)))
    return (
        cut.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, width), " "))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def scanner(windows: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """The automaton; a space on both sides of a window keeps to whole words."""
    auto = ahocorasick.Automaton()
    for number, (window, _) in enumerate(windows):
        auto.add_word(f" {window} ", (number, window.count(" ") + 1))
    if windows:
        auto.make_automaton()
    return auto


def scan_text(auto: ahocorasick.Automaton, windows: list[tuple[str, list[str]]], text: bytes) -> dict:
    """Words, merged spans of hit words, and items of one document."""
    words = words_of(text)
    found = list(auto.iter(" " + b" ".join(words).decode() + " ")) if windows and words else []
    if not found:
        return {"n_words": len(words), "spans": [], "items": []}
    # the word after each space of the normalised text, by position
    at, after = 0, {}
    for number, word in enumerate(words):
        after[at] = number
        at += len(word.decode()) + 1
    after[at] = len(words)
    places = sorted((after[end] - size, after[end] - 1) for end, (_, size) in found)
    merged: list[list[int]] = []
    for first, last in places:
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    where = [m.span() for m in WORD_BYTES.finditer(text.translate(LOWER))]
    spans = []
    for first, last in merged:
        start = len(text[: where[first][0]].decode())
        spans.append({"first_word": first, "last_word": last, "start": start, "end": start + len(text[where[first][0] : where[last][1]].decode())})
    items = {i for number, _ in {value for _, value in found} for i in windows[number][1]}
    return {"n_words": len(words), "spans": spans, "items": sorted(items)}


def _scan(windows) -> Column:
    found_type = pa.struct(
        [
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
            ("items", pa.list_(pa.string())),
        ]
    )

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        listed = windows.value
        auto = scanner(listed)
        for batch in batches:
            yield pa.array([scan_text(auto, listed, text.as_py()) for text in batch], found_type)

    return F.arrow_udf(run, FOUND).asNondeterministic()


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    out: str = "hits",
    automaton_bytes: int = 4 << 20,
) -> DataFrame:
    """All columns of ``docs`` plus ``out``: struct(n_words, spans, items).

    ``spans`` are the merged runs of hit words, with word numbers and
    [start, end) code points of the original text; ``items`` are the ids whose
    windows occur.  Null and empty texts have no words and no hits.  Items
    without words have no windows; repeated item ids add up; an item whose id
    is null marks words but is not listed.  An empty item table gives no hits.
    A column of ``docs`` that is already called ``out`` is replaced.
    """
    spark = docs.sparkSession
    windows = item_windows(items, item_id_col, item_text_col, width)
    size = windows.agg(F.sum(F.octet_length("window") + 2)).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    result = docs
    names = [f"__hits_{k}__" for k in range(parts)]
    for k, name in enumerate(names):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k)
        listed = spark.sparkContext.broadcast([(r["window"], r["items"]) for r in part.toLocalIterator()])
        result = result.withColumn(name, _scan(listed)(utf8(F.col(text_col))))
        if parts > 1:
            result = checkpointed(result)
    if parts == 1:
        both = F.col(names[0])
    else:
        both = F.struct(
            F.col(names[0])["n_words"].alias("n_words"),
            F.array_sort(F.flatten(F.array(*[F.col(n)["spans"] for n in names]))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(n)["items"] for n in names])))).alias("items"),
        )
    return result.withColumn(out, both).drop(*names)


def hit_words(hits: Column) -> Column:
    """Number of words inside any span, overlaps counted once."""
    numbers = F.flatten(F.transform(hits["spans"], lambda s: F.sequence(s["first_word"], s["last_word"])))
    return F.size(F.array_distinct(numbers)).cast("long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = F.col("hits")
    return (
        benchmark_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(options.pop("text_col", "text")).alias("text")), items, **options)
        .select(
            "doc_id",
            hits["n_words"].alias("n_words"),
            hit_words(hits).alias("n_hit"),
            F.size(hits["items"]).cast("long").alias("n_items"),
            F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns."""
    found = benchmark_hits(docs, items, out="__hits__", **options)
    return found.where(F.size(F.col("__hits__")["spans"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
