"""Spelling variants: words one inserted, deleted or replaced character apart.

Prefixes of all words are the nodes of a trie, suffixes those of the reversed
one; every node gets a number.  A place in a word is a pair of integers
(prefix node, suffix node):

* *skipped* places leave one character out, so words with the same pair differ
  in that character only;
* *whole* places lie between characters, so their pair names one word; a word
  with a skipped place of the same pair has one character more.

In a run of equal characters only the first counts as skipped towards whole
places, so every two near words meet exactly once.  A pair's words are at most
as many as there are letters, and one aggregation by pair tells each of them
how many others it meets and which is the largest; pairs of words are never
made.

Words are ranked first, larger counts before smaller ones and then in order of
their code points, and all further work is on these numbers: the largest near
word is the one of the least rank.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii

#: Runs of ASCII and Latin-1 letters.
LETTERS = "([A-Za-zÀ-ÿ]+)"

#: Characters of a node's text; longer nodes stand for what comes before by a digest.
STEP = 64
#: Nodes of up to so many characters hold many words and are joined in parts.
SHORT, PARTS = 3, 32


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n: letter runs of whole texts in small letters, with their occurrences.

    Where ``damage`` divides the CRC-32 of ``<id>:<word>``, the word loses the
    character that the CRC names; with None all words stay as they are.  A null
    text has no words, a null id is written as nothing.
    """
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS))).alias("run"))
    run = F.col("run")
    words = runs.where(F.length("run") >= least_length).select("doc_id", F.when(F.lower(run) == run, run).otherwise(lower_ascii(run)).alias("word"))
    if damage:
        word, size = F.col("word"), F.length("word")
        named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word)
        words = words.select("word", F.crc32(named.cast("binary")).alias("h"))
        at = (F.col("h") % size).cast("int")
        words = words.select(F.when(F.col("h") % damage == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, size))).otherwise(word).alias("word"))
    words = words.where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def node_texts(word: str) -> list[str]:
    """What names each prefix, the empty one first: its text, or beyond ``STEP``
    characters the digest of all whole steps and the text after them."""
    texts, before = [], ""
    for low in range(0, len(word) + 1, STEP):
        texts += [before + word[low:end] for end in range(low, min(low + STEP, len(word) + 1))]
        before = hashlib.sha256((before + word[low : low + STEP]).encode()).hexdigest()
    return texts


def _ends(word: Column) -> Column:
    """(side, at, end) of every prefix (side 0) and every suffix (side 1), which start or end at ``at``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("side", pa.int32()), ("at", pa.int32()), ("end", pa.string())]))
        for batch in batches:
            rows = []
            for value in batch:
                word = value.as_py()
                heads, tails = node_texts(word), node_texts(word[::-1])[::-1]
                rows.append([{"side": side, "at": at, "end": end} for side, ends in enumerate((heads, tails)) for at, end in enumerate(ends)])
            yield pa.array(rows, kind)

    return F.arrow_udf(run, "array<struct<side:int,at:int,end:string>>").asNondeterministic()(word)


def places(ranked: DataFrame) -> DataFrame:
    """rank, prefix, suffix, kind of every place of every word.

    ``kind`` is 0 for a whole place, 1 for a skipped character and 2 for a
    skipped one that follows its equal.
    """
    part = F.when(F.length("end") <= SHORT, F.pmod("rank", F.lit(PARTS))).otherwise(0)
    ends = checkpointed(ranked.select("rank", F.explode(_ends(F.col("word"))).alias("e")).select("rank", "e.*").withColumn("part", part))
    nodes = checkpointed(ends.select("side", "end").distinct().withColumn("node", F.monotonically_increasing_id()))
    parts = F.when(F.length("end") <= SHORT, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    numbered = ends.join(nodes.withColumn("part", F.explode(parts)), ["side", "end", "part"])
    of_side = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "node")))), lambda x: x["node"])
    nodes_of = numbered.groupBy("rank").agg(of_side(0).alias("p"), of_side(1).alias("s"))
    p, s, word = F.col("p"), F.col("s"), F.col("word")
    again = lambda k: (k > 0) & (F.substring(word, k + 1, F.lit(1)) == F.substring(word, k, F.lit(1)))
    place = lambda k, after, kind: F.struct(p[k].alias("prefix"), s[k + after].alias("suffix"), kind.alias("kind"))
    whole = F.transform(F.sequence(F.lit(0), F.length(word)), lambda k: place(k, 0, F.lit(0)))
    skipped = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda k: place(k, 1, F.when(again(k), 2).otherwise(1)))
    return ranked.join(nodes_of, "rank").select("rank", F.explode(F.concat(whole, skipped)).alias("x")).select("rank", "x.*")


def near_words(ranked: DataFrame) -> DataFrame:
    """rank, n_near, best: words that have near words, their number and the least rank among them."""
    met = places(ranked).groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(F.struct("rank", "kind"))).alias("m")).where(F.size("m") > 1)
    m = F.col("m")
    of = lambda wanted: F.transform(F.filter(m, wanted), lambda x: x["rank"])
    met = met.withColumns({"skipped": of(lambda x: x["kind"] > 0), "longer": of(lambda x: x["kind"] == 1), "shorter": of(lambda x: x["kind"] == 0)})
    first = lambda ranks: F.when(F.size(ranks) > 0, ranks[0])
    skipped, longer, shorter = F.col("skipped"), F.col("longer"), F.col("shorter")
    other = lambda x: F.when(skipped[0] != x["rank"], skipped[0]).when(F.size(skipped) > 1, skipped[1])
    told = F.transform(
        m,
        lambda x: F.struct(
            x["rank"].alias("rank"),
            F.when(x["kind"] == 0, F.size(longer)).otherwise(F.size(skipped) - 1 + F.when(x["kind"] == 1, F.size(shorter)).otherwise(0)).alias("n"),
            F.when(x["kind"] == 0, first(longer)).otherwise(F.least(other(x), F.when(x["kind"] == 1, first(shorter)))).alias("best"),
        ),
    )
    rows = met.select(F.explode(told).alias("t")).select("t.*").where("n > 0")
    return rows.groupBy("rank").agg(F.sum("n").cast("long").alias("n_near"), F.min("best").alias("best"))


def spelling_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root of each row of ``words`` (word, n; each word once).

    ``form`` is the near word of largest n, equal ones by code points, if it
    has at least ``ratio`` (2 or more) times the word's n, else null; ``root``
    is reached by following forms.  An empty table gives an empty one; words
    may be of any length.
    """
    ranked = checkpointed(words.select("word", "n").orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id()))
    largest = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = ranked.join(near_words(ranked), "rank", "left").join(largest, "best", "left").withColumn("held", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    grouped = checkpointed(
        near.select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("held"), F.col(c)).alias(c) for c in ("best", "form", "form_n")]
        )
    )
    # each form has ratio times the count, so chains are short and their followed length doubles
    most = grouped.agg(F.max("form_n")).first()[0]
    steps = grouped.where("best IS NOT NULL").select("rank", F.col("best").alias("to"))
    for _ in range(math.ceil(math.log2(1 + math.log(most, ratio))) if most else 0):
        onward = steps.select(F.col("rank").alias("to"), F.col("to").alias("further"))
        steps = checkpointed(steps.join(onward, "to", "left").select("rank", F.coalesce("further", "to").alias("to")))
    roots = steps.join(ranked.select(F.col("rank").alias("to"), F.col("word").alias("end")), "to").select("rank", "end")
    return grouped.join(roots, "rank", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("end", "word").alias("root"))
