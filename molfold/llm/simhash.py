"""Near-duplicate documents by SimHash and deletion-variant signatures.

A fingerprint has one bit for each bit position of the hashed word shingles,
set where over half of the shingles have it.  Fingerprints of up to
``max_bits`` differing bits are linked.  They are cut into
``max_bits // 2 + 1`` segments, so that at least one segment of a linked pair
differs by at most one bit.  Every segment is indexed once for each of its
bits with that bit deleted; two segments share such a variant exactly if they
differ by at most that bit.  Equal variants meet by an equality shuffle and
are verified on the whole fingerprint.

Equal fingerprints are folded first, so a group of copies is one row of the
index however large it is.  A meeting place of two fingerprints is decided by
the aggregation itself.  Larger places are gathered and linked by a spanning
forest, never as all pairs; a place of more than ``gather`` fingerprints is
not gathered but cut finer, by deleting ``max_bits`` bits of the whole
fingerprint, where at most ``2 ** max_bits`` fingerprints can meet.  Both ways
are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, checkpointed, utf8
from .components import components

BITS = 64
SEED = 42
#: Shingles hashed at a time; bounds memory for very long texts.
CHUNK = 1 << 16


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, ``CHUNK`` at a time; nothing without words."""
    words = text.translate(LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    if len(words) >= width:
        cuts = list(zip(starts[: len(words) - width + 1], ends[width - 1 :], strict=True))
    else:
        cuts = [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(cuts), CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in cuts[k : k + CHUNK]], "<u8")


def simhash(text: bytes, width: int = 3) -> int:
    """Fingerprint of a text as a signed 64-bit number, 0 without words.

    ASCII capitals count as small letters; words are split at ASCII white
    space; a text of fewer than ``width`` words is one shingle.
    """
    return majority(shingle_hashes(text, width))


def majority(parts: Iterable[np.ndarray]) -> int:
    """Fingerprint of hashes that come in parts, 0 without any."""
    ones, count = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([simhash(t.as_py(), width) for t in batch], pa.int64())

    return F.arrow_udf(run, "long").asNondeterministic()(utf8(text))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = max(2, max_bits // 2 + 1)
    edges = [BITS * k // n for k in range(n + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


def variant_keys(fp: Column, max_bits: int) -> Column:
    """One key for each bit: the bit's number above its segment without that bit."""
    keys = []
    for low, width in segments(max_bits):
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        for j in range(width):
            keys.append(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j))).bitwiseOR(F.lit((low + j) << width)))
    return F.array(*keys)


def spanning_links(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect all members within reach of each other, as a forest."""
    rest, links = members, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= max_bits
            links += [(int(at), int(x)) for x in rest[near]]
            queue += list(rest[near])
            rest = rest[~near]
    return links


def _forest(max_bits: int) -> Column:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = (spanning_links(m.values.to_numpy(zero_copy_only=False), max_bits) for m in batch)
            yield pa.array([[{"a": a, "b": b} for a, b in links] for links in found], kind)

    return F.arrow_udf(run, "array<struct<a:long,b:long>>").asNondeterministic()


def near_links(prints: DataFrame, max_bits: int = 2, gather: int = 4096) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``max_bits`` of each other."""
    index = prints.select("fp", F.explode(variant_keys(F.col("fp"), max_bits)).alias("key"))
    places = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    places = checkpointed(places)
    twos = places.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    met = checkpointed(index.join(places.where("n > 2").select("key", "n"), "key"))
    gathered = (
        met.where(F.col("n") <= gather)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("fp")).alias("members"))
        .select("members")
        .distinct()  # the same few fingerprints meet at many places
        .select(F.explode(_forest(max_bits)("members")).alias("link"))
        .select("link.a", "link.b")
    )
    rests = [((1 << BITS) - 1) ^ sum(1 << j for j in bits) for bits in combinations(range(BITS), max(1, max_bits))]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in rests]
    fine = (
        met.where(F.col("n") > gather)
        .select("fp")
        .distinct()
        .select("fp", F.posexplode(F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: F.col("fp").bitwiseAND(m))).alias("mask", "rest"))
        .groupBy("mask", "rest")
        .agg(F.collect_set("fp").alias("few"))  # 2 ** max_bits at most
        .where(F.size("few") > 1)
        .select(F.array_min("few").alias("a"), F.explode("few").alias("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, max_bits))
    )
    return twos.union(gathered).union(fine)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, gather: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(prints, groups): doc_id, fp of each document; and fp, root, component_id of each fingerprint.

    ``root`` is the same for all fingerprints that chains of links connect,
    ``component_id`` the smallest id among their documents.
    """
    prints = checkpointed(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fp")))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(distinct, max_bits, gather))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, grouped.join(firsts, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Texts without words, null ones included, have fingerprint zero and are
    linked like any other.  Repeated rows stay repeated; a null id never is
    the smallest of its group unless the group has no other.
    """
    prints, groups = duplicate_groups(docs, **options)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes that tell a row from all others but its copies."""
    return F.xxhash64(id_col, text_col).alias("__row__"), F.xxhash64(text_col, id_col).alias("__row2__")


def keep_first(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row for each root of ``members`` (doc_id, __row__, __row2__, root)."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row__", "__row2__")).alias("first")
    best = members.groupBy("root").agg(first).select("first.__row__", "first.__row2__")
    same = Window.partitionBy("__row__", "__row2__").orderBy(F.lit(0))
    keys = row_keys(id_col, text_col)
    return (
        docs.withColumns({"__row__": keys[0], "__row2__": keys[1]})
        .join(best, ["__row__", "__row2__"])
        .withColumn("__nth__", F.row_number().over(same))
        .where("__nth__ = 1")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, nulls last.

    Of several rows with that id one is kept, the same whenever it runs unless
    they are equal.  All columns stay, whatever their names.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col))
    prints = checkpointed(keyed.select("doc_id", "__row__", "__row2__", fingerprint(F.col("text"), options.pop("width", 3)).alias("fp")))
    distinct = checkpointed(prints.select("fp").distinct())
    roots = components(near_links(distinct, **options)).withColumnRenamed("node", "fp")
    return keep_first(docs, prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), id_col, text_col)
