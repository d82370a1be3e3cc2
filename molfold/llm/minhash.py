"""Near-duplicate documents by SimHash and the Jaccard similarity of their word shingles.

Documents meet in two ways.  The SimHash fingerprint of the shingle set is
indexed by its deletion variants, as in :mod:`.simhash`, so sets of up to
``max_bits`` differing bits meet for certain.  At similarity 0.8 fingerprints
may differ by a seventh of the bits, whatever the width, and segments within
one bit of each other would have to be so short that everything meets.  So the
set is also hashed by ``bands * rows`` functions; the least value of each is
equal in two sets with the probability of their similarity.  ``rows`` least
values make a band, and documents that share a band meet: at similarity s with
probability ``1 - (1 - s ** rows) ** bands``, which is 0.9997 at 0.8 and more
above.

Documents of equal sets are folded first.  Whoever meets is compared on the
whole sets, so no pair below the threshold is linked; inside a meeting place
the links are a spanning forest, not all pairs.  A place of more than
``block`` shingles is dealt into blocks that meet pairwise, so that no task
holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, utf8
from .components import components
from .simhash import keep_first, majority, row_keys, shingle_hashes, variant_keys

#: Shingles times functions at a time; keeps the products in cache.
STRETCH = 1 << 10


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles, empty without words."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, width)]))


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of n hash functions, as columns."""
    rng = np.random.default_rng(42)
    drawn = rng.integers(0, 2**64, (2, n, 1), dtype=np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit key for each band; none for an empty set."""
    if not len(hashes):
        return []
    masks, factors = functions(bands * rows)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), STRETCH):
        np.minimum(least, ((hashes[k : k + STRETCH] ^ masks) * factors).min(axis=1), out=least)
    whole, size = least.tobytes(), 8 * rows
    keys = [xxhash.xxh64_intdigest(whole[b * size : (b + 1) * size], b) for b in range(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


SIGNED = "struct<same:binary,size:int,fp:long,keys:array<long>>"


def signed(text: Column, width: int, bands: int, rows: int) -> Column:
    """What equal sets share, the set's size, its fingerprint and its band keys."""
    kind = pa.struct([("same", pa.binary()), ("size", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def one(t: bytes) -> dict:
        hashes = shingle_set(t, width)
        return {"same": xxhash.xxh3_128_digest(hashes.tobytes()), "size": len(hashes), "fp": majority([hashes]), "keys": band_keys(hashes, bands, rows)}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([one(t.as_py()) for t in batch], kind)

    return F.arrow_udf(run, SIGNED).asNondeterministic()(utf8(text))


def meeting_keys(max_bits: int) -> Column:
    """Band keys and deletion variants of the fingerprint; none for an empty set."""
    return F.when(F.col("size") > 0, F.concat("keys", variant_keys(F.col("fp"), max_bits))).otherwise(F.col("keys"))


def set_bytes(text: Column, width: int) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch], pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()(utf8(text))


def spanning_links(sets: list[np.ndarray], sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect all sets within reach of each other, as a forest.

    With two sides only pairs of unlike sides are compared.
    """
    sizes = np.array([len(s) for s in sets])
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = np.split(numbers, ends[:-1])
    two = len(set(sides.tolist())) > 1
    mark = np.zeros(numbers.max(initial=-1) + 1, np.int64)
    rest, links = np.arange(len(sets)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            # sizes alone rule out most
            fits = np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at])
            if two:
                fits &= sides[rest] != sides[at]
            some = rest[fits]
            if not len(some):
                continue
            mark[own[at]] = 1
            begins = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            common = np.add.reduceat(mark[np.concatenate([own[i] for i in some])], begins)
            mark[own[at]] = 0
            near = some[common >= similarity * (sizes[some] + sizes[at] - common)]
            links += [(int(at), int(x)) for x in near]
            queue += list(near)
            rest = rest[~np.isin(rest, near)]
    return links


def near_links(prints: DataFrame, sets: DataFrame, similarity: float = 0.8, block: int = 1 << 20) -> DataFrame:
    """(a, b): links that connect all sets of ``prints`` (node, same, size, keys) that meet and are similar.

    ``node`` numbers the sets and stands for them in the index, which has a row
    for each set and key and is shuffled as numbers.  ``sets`` has the shingle
    set (same, hashes) of every row of ``prints`` that is asked for.
    """
    index = prints.select("node", "size", F.explode("keys").alias("key"))
    places = (
        index.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("least"))
        .where("n > 1")
        .groupBy("n", "members", "least", "shingles")  # the same sets meet at many places
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("shingles") / block).cast("int").alias("blocks"))
    )
    met = index.join(places, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = checkpointed(
        met.select(
            "key",
            "node",
            F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))).alias("pair"),
            "own",
        ).select("key", "pair.i", "pair.j", F.col("own").alias("side"), "node")
        .join(prints.select("node", "same"), "node")
        .select("key", "i", "j", "side", "same")
    )

    def linked(group: pa.Table) -> pa.Table:
        names = group.column("same").to_pylist()
        hashes = [np.frombuffer(b, "<u8") for b in group.column("hashes").to_pylist()]
        links = spanning_links(hashes, group.column("side").to_numpy(), similarity)
        return pa.table({"a": pa.array([names[x] for x, _ in links], pa.binary()), "b": pa.array([names[y] for _, y in links], pa.binary())})

    return met.join(sets(met.select("same").distinct()), "same").groupBy("key", "i", "j").applyInArrow(linked, "a binary, b binary")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 5, block: int = 1 << 20, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, nulls last.

    A group is what chains of pairs of at least this similarity connect; texts
    without words are one group.  All columns stay, whatever their names.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col))
    prints = checkpointed(keyed.select("doc_id", "__row__", "__row2__", signed(F.col("text"), width, bands, rows).alias("s")).select("doc_id", "__row__", "__row2__", "s.*"))
    folded = prints.groupBy("same").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(F.struct("__row__", "__row2__")).alias("r"))
    distinct = checkpointed(folded.withColumns({"keys": meeting_keys(max_bits), "node": F.monotonically_increasing_id()}))

    def sets(wanted: DataFrame) -> DataFrame:
        places = distinct.join(wanted, "same").select("same", "r.__row__", "r.__row2__")
        texts = keyed.join(places, ["__row__", "__row2__"]).groupBy("same").agg(F.first("text").alias("text"))
        return checkpointed(texts.select("same", set_bytes(F.col("text"), width).alias("hashes")))

    roots = components(checkpointed(near_links(distinct, sets, similarity, block))).withColumnRenamed("node", "same")
    members = prints.join(roots, "same", "left").withColumn("root", F.coalesce("root", "same"))
    return keep_first(docs, members, id_col, text_col)
