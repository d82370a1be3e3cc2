"""Variable-capacity best-fit packing of documents into training sequences.

Documents become pieces no longer than the longest permitted sequence.  The
histogram of piece lengths, one number per length whatever the corpus, is
packed longest first: pieces of a length go to the open bins with the least
room that still fits, and where none fits new bins are opened.  Their size is
the permitted one of least cost per token: its own tokens and a fixed cost for
the sequence, against the tokens put in now and those the shorter pieces still
to come can add.  At the end every bin shrinks to the smallest permitted
length that holds its contents.

Bins of equal content are handled as ranges, so the plan has a few entries per
length.  Pieces find their place by their rank among the pieces of their
length.  Ranks are counted in groups of bounded size, so a length that a third
of all documents share is many groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

CAPACITIES = (2048, 4096, 8192)


@dataclass
class Plan:
    """Runs of equal placements, and ranges of bins of equal content."""

    #: (length, first rank, pieces, pieces per bin, first bin, offset in the bin)
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    #: (first bin, bins, opened size, used)
    bins: list[tuple[int, int, int, int]] = field(default_factory=list)


def plan_bins(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 64) -> Plan:
    """Best-fit decreasing over a histogram {length: pieces}; lengths from 1 to the largest capacity."""
    capacities, plan, opened = sorted(capacities), Plan(), 0
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left: (first bin, bins, size)
    held = 0  # bit r is set where room has an entry for r
    largest = capacities[-1]
    # tokens in pieces up to each length that are still to come
    mass = np.zeros(largest + 2, np.int64)
    for length, n in counts.items():
        mass[length] = length * n
    mass = np.cumsum(mass).tolist()

    def keep(left: int, first: int, n: int, size: int) -> None:
        nonlocal held
        room.setdefault(left, []).append((first, n, size))
        held |= 1 << left

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        shorter = mass[length - 1]
        while todo:
            fits = held >> length
            if fits:
                left = length + (fits & -fits).bit_length() - 1
                first, n, size = room[left].pop()
                if not room[left]:
                    held &= ~(1 << left)
                each = min(left // length, todo)  # a bin just filled still has the least room
                used = min(n, todo // each)
                if used < n:
                    keep(left, first + used, n - used, size)
            else:

                def cost(size: int) -> float:
                    now = min(size // length, todo) * length
                    spare = size - now
                    return (overhead + size) / (now + min(spare, mass[min(spare, length - 1)]))

                size = min((c for c in capacities if c >= length), key=cost)
                left, first = size, opened
                each = min(size // length, todo)
                used = todo // each
                spare = size - each * length
                if spare and used > 1:  # weigh again once the shorter pieces may be used up
                    used = min(used, max(1, shorter // spare))
                    shorter = max(0, shorter - used * spare)
                opened += used
            plan.runs.append((length, rank, used * each, each, first, size - left))
            keep(left - each * length, first, used, size)
            rank += used * each
            todo -= used * each
    plan.bins = sorted((first, n, size, size - left) for left, ranges in room.items() for first, n, size in ranges)
    return plan


def downsized(used: int, capacities: tuple[int, ...] = CAPACITIES) -> int:
    return min(c for c in capacities if c >= used)


def pieces_of(docs: DataFrame, id_col: str, text_col: str, longest: int, size: Column | None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, row): every document cut at multiples of ``longest``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = (F.octet_length(text) + 1 if size is None else size).cast("long")
    measured = docs.select(F.col(id_col).alias("doc_id"), tokens.alias("size"), F.xxhash64(id_col, text_col).alias("row"))
    last = F.floor((F.col("size") - 1) / longest).cast("int")
    return (
        measured.where("size > 0")
        .select("doc_id", "row", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .withColumn("start", F.col("piece").cast("long") * longest)
        .select("doc_id", "piece", "start", F.least(F.lit(longest), F.col("size") - F.col("start")).cast("int").alias("n_tokens"), "row")
    )


def ranked(pieces: DataFrame, counts: dict[int, int], group_rows: int) -> DataFrame:
    """``pieces`` with ``rank``, from 0 without gaps within each length."""
    spark = pieces.sparkSession
    # one row per length, so its size is bounded by the longest sequence
    groups = F.broadcast(spark.createDataFrame([(n, -(-c // group_rows)) for n, c in sorted(counts.items())], "n_tokens int, groups long"))
    dealt = pieces.join(groups, "n_tokens").withColumn("group", F.pmod(F.xxhash64("row", "piece"), "groups")).drop("groups")
    sizes = dealt.groupBy("n_tokens", "group").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("n_tokens", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("n_tokens", "group").orderBy("doc_id", "piece", "row")
    return (
        dealt.withColumn("nth", F.row_number().over(inside))
        .join(firsts, ["n_tokens", "group"])
        .withColumn("rank", F.col("first") + F.col("nth") - 1)
        .drop("first", "nth", "group")
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = 64,
    size: Column | None = None,
    group_rows: int = 1000,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_capacity.

    ``size`` counts a document's tokens; by default a token is a byte of UTF-8
    and every document ends with one more, so null and empty texts are one
    piece of one token.  Documents of null or no size have no piece.  Bins are
    numbered from 0 without gaps, their pieces follow each other without gaps,
    and ``bin_capacity`` is the smallest permitted length that holds them.
    Repeated rows are packed once each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = checkpointed(pieces_of(docs, id_col, text_col, max(capacities), size))
    counts = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most the longest length
    plan = plan_bins(counts, capacities, overhead)
    runs = np.array(plan.runs, np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    bins = np.array([(first, downsized(used, capacities)) for first, _, _, used in plan.bins], np.int64).reshape(-1, 2)
    fixed = spark.sparkContext.broadcast((runs, bins))  # grows with the lengths, not with the documents
    kind = pa.struct([("bin_id", pa.int64()), ("bin_offset", pa.int32()), ("bin_capacity", pa.int32())])

    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        runs, bins = fixed.value
        keys = (runs[:, 0] << 46) + runs[:, 1]
        for lengths, ranks in batches:
            length, rank = lengths.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False)
            run = runs[np.searchsorted(keys, (length << 46) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            bin_id = run[:, 4] + nth // run[:, 3]
            offset = run[:, 5] + nth % run[:, 3] * length
            capacity = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1, 1]
            yield pa.StructArray.from_arrays([pa.array(bin_id), pa.array(offset.astype(np.int32)), pa.array(capacity.astype(np.int32))], fields=list(kind))

    at = F.arrow_udf(place, "struct<bin_id:long,bin_offset:int,bin_capacity:int>").asNondeterministic()
    placed = ranked(pieces, counts, group_rows).withColumn("at", at("n_tokens", "rank"))
    return placed.select("doc_id", "piece", "start", "n_tokens", "at.*")
