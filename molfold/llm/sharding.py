"""Uniform shuffle into shards of exact sizes.

A uniform random order cut into cells of fixed sizes sends a random number of
rows from each source partition to each cell; that table of counts, the
communication matrix, follows a multivariate hypergeometric law.  The
operator draws the matrix, lets every partition permute its own rows and cut
them by its row of the matrix, exchanges once, and permutes again inside each
cell.  The result is a uniform permutation with exact shard sizes.

The matrix is never built in one place.  Partitions form a binary tree; at
each node the rows of every cell are split between the two halves by one
draw, seeded by the node.  A task walks from the root to its own leaf and so
finds its row of the matrix, whatever the other tasks do, and a task that is
run again finds the same row.  A shard is cut into cells of bounded size, so
that no task gets a whole shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: numpy's hypergeometric draws end here.
SMALL = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows without replacement are good; any size.

    Beyond numpy's range the law is inverted outwards from its mode, which
    takes about as many steps as its standard deviation.
    """
    if good + bad < SMALL:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left, up, down, up_p, down_p = rng.random() - at_mode, mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            up_p *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= up_p
            if left <= 0:
                return up
        if down > low:
            down_p *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= down_p
            if left <= 0:
                return down
    return mode


def split_cells(rng: np.random.Generator, cells: np.ndarray, left: int) -> np.ndarray:
    """Of each cell's rows, how many come from the left half, which has ``left`` rows."""
    total = int(cells.sum())
    if total < SMALL:
        return rng.multivariate_hypergeometric(cells, left, method="marginals")
    out = np.zeros_like(cells)
    for k, cell in enumerate(cells):
        out[k] = hypergeometric(rng, int(cell), total - int(cell), left)
        total -= int(cell)
        left -= int(out[k])
    return out


def matrix_row(ends: np.ndarray, cells: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the matrix; ``ends`` are running totals of the partitions' rows, from 0."""
    low, high = 0, len(ends) - 1
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        first = split_cells(rng, cells, int(ends[middle] - ends[low]))
        low, high, cells = (low, middle, first) if part < middle else (middle, high, cells - first)
    return cells


def cell_sizes(rows: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, shard, first slot) of each cell; shard sizes are at most one apart."""
    size, shard, first = [], [], []
    for s in range(shards):
        own = rows // shards + (s < rows % shards)
        n = max(1, -(-own // cell_rows))
        each = [own // n + (k < own % n) for k in range(n)]
        size += each
        shard += [s] * n
        first += np.concatenate([[0], np.cumsum(each)[:-1]]).tolist()
    return np.array(size, np.int64), np.array(shard, np.int32), np.array(first, np.int64)


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, cell_rows: int = 200_000) -> DataFrame:
    """All columns of ``df`` plus ``shard`` (int, from 0) and ``slot`` (long).

    Every order of the rows is equally likely for a random ``seed``; shard
    sizes are at most one apart and the slots of a shard run from 0 without
    gaps.  Rows count one by one, so equal and null rows need no care; an
    empty table gives an empty result.  Columns already called ``shard`` or
    ``slot`` are replaced.  ``df`` is written once to the checkpoint folder,
    which fixes the rows of each partition for this and any repeated task.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    source = checkpointed(df.select(*kept).withColumn("__part__", F.spark_partition_id()))
    found = source.groupBy("__part__").count().collect()  # one number per partition
    if not found:
        return source.drop("__part__").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    counts = np.zeros(max(r["__part__"] for r in found) + 1, np.int64)
    for r in found:
        counts[r["__part__"]] = r["count"]
    ends = np.concatenate([[0], np.cumsum(counts)])
    size, shard, first = cell_sizes(int(ends[-1]), shards, cell_rows)
    fixed = df.sparkSession.sparkContext.broadcast((ends, size, shard, first))
    names = ["__shard__", "__cell__", "__first__", "__key__", "__row__"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, size, shard, first = fixed.value
        part, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column("__part__")[0].as_py()
                rng = np.random.default_rng([seed, part])
                to = np.repeat(np.arange(len(size), dtype=np.int32), matrix_row(ends, size, part, seed))
                rng.shuffle(to)  # the permutation of this partition's rows
            cell = to[done : done + batch.num_rows]
            if len(cell) < batch.num_rows or batch.column("__part__")[-1].as_py() != part:
                raise RuntimeError(f"partition {part} changed while it was dealt out, in {TaskContext.get()}")
            key = rng.integers(-(2**63), 2**63 - 1, batch.num_rows, dtype=np.int64)
            row = np.arange(done, done + batch.num_rows, dtype=np.int64)
            done += batch.num_rows
            more = [pa.array(x, k) for x, k in zip((shard[cell], cell, first[cell], key, row), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields] + ["__shard__ int", "__cell__ int", "__first__ long", "__key__ long", "__row__ long"])
    inside = Window.partitionBy("__cell__").orderBy("__key__", "__part__", "__row__")
    return (
        source.mapInArrow(deal, schema)
        .withColumn("slot", F.col("__first__") + F.row_number().over(inside) - 1)
        .select(*[F.col(f"`{c}`") for c in kept], F.col("__shard__").alias("shard"), "slot")
    )


def sharded_documents(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law ``rows``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has no bytes, so
    its size is 1 and its checksum that of no bytes, 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(narrow, shards, seed, **options).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
