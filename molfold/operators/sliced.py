"""Fingerprints stored bit by bit.

A row of the stored table is a block of fingerprints of like popcount: their
ids and popcounts as lists, and for each bit position one binary column that
tells which of them have the bit.  A query reads the columns of its own bits
only, of the blocks whose popcounts can hold a hit.  Common bits are counted
for all rows of a block at once, by adding its slices into binary counters
with carries, 64 rows in a machine word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import band

#: Fingerprints in a block.
BLOCK = 1 << 14


def write_sliced(db: DataFrame, path: str, n_bits: int = 2048, block: int = BLOCK, n_files: int | None = None) -> None:
    """Store (id, fp, popcnt) by bits, in ranges of (popcnt, id); rows without a fingerprint are left out."""
    n = n_files or int(db.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = db.where("fp IS NOT NULL").select("id", "fp", F.col("popcnt").cast("int").alias("popcnt"))
    ordered = rows.repartitionByRange(n, "popcnt", "id").sortWithinPartitions("popcnt", "id")
    kind = T.StructType([T.StructField("least", T.IntegerType()), T.StructField("most", T.IntegerType()), T.StructField("ids", T.ArrayType(db.schema["id"].dataType)), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    for b in range(n_bits):
        kind.add(_slice(b), T.BinaryType())

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - sum(x.num_rows for x in held))
                held.append(part)
                batch = batch.slice(part.num_rows)
                if sum(x.num_rows for x in held) == block:
                    yield _block(held, n_bits)
                    held = []
        if held:
            yield _block(held, n_bits)

    ordered.mapInArrow(cut, kind).write.mode("overwrite").parquet(path)


def _slice(bit: int) -> str:
    return f"bit_{bit}"


def _block(parts: list[pa.RecordBatch], n_bits: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    ids, counts = rows["id"].combine_chunks(), rows["popcnt"].combine_chunks()
    words = rows["fp"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if len(words) * 64 != len(rows) * n_bits:
        raise ValueError(f"fingerprints are not all of {n_bits} bits")
    bits = np.unpackbits(np.ascontiguousarray(words, "<i8").view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    slices = np.packbits(bits.T, axis=1, bitorder="little")
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    columns = [pa.array([counts[0].as_py()], pa.int32()), pa.array([counts[-1].as_py()], pa.int32()), whole(ids), whole(counts)]
    columns += [pa.array([s.tobytes()], pa.binary()) for s in slices]
    return pa.RecordBatch.from_arrays(columns, names=["least", "most", "ids", "counts", *map(_slice, range(n_bits))])


def common_counts(slices: Iterable[bytes], n: int) -> np.ndarray:
    """How many of the slices have each of n rows."""
    planes: list[np.ndarray] = []
    width = -(-n // 64) * 8
    for s in slices:
        carry = np.frombuffer(s.ljust(width, b"\0"), np.uint64)
        for k, plane in enumerate(planes):
            planes[k], carry = plane ^ carry, plane & carry
        if carry.any():
            planes.append(carry)
    out = np.zeros(n, np.int64)
    for k, plane in enumerate(planes):
        out += np.unpackbits(plane.view(np.uint8), bitorder="little")[:n].astype(np.int64) << k
    return out


def _on_bits(words: Sequence[int]) -> list[int]:
    return [64 * k + b for k, w in enumerate(words) for b in range(64) if w >> b & 1]


def _scored(spark: SparkSession, path: str, words: Sequence[int], low: int, high: int, keep: Callable[[pa.Array, np.ndarray], np.ndarray]) -> DataFrame:
    """id, score of the rows that ``keep`` names in each block of popcounts from low to high."""
    bits = _on_bits(words)
    stored = spark.read.parquet(path)
    kind = T.StructType([T.StructField("id", stored.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    names = [_slice(b) for b in bits]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                counts = batch.column("counts")[i].values.to_numpy()
                common = common_counts((batch.column(n)[i].as_py() for n in names), len(ids))
                scores = common / np.maximum(len(names) + counts - common, 1)
                at = keep(ids, np.where((counts >= low) & (counts <= high), scores, -1.0))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(scores[at])], names=["id", "score"])

    return stored.where((F.col("most") >= low) & (F.col("least") <= high)).select("ids", "counts", *names).mapInArrow(score, kind)


def threshold_sliced(spark: SparkSession, path: str, words: Sequence[int], threshold: float) -> DataFrame:
    """id, score: all rows scoring at least ``threshold`` (> 0), best first."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    low, high = band(len(_on_bits(words)), threshold)
    return _scored(spark, path, words, max(low, 1), high, lambda ids, scores: np.flatnonzero(scores >= threshold)).orderBy(F.desc("score"), "id")


def topk_sliced(spark: SparkSession, path: str, words: Sequence[int], k: int) -> DataFrame:
    """id, score: the k best rows, equal scores by id; empty fingerprints are never returned."""

    def best(ids: pa.Array, scores: np.ndarray) -> np.ndarray:
        order = np.argsort(-scores, kind="stable")
        order = order[: np.count_nonzero(scores >= 0)]
        if len(order) <= k:
            return order
        # all that tie with the k-th stay; the order over blocks decides among them
        return order[: np.searchsorted(-scores[order], -scores[order[k - 1]], side="right")] if k > 0 else order[:0]

    high = 64 * len(words) if any(words) else 0
    return _scored(spark, path, words, 1, high, best).orderBy(F.desc("score"), "id").limit(max(k, 0))
