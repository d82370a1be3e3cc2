"""Binary fingerprint files, for exchange with programs that read that layout.

Inside Spark use Parquet (:mod:`molfold.operators.search`).  A table is stored
as a folder of shards, each a complete file written and read by one task.  The
folder must be on storage shared by all executors and may be a plain path or a
URI.  Shards are written under a temporary name and moved, so a retried task
replaces its own output only.
"""

from __future__ import annotations

import os
import struct
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File layout (little-endian).
MAGIC = 0x43464442
VERSION = 1
HEADER = "<IIIIQ"  # magic, version, words per row, reserved, rows
MAX_ID_BYTES = 65535

ROWS_PER_SHARD = 500_000


def encode(fps: np.ndarray, counts: np.ndarray, ids: list[str]) -> bytes:
    """One shard: header, words, popcounts, then length-prefixed ids."""
    n, words = fps.shape
    coded = [s.encode() for s in ids]
    for name in coded:
        if len(name) > MAX_ID_BYTES:
            raise ValueError(f"id of {len(name)} bytes is longer than the {MAX_ID_BYTES} a file can hold: {name[:60].decode(errors='ignore')}...")
    names = b"".join(struct.pack("<H", len(b)) + b for b in coded)
    head = struct.pack(HEADER, MAGIC, VERSION, words, 0, n)
    return head + fps.astype("<i8").tobytes() + counts.astype("<i4").tobytes() + names


def decode(data: bytes, words: int):
    """(fps, counts, ids) of one shard; raises ValueError on a bad file."""
    size = struct.calcsize(HEADER)
    if len(data) < size:
        raise ValueError("truncated header")
    magic, version, n_words, _, n = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("bad magic")
    if version != VERSION:
        raise ValueError("unsupported version")
    if n_words != words:
        raise ValueError("fingerprint size mismatch")
    at = size + n * words * 8
    end = at + n * 4
    if len(data) < end:
        raise ValueError("read failed")
    fps = np.frombuffer(data, "<i8", n * words, size).reshape(n, words)
    counts = np.frombuffer(data, "<i4", n, at)
    ids = []
    for _ in range(n):
        if len(data) < end + 2:
            raise ValueError("read failed")
        (length,) = struct.unpack_from("<H", data, end)
        end += 2 + length
        if len(data) < end:
            raise ValueError("read failed")
        ids.append(data[end - length:end].decode())
    return fps, counts, ids


def storage(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path in it, for a URI or a plain path."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return arrow_fs.LocalFileSystem(), os.path.abspath(parts.path)
    return arrow_fs.FileSystem.from_uri(path)


def write_shards(df: DataFrame, path: str, words: int = 32, rows_per_shard: int = ROWS_PER_SHARD) -> int:
    """Write (id, fp, popcnt) rows; returns the number of rows written."""
    def write(batches):
        # one shard per rows_per_shard rows, so a task never holds more
        files, folder = storage(path)
        files.create_dir(folder, recursive=True)
        held, n_held, part = [], 0, 0
        total = 0

        def flush():
            nonlocal held, n_held, part
            t = pa.Table.from_batches(held)
            fps = t["fp"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, words)
            data = encode(fps, t["popcnt"].to_numpy(), t["id"].to_pylist())
            from pyspark import TaskContext

            name = f"part-{TaskContext.get().partitionId():05d}-{part:05d}.fpdb"
            made = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(made) as f:
                f.write(data)
            files.move(made, f"{folder}/{name}")
            part += 1
            held, n_held = [], 0

        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, rows_per_shard - n_held)
                held.append(b.slice(0, take))
                b = b.slice(take)
                n_held += take
                total += take
                if n_held == rows_per_shard:
                    flush()
        if n_held:
            flush()
        yield pa.RecordBatch.from_pydict({"n": [total]})

    rows = df.select(F.col("id").cast("string").alias("id"), "fp", F.col("popcnt").cast("int").alias("popcnt"))
    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_shards(spark: SparkSession, path: str, words: int = 32) -> DataFrame:
    """(id, fp, popcnt) of a folder of shards; one task reads one or more."""

    def load(batches):
        for b in batches:
            for data in b.column("content"):
                fps, counts, ids = decode(data.as_py(), words)
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(fps.ravel())), pa.array(counts)],
                    names=["id", "fp", "popcnt"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fpdb").load(path).select("content")
    return files.mapInArrow(load, "id string, fp array<bigint>, popcnt int")
