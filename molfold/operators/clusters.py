"""Exact threshold search over clusters.

One minus Tanimoto is a metric.  Rows are dealt to the nearest of a few pivots
and every cluster keeps its radius; a query can only hit rows of a cluster
whose pivot is within the radius plus one minus the threshold.  Clusters are
read in blocks of bounded size, so one that holds most rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocked import HITS, QUERIES, ROWS, _above
from .scratch import written

#: More than rounding can cost in a distance.
SLACK = 1e-9


def distances(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One minus Tanimoto of every row and every pivot; word matrices."""
    common = np.bitwise_count(fp[:, None, :] & pivots[None, :, :]).sum(axis=2, dtype=np.int64)
    union = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)[:, None] + np.bitwise_count(pivots).sum(axis=1, dtype=np.int64)[None, :] - common
    return 1 - common / np.maximum(union, 1)


def _words(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


class ClusterIndex:
    """A fingerprint table dealt to pivots; built once, searched many times.

    Pivots are ``n_pivots`` rows picked by a hash, a bounded sample; every row
    is indexed and searches are exact whatever the pivots.
    """

    def __init__(self, db: DataFrame, n_pivots: int = 64):
        rows = db.where("popcnt > 0").select("id", "fp", "popcnt")
        picked = rows.orderBy(F.xxhash64("fp"), "id").limit(n_pivots).collect()
        self.pivots = np.array([r["fp"] for r in picked] or np.zeros((0, 1)), np.int64).view(np.uint64)
        fixed = db.sparkSession.sparkContext.broadcast(self.pivots)

        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                far = np.concatenate([distances(_words(batch.slice(k, 1024)), fixed.value) for k in range(0, len(batch), 1024)] or [np.zeros((0, 1))])
                at = far.argmin(axis=1)
                yield pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(far[np.arange(len(at)), at])], names=["cluster", "far"])

        deal = F.arrow_udf(nearest, "struct<cluster:int,far:double>").asNondeterministic()
        self.rows = written(rows.withColumn("at", deal("fp")).select("id", "fp", "popcnt", "at.*"), "clusters")
        # one row per pivot
        sizes = self.rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
        self.parts = np.zeros(len(picked), np.int64)
        self.radius = np.zeros(len(picked))
        for r in sizes:
            self.parts[r["cluster"]], self.radius[r["cluster"]] = -(-r["n"] // ROWS), r["radius"]

    def visited(self, threshold: float) -> Column:
        """Column function: a query's words to the clusters that can hold a hit."""
        pivots, parts, radius = self.pivots, self.parts, self.radius

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                far = distances(_words(batch), pivots) if len(batch) else np.zeros((0, len(pivots)))
                near = (far <= radius + 1 - threshold + SLACK) & (parts > 0)
                yield pa.array([np.flatnonzero(row).tolist() for row in near], pa.list_(pa.int32()))

        return F.arrow_udf(run, "array<int>").asNondeterministic()

    def search(self, queries: DataFrame, threshold: float) -> DataFrame:
        """(query_id, id, score) of every pair scoring at least ``threshold`` (> 0)."""
        if threshold <= 0:
            raise ValueError("the threshold must be above 0: at 0 every pair is a hit")
        if not len(self.pivots):
            return queries.where("false").select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"))
        parts = F.get(F.array(*[F.lit(int(max(1, p))) for p in self.parts]), F.col("cluster"))
        asked = queries.where("popcnt > 0").select("id", "fp", "popcnt")
        n = max(1, -(-asked.count() // QUERIES))
        packs = (
            asked.withColumn("cluster", F.explode(self.visited(threshold)("fp")))
            .groupBy("cluster", F.pmod(F.xxhash64("id"), F.lit(n)).alias("pack"))
            .agg(F.collect_list(F.struct("id", "fp", "popcnt")).alias("queries"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        )
        stored = (
            self.rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
            .groupBy("cluster", "part")
            .agg(F.collect_list(F.struct("id", "fp", "popcnt")).alias("rows"))
        )
        return packs.join(stored, ["cluster", "part"]).select("queries", "rows").mapInArrow(_above(threshold), HITS)
