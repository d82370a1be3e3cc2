"""Clusters around leaders: every row within a threshold of one leader.

Sphere exclusion takes the row with most neighbours as a leader, removes it and
its neighbours, and goes on with the rest.  One row at a time that is a chain as
long as the table; here some thousand of the first undecided rows are decided in
one round.  A row can only be taken by a row before it, so the leaders are those
of the sequential order, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocked import _scores as matrix
from .chunked import score, side
from .scratch import written
from .search import counted_fingerprints, to_rows

#: Rows that are decided together, on the driver.
DECIDED = 4_096


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes that a walk over all nodes in order would keep, each
    one that follows no kept neighbour.

    ``edges`` has one row (a, b) per pair of neighbours, a before b in the
    order.  A round decides at least the first undecided node of every
    component; it joins what is left on node ids and writes the rest, so no
    lineage grows and a lost executor costs a part of one round.  Rounds are as
    many as the longest chain of nodes each decided by the one before.
    """
    kept = None
    nodes, edges = nodes.select("id"), edges.select("a", "b")
    while not nodes.isEmpty():
        follows = edges.select(F.col("b").alias("id")).distinct()
        leaders = written(nodes.join(follows, "id", "left_anti"), "leaders")
        kept = leaders if kept is None else kept.unionByName(leaders)
        taken = edges.join(leaders.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        nodes = written(nodes.join(leaders, "id", "left_anti").join(taken, "id", "left_anti"), "undecided")
        left = [nodes.withColumnRenamed("id", end) for end in ("a", "b")]
        edges = written(edges.join(left[0], "a", "left_semi").join(left[1], "b", "left_semi"), "edges")
    return nodes if kept is None else kept


def greedy_leaders(rows: dict[str, np.ndarray], threshold: float) -> np.ndarray:
    """Positions of the rows that follow no neighbour kept before them."""
    words, popcnt = rows["fp"], rows["popcnt"]
    taken, kept = np.zeros(len(words), bool), []
    for k in range(len(words)):
        if not taken[k]:
            kept.append(k)
            common = np.bitwise_count(words[k + 1 :] & words[k]).sum(axis=1, dtype=np.int64)
            taken[k + 1 :] |= score(common, popcnt[k + 1 :], popcnt[k]) >= threshold
    return np.array(kept, np.int64)


def _told(shared, threshold: float):
    """Each row with the place of the first leader that is its neighbour, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = shared.value
        for batch in batches:
            rows = side(batch)
            place = np.full(batch.num_rows, -1)
            for part, scores in matrix(rows, leaders):
                near = scores >= threshold
                place[part] = np.where(near.any(axis=1), near.argmax(axis=1), -1)
            named = leaders["id"][place]
            leader = pa.array(named, mask=(place < 0) | leaders["unnamed"][place])
            columns = {name: batch.column(name) for name in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"decided": pa.array(place >= 0), "leader": leader})

    return run


def sphere_exclusion(db: DataFrame, threshold: float) -> DataFrame:
    """(id, leader, neighbours) for every row of (id, fp, popcnt).

    Rows with more neighbours (other rows scoring at least ``threshold``, > 0)
    come first, equal ones by id; a row belongs to the first leader that is its
    neighbour, a leader to itself.  Copies of a fingerprint have one leader.
    Rows without any bit score zero against all and lead themselves.

    Neighbours may be a good part of all pairs, so none are stored.  Rows are
    decided from the first on, ``DECIDED`` at a time: the leaders among them
    are found by themselves, as those before have taken what they take, and
    then go to all tasks, where they take their neighbours.
    """
    context = db.sparkSession.sparkContext
    columns = ("number", "id", "copies", "fp", "popcnt", "neighbours")
    nodes = written(counted_fingerprints(db, threshold).select(*columns), "nodes")
    order = (F.desc("neighbours"), F.asc_nulls_last("id"), F.asc("number"))
    kinds = dict(nodes.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "decided boolean, leader bigint"])
    rest, done = nodes, []
    while not (first := rest.orderBy(*order).limit(DECIDED).toArrow()).num_rows == 0:
        rows = side(first)
        kept = greedy_leaders(rows, threshold)
        shared = context.broadcast({name: values[kept] for name, values in rows.items()})
        told = written(rest.mapInArrow(_told(shared, threshold), schema), "told")
        shared.destroy()
        done.append(told.where("decided").select("fp", "copies", "leader", "neighbours"))
        rest = told.where("NOT decided").select(*columns)
    if not done:
        done = [nodes.select("fp", "copies", F.col("id").alias("leader"), "neighbours")]
    per_fp = written(reduce(DataFrame.unionByName, done), "clusters")
    return to_rows(db, per_fp).select("id", F.coalesce("leader", "id").alias("leader"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))
