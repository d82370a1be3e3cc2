"""Many queries against many fingerprints, block against block.

Rows of like popcount are gathered into blocks of bounded size, on both sides.
A block of queries travels to the database blocks whose popcounts it can hit,
and one Arrow step scores the two as word matrices; only hits, or the k best
of each query, come out.  There are no rows for pairs that miss.

Popcount classes are cut from the histogram of popcounts, which has at most
one entry per bit of the fingerprint; a popcount of more rows than a block
takes is dealt to several.  One plan serves any number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

ROWS, QUERIES = 4096, 256
#: Pairs compared at a time; keeps one step in cache.
STEP_PAIRS = 1 << 17
HITS = "query_id bigint, id bigint, score double"


@dataclass(frozen=True)
class PopcountClass:
    number: int
    low: int
    high: int
    rows: int
    parts: int


def popcount_classes(df: DataFrame, rows: int) -> list[PopcountClass]:
    """Neighbouring popcounts together until they hold about ``rows`` rows."""
    found = sorted((r["popcnt"], r["count"]) for r in df.groupBy("popcnt").count().collect())
    out, low, held = [], None, 0
    for k, (popcnt, n) in enumerate(found):
        low = popcnt if low is None else low
        held += n
        if held >= rows or k == len(found) - 1:
            out.append(PopcountClass(len(out), low, popcnt, held, -(-held // rows)))
            low, held = None, 0
    return out


def blocks(df: DataFrame, classes: list[PopcountClass], columns: tuple[str, ...], name: str) -> DataFrame:
    """(cls, part, ``name``): the rows of each block as one list."""
    top = classes[-1].high + 1 if classes else 1
    of, parts = [0] * top, [1] * top
    for c in classes:
        for n in range(c.low, c.high + 1):
            of[n], parts[n] = c.number, c.parts
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("popcnt"))
    return (
        df.withColumns({"cls": at(of), "part": F.pmod(F.xxhash64("id"), at(parts)).cast("int")})
        .groupBy("cls", "part")
        .agg(F.collect_list(F.struct(*columns)).alias(name))
    )


def _side(value: pa.ListScalar) -> dict[str, np.ndarray]:
    rows = value.values
    words = rows.field("fp")
    out = {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type if f.name != "fp"}
    out["fp"] = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(rows), -1)
    return out


def _scores(q: dict, d: dict) -> Iterator[tuple[slice, np.ndarray]]:
    """(queries, scores of those against all rows of the block)."""
    rows = len(d["id"])
    step = max(1, STEP_PAIRS // max(1, rows))
    words, counts = np.ascontiguousarray(d["fp"].T), d["popcnt"].astype(np.float64)
    for k in range(0, len(q["id"]), step):
        part = slice(k, k + step)
        asked = q["fp"][part]
        common = np.zeros((len(asked), rows), np.uint32)
        for w, word in enumerate(words):
            common += np.bitwise_count(asked[:, w, None] & word)
        union = q["popcnt"][part, None] + counts
        union -= common
        yield part, np.divide(common, np.maximum(union, 1, out=union), out=union)


def _batch(query, ident, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ident, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "id", "score"])


def _above(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, d = _side(batch.column("queries")[row]), _side(batch.column("rows")[row])
                for part, score in _scores(q, d):
                    x, y = np.nonzero(score >= threshold)
                    yield _batch(q["id"][part][x], d["id"][y], score[x, y])

    return run


def _leading(score: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row that reach its floor; ties by column."""
    bar = floor.copy()
    many = np.flatnonzero((score >= bar[:, None]).sum(axis=1) > k)
    if len(many):
        # no score below the k-th can be one of the k best
        bar[many] = np.partition(score[many], -k, axis=1)[:, -k]
    x, y = np.nonzero(score >= bar[:, None])
    order = np.lexsort((y, -score[x, y], x))
    x, y = x[order], y[order]
    nth = np.arange(len(x)) - np.searchsorted(x, x)
    return x[nth < k], y[nth < k]


def _best(k: int):
    """The k best rows of a block for each query that can still reach its floor there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q, d = _side(batch.column("queries")[row]), _side(batch.column("rows")[row])
                low, high = d["popcnt"].min(), d["popcnt"].max()
                near = np.clip(q["popcnt"], low, high)
                reach = np.minimum(near, q["popcnt"]) / np.maximum(near, q["popcnt"])
                going = reach + 1e-9 >= q["floor"]
                q = {name: values[going] for name, values in q.items()}
                order = np.argsort(d["id"], kind="stable")
                d = {name: values[order] for name, values in d.items()}
                for part, score in _scores(q, d):
                    x, y = _leading(score, q["floor"][part], k)
                    yield _batch(q["id"][part][x], d["id"][y], score[x, y])

    return run


def _met(queries: DataFrame, database: DataFrame, visits: list[tuple], wanted: Column | None = None) -> DataFrame:
    """Rows of (queries, rows) for every pair of blocks listed in ``visits``."""
    spark = database.sparkSession
    places = sum({to: parts for _, to, parts, _, _ in visits}.values())
    # classes are at most as many as bits, whatever the number of rows
    listed = spark.createDataFrame(visits, "cls int, to int, parts int, low int, high int")
    to = queries.join(F.broadcast(listed), "cls")
    to = to if wanted is None else to.where(wanted)
    to = to.select("queries", F.col("to").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # few blocks of many pairs: by bytes alone they would be put together in few tasks
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * places)
    return to.repartition(n, "cls", "part").join(database.repartition(n, "cls", "part"), ["cls", "part"]).select("queries", "rows")


def threshold_pairs(db: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, id, score) of every pair scoring at least ``threshold`` (> 0)."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0: at 0 every pair is a hit")
    db, queries = (x.where("popcnt > 0").select("id", "fp", "popcnt") for x in (db, queries))
    mine, theirs = popcount_classes(queries, QUERIES), popcount_classes(db, ROWS)
    visits = [
        (q.number, d.number, d.parts, d.low, d.high) for q in mine for d in theirs if d.high + 1 >= q.low * threshold and d.low * threshold <= q.high + 1
    ]
    columns = ("id", "fp", "popcnt")
    met = _met(blocks(queries, mine, columns, "queries"), blocks(db, theirs, columns, "rows"), visits)
    return met.mapInArrow(_above(threshold), HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk_pairs(db: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best non-empty rows for each non-empty query.

    Each block of queries first sees the database blocks of nearest popcount
    that hold k rows.  The k-th score found there is the query's floor; of all
    other blocks only those are visited whose popcounts can reach it.
    """
    db, queries = (x.where("popcnt > 0").select("id", "fp", "popcnt") for x in (db, queries))
    queries = queries.withColumn("floor", F.lit(0.0))
    mine, theirs = popcount_classes(queries, QUERIES), popcount_classes(db, ROWS)
    near, far = [], []
    for q in mine:
        seen = 0
        apart = lambda d: max(d.low - q.high, q.low - d.high, 0)  # noqa: B023, E731
        for d in sorted(theirs, key=lambda d: (apart(d), d.number)):
            first = seen < k or apart(d) == 0
            (near if first else far).append((q.number, d.number, d.parts, d.low, d.high))
            seen += d.rows
    columns = ("id", "fp", "popcnt")
    database = written(blocks(db, theirs, columns, "rows"), "blocks")
    first = _ranked(_met(blocks(queries, mine, (*columns, "floor"), "queries"), database, near).mapInArrow(_best(k), HITS), k)
    first = written(first, "first-hits")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("found"))
    known = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("found", F.lit(0.0))).drop("found")
    again = blocks(known, mine, (*columns, "floor"), "queries")
    reach = F.exists("queries", lambda q: _reach(q["popcnt"]) + 1e-9 >= q["floor"])
    rest = _met(again, database, far, reach).mapInArrow(_best(k), HITS)
    return _ranked(first.drop("rank").union(rest), k)


def _reach(popcnt: Column) -> Column:
    """Best score of a query's popcount against popcounts from low to high."""
    near = F.greatest(F.least(popcnt, F.col("high")), F.col("low"))
    return F.least(near, popcnt) / F.greatest(near, popcnt)
