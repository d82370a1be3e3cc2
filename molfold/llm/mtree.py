"""Exact top-k inner products over M-trees.

Vectors are dealt to the nearest of a bounded sample of routing objects; the
vectors of one routing object are cut into subtrees of bounded size, and each
subtree into pages: a routing object, a covering radius, the distance to the
routing object above, and the entries with their distances to the page's own.

For a query q and a routing object p of radius r, no entry x has an inner
product above ``<q, p> + |q| r``, as ``<q, x> = <q, p> + <q, x - p>``; and by
the triangle inequality a page below p at distance d reaches no more than
``<q, p> + |q| (d + r')``.  Pages are visited best bound first; the stored
distances rule out pages before their routing object is looked at, and
entries before their inner product is computed.  Bounds are floating point
with slack, scores are integers.

A query first searches the subtrees of the routing object of best bound; its
k-th score then rules out others, and the rest are searched.  Queries travel
in blocks to the subtrees they still need.  Equal vectors are one entry with
the k + 1 smallest ids, more can never be asked for, so copies of one vector
cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Stands for no id where an entry has fewer than k + 1.
FILLER = LOWEST
TREE = "cell int, part int, dim int, centre binary, radius binary, parent binary, first binary, vectors binary, distance binary, ids binary"


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False))), F.lit(False))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix, short rows filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(column), dim), np.int64)
    for row, part in zip(out, np.split(values, np.cumsum(sizes)[:-1]), strict=True):
        row[: len(part)] = part
    return out


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows.astype(float) - to.astype(float)) ** 2).sum(axis=-1))


def pages(rows: np.ndarray, page_rows: int) -> list[np.ndarray]:
    """Row numbers of each page: halves by the nearer of two far members, down to ``page_rows``."""
    out, todo = [], [np.arange(len(rows))]
    while todo:
        own = todo.pop()
        if len(own) <= page_rows:
            out.append(own)
            continue
        a = rows[own[np.argmax(distances(rows[own], rows[own[0]]))]]
        from_a = distances(rows[own], a)
        from_b = distances(rows[own], rows[own[np.argmax(from_a)]])
        near = from_a < from_b
        if near.all() or not near.any():
            near = np.arange(len(own)) < len(own) // 2
        todo += [own[near], own[~near]]
    return out


def build(rows: np.ndarray, ids: np.ndarray, above: np.ndarray, page_rows: int) -> dict:
    """One subtree: its pages one after the other, with their bounds."""
    parts = pages(rows, page_rows)
    centres, radii, parents, order, spans = [], [], [], [], []
    for own in parts:
        middle = rows[own].mean(axis=0)
        centre = rows[own[np.argmin(distances(rows[own], middle))]]
        span = distances(rows[own], centre)
        centres.append(centre)
        radii.append(span.max())
        parents.append(distances(centre, above))
        order.append(own)
        spans.append(span)
    order = np.concatenate(order)
    return {
        "centre": np.array(centres, np.int64).tobytes(),
        "radius": np.array(radii).tobytes(),
        "parent": np.array(parents).tobytes(),
        "first": np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64).tobytes(),
        "vectors": rows[order].tobytes(),
        "distance": np.concatenate(spans).tobytes(),
        "ids": ids[order].tobytes(),
    }


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows; by floating point where that is exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def search(tree: dict, above: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of up to k entries for each query, none below its ``least``."""
    dim = queries.shape[1]
    take = lambda name, kind: np.frombuffer(tree[name], kind)
    centre, radius, parent = take("centre", np.int64).reshape(-1, dim), take("radius", float), take("parent", float)
    first, vectors, distance = take("first", np.int64), take("vectors", np.int64).reshape(-1, dim), take("distance", float)
    ids = take("ids", np.int64).reshape(len(vectors), -1)
    norm = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    slack = lambda x: x + np.abs(x) * 1e-9 + 1e-6
    top_score = np.full((len(queries), k), LOWEST)
    top_id = np.full((len(queries), k), HIGHEST)
    floor = least.astype(float)
    # by the stored distances alone, then by the page's own routing object
    bound = slack((queries.astype(float) @ above.astype(float))[:, None] + norm[:, None] * (parent + radius)[None, :])
    at_centre = np.full(bound.shape, -np.inf)
    for page in range(len(centre)):
        asked = np.flatnonzero(bound[:, page] >= floor)
        at_centre[asked, page] = products(queries[asked], centre[page : page + 1])[:, 0]
    bound = np.minimum(bound, slack(at_centre + norm[:, None] * radius[None, :]))
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(queries))
    for turn in range(len(centre)):
        page_of = order[active, turn]
        going = bound[active, page_of] >= floor[active]
        active, page_of = active[going], page_of[going]
        if not len(active):
            break
        for page in np.unique(page_of):
            asked = active[page_of == page]
            span = slice(first[page], first[page + 1])
            reach = slack(at_centre[asked, page, None] + norm[asked, None] * distance[None, span])
            wanted = np.flatnonzero((reach >= floor[asked, None]).any(axis=0)) + first[page]
            if not len(wanted):
                continue
            scores = products(queries[asked], vectors[wanted])
            width = ids.shape[1]
            candidate = np.broadcast_to(ids[wanted].reshape(1, -1), (len(asked), len(wanted) * width))
            scores = np.repeat(scores, width, axis=1)
            # a filler and the query's own row take no part
            scores = np.where((candidate == FILLER) | (candidate == own[asked, None]), LOWEST, scores)
            all_score = np.concatenate([top_score[asked], scores], axis=1)
            all_id = np.concatenate([top_id[asked], candidate], axis=1)
            all_id = np.where(all_score == LOWEST, HIGHEST, all_id)
            best = np.lexsort((all_id, -1 - all_score), axis=1)[:, :k]
            top_score[asked] = np.take_along_axis(all_score, best, axis=1)
            top_id[asked] = np.take_along_axis(all_id, best, axis=1)
            kth = top_score[asked, -1]
            floor[asked] = np.maximum(floor[asked], np.where(kth == LOWEST, -np.inf, kth.astype(float)))
    found = (top_id != HIGHEST) & (top_score >= least[:, None])
    number, _ = np.nonzero(found)
    return number, top_id[found], top_score[found]



def top_products(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    query_every: int = 50,
    most_routing: int = 256,
    subtree_rows: int = 4096,
    page_rows: int = 64,
    block: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query.

    Queries are the rows whose id ``query_every`` divides, candidates all rows
    but the query's own; ties go to the smaller id.  Rows whose id or vector
    is null, or whose vector has a null or non-finite component, take no part;
    rows equal in id and vector count once.  Vectors shorter than the longest
    are filled up with zeros.  Routing objects are a sample of at most
    ``most_routing`` vectors; all rows are indexed and the result is exact.
    """
    spark = rows.sparkSession
    vector = F.col(vector_col)
    good = rows.where(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector).alias("v"))
    same = Window.partitionBy("v").orderBy("vec_id")
    entries = checkpointed(
        good.distinct()
        .withColumn("nth", F.row_number().over(same))
        .where(F.col("nth") <= k + 1)  # cut down before the shuffle
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    n, dim = entries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = int(min(most_routing, max(1, -(-n // (subtree_rows // 2)))))
    listed = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect()  # at most most_routing vectors
    routing = np.zeros((len(listed), dim), np.int64)
    for row, r in zip(routing, listed, strict=True):
        row[: len(r["v"])] = r["v"]
    fixed = spark.sparkContext.broadcast(routing)

    def assign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        routing = fixed.value.astype(float)
        for batch in batches:
            v = matrix(batch, dim).astype(float)
            squares = (v**2).sum(axis=1)[:, None] - 2 * v @ routing.T + (routing**2).sum(axis=1)[None, :]
            cell = squares.argmin(axis=1)
            yield pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(distances(v, routing[cell]))], names=["cell", "far"])

    nearest = F.arrow_udf(assign, "struct<cell:int,far:double>").asNondeterministic()
    dealt = checkpointed(entries.select("v", "ids", nearest("v").alias("n")).select("v", "ids", "n.*"))
    cells = {r["cell"]: (r["n"], r["far"]) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    parts = np.array([-(-cells.get(c, (0, 0))[0] // subtree_rows) for c in range(len(routing))])
    reach = np.array([cells.get(c, (0, 0.0))[1] for c in range(len(routing))])
    part_of = F.array(*[F.lit(int(max(1, p))) for p in parts])

    def grow(key: tuple, group: pa.Table) -> pa.Table:
        cell, part = (x.as_py() for x in key)
        v = matrix(group.column("v").combine_chunks(), dim)
        ids = np.full((len(v), k + 1), FILLER)
        for row, own in zip(ids, group.column("ids").to_pylist(), strict=True):
            row[: len(own)] = own
        made = build(v, ids, fixed.value[cell], page_rows)
        kinds = {"cell": pa.int32(), "part": pa.int32(), "dim": pa.int32()}
        return pa.table({name: pa.array([x], kinds.get(name, pa.binary())) for name, x in {"cell": cell, "part": part, "dim": dim, **made}.items()})

    trees = checkpointed(
        dealt.withColumn("part", F.pmod(F.xxhash64("v"), F.get(part_of, F.col("cell"))).cast("int")).groupBy("cell", "part").applyInArrow(grow, TREE)
    )
    asking = checkpointed(good.where(F.pmod("vec_id", F.lit(query_every)) == 0).distinct())
    blocks = max(1, -(-asking.count() // block))

    def visit(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        """The cells that a query has to see: the first alone, or all others within reach."""
        routing = fixed.value.astype(float)
        for vectors, least, home in batches:
            q = matrix(vectors, dim).astype(float)
            norm = np.sqrt((q**2).sum(axis=1))[:, None]
            bound = q @ routing.T + norm * reach[None, :]
            bound += np.abs(bound) * 1e-9 + 1e-6
            bound[:, parts == 0] = -np.inf
            best = bound.argmax(axis=1)
            out = []
            for b, at, first, low in zip(bound, best, home.to_pylist(), least.to_pylist(), strict=True):
                seen = [at] if first else [c for c in np.flatnonzero(b >= (FILLER if low is None else low)) if c != at and parts[c]]
                out.append([{"cell": int(c), "part": int(p)} for c in seen for p in range(parts[c])])
            yield pa.array(out, pa.list_(pa.struct([("cell", pa.int32()), ("part", pa.int32())])))

    seen = F.arrow_udf(visit, "array<struct<cell:int,part:int>>").asNondeterministic()
    columns = [c.split()[0] for c in TREE.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                tree = {c: batch.column(c)[r].as_py() for c in columns}
                asked = batch.column("asked")[r].as_py()
                q = np.zeros((len(asked), dim), np.int64)
                for row, a in zip(q, asked, strict=True):
                    row[: len(a["v"])] = a["v"]
                own = np.array([a["query_id"] for a in asked])
                least = np.array([FILLER if a["least"] is None else a["least"] for a in asked])
                number, found, score = search(tree, fixed.value[tree["cell"]], q, own, least, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[number]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(queries: DataFrame, home: bool) -> DataFrame:
        to = queries.select("query_id", "v", "least", F.explode(seen("v", "least", F.lit(home))).alias("to")).select("query_id", "v", "least", "to.*")
        gathered = (
            to.groupBy("cell", "part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
            .agg(F.collect_list(F.struct("query_id", "v", "least")).alias("asked"))
            .drop("block")
        )
        return trees.join(gathered, ["cell", "part"]).mapInArrow(look, "query_id long, vec_id long, score long")

    queries = asking.select(F.col("vec_id").alias("query_id"), "v")
    near = checkpointed(searched(queries.withColumn("least", F.lit(None).cast("long")), True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    least = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    far = searched(queries.join(least, "query_id", "left"), False)
    return (
        near.drop("rank").union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
