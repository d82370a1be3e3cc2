"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(pairs: DataFrame, below_only: bool) -> DataFrame:
    """Point every node's neighbours at its smallest one.

    ``below_only`` takes neighbours below the node (small star, the node is
    pointed too); otherwise all neighbours count and those above are pointed.
    """
    if below_only:
        seen = pairs.select(F.col("a").alias("node"), F.col("b").alias("to"))
    else:
        seen = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("s")).select("s.*")
    least = seen.groupBy("node").agg(F.min("to").alias("least"))
    if below_only:
        moved = seen.join(least, "node").select(F.col("to").alias("a"), F.col("least").alias("b")).union(least.select("node", "least"))
    else:
        moved = seen.join(least, "node").where(F.col("to") > F.col("node")).select(F.col("to").alias("a"), F.least("node", "least").alias("b"))
    return moved.where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it reaches.

    Links are unordered and may repeat; a link of a node to itself or to null
    says nothing.  An empty table gives an empty one.  Each round is written
    to the checkpoint folder.  Rounds needed grow with the logarithm of the
    longest chain; one beyond ``most_rounds`` raises an error.
    """
    x, y = F.col(a), F.col(b)
    pairs = checkpointed(links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        pairs = checkpointed(_star(_star(pairs, below_only=False), below_only=True))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())
