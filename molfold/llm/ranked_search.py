"""Ranked lexical search by the Best Position Algorithm.

One pass over the texts writes the postings of all terms that any query has;
document counts and lengths come from the same table.  Postings are then dealt
into shards of documents by a hash of the row, and queries into blocks.  For
each shard and block one task holds an impact list per term, largest impact
first, and answers each query of the block:

* the query's lists are read side by side, some positions at a time;
* a document that turns up is looked up in all lists at once (direct access),
  which gives its score and its position in each list;
* the best position of a list is the end of its unbroken stretch of seen
  positions, however they were seen.  What no list has shown up to there
  scores at most the sum of the impacts at the best positions;
* reading stops once that sum is strictly below the k-th score, so that equal
  scores are told apart by document.

The k best of every shard are ranked per query in the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, utf8, words_of

#: Documents of a shard and queries of a block.
SHARD, BLOCK = 4096, 256
#: Positions read from each list at first; the step doubles.
STEP = 8


def term_counts(text: Column) -> Column:
    """array<struct<term, tf>> of a text; the term "" stands for all terms together."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            terms, counts, ends = [], [], [0]
            for value in batch:
                words = words_of(value.as_py())
                if words:
                    found = Counter(words)
                    terms += [b"", *found]
                    counts += [len(words), *found.values()]
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], fields=list(kind.value_type))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, type=kind)

    return F.arrow_udf(run, "array<struct<term:string,tf:long>>").asNondeterministic()(utf8(text))


class Shard:
    """Impact lists of some documents."""

    def __init__(self, rows: np.ndarray, order: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        """One posting at each index: row, the row's place among equal scores, term and impact."""
        self.terms, term = np.unique(terms, return_inverse=True)
        by_list = np.lexsort((order, -impacts, term))
        self.starts = np.searchsorted(term[by_list], np.arange(len(self.terms) + 1))
        ranks, doc = np.unique(order, return_inverse=True)
        self.impacts, self.docs = impacts[by_list], doc[by_list]
        self.rows = np.empty(len(ranks), rows.dtype)
        self.rows[doc] = rows
        # by document: the places of its postings in the lists
        self.by_doc = np.argsort(self.docs, kind="stable")
        self.doc_starts = np.searchsorted(self.docs[self.by_doc], np.arange(len(ranks) + 1))
        self.term_at = term[by_list]

    def _postings(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: the places of all postings of some documents, and how many each has."""
        lengths = self.doc_starts[docs + 1] - self.doc_starts[docs]
        offsets = np.repeat(self.doc_starts[docs] - np.cumsum(lengths) + lengths, lengths)
        return self.by_doc[offsets + np.arange(len(offsets))], lengths

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, positions read): the k best of a query, equal ones by their order."""
        at = np.searchsorted(self.terms, terms)
        held = at < len(self.terms)
        held[held] = self.terms[at[held]] == terms[held]
        at, weights = at[held], weights[held]
        weight = np.zeros(len(self.terms), np.int64)
        weight[at] = weights
        low, high = self.starts[at], self.starts[at + 1]
        position = low.copy()  # the first place of each list not known to be seen
        seen = np.zeros(len(self.docs) + 1, bool)
        met = np.zeros(len(self.rows), bool)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        done, step = 0, STEP
        while len(at):
            places = (low[:, None] + np.arange(done, done + step))[np.arange(done, done + step) < (high - low)[:, None]]
            new = np.unique(self.docs[places])
            new = new[~met[new]]
            met[new] = True
            if len(new):
                postings, lengths = self._postings(new)
                seen[postings] = True
                gains = self.impacts[postings] * weight[self.term_at[postings]]
                docs = np.concatenate([docs, new])
                scores = np.concatenate([scores, np.add.reduceat(gains, np.cumsum(lengths) - lengths)])
                if len(docs) > k:
                    keep = np.lexsort((docs, -scores))[:k]
                    docs, scores = docs[keep], scores[keep]
            done, step = done + step, 2 * step
            for i in np.flatnonzero(position < high):
                ahead = seen[position[i] : high[i]]
                gap = int(ahead.argmin())
                position[i] = position[i] + gap if not ahead[gap] else high[i]
            # the impact at the best position, the last one seen; none beyond a list
            ends = np.where(position < high, self.impacts[np.maximum(position - 1, 0)], 0)
            bound = int((ends * weights).sum())
            if (position >= high).all() or (len(docs) >= k and scores.min() > bound):
                break
        keep = np.lexsort((docs, -scores))[:k]
        keep = keep[scores[keep] > 0]
        return self.rows[docs[keep]], scores[keep], done


def _ordered(ids: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The order of rows by id, null ids last, equal ids by row."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    filled = ids.fill_null(0).to_numpy()
    firsts, inverse = np.unique(rows, return_index=True, return_inverse=True)[1:]
    order = np.lexsort((rows[firsts], filled[firsts], missing[firsts]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[inverse]


def ranked_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query, scores above 0 only.

    Scores are whole numbers: terms weigh the thousandfold logarithm of their
    rarity, occurrences count with saturation and against the document's
    length.  Equal scores are ranked by id (a whole number), null ids last.
    Repeated rows are documents or queries of their own; null and empty texts
    have no terms, and a query without terms has no result.
    """
    items = queries.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), term_counts(F.col(item_text_col)).alias("terms"))
    items = checkpointed(items.select("item", "item_id", F.explode("terms").alias("x")).select("item", "item_id", "x.*"))
    asked = items.where("term != ''")
    numbers = checkpointed(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")).unionByName(docs.sparkSession.sql("SELECT '' AS term, -1L AS t")))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), term_counts(F.col(text_col)).alias("terms"))
    found = found.select("row", "doc_id", F.when(F.size("terms") > 0, F.col("terms")[0]["tf"]).alias("n"), F.explode("terms").alias("x"))
    postings = checkpointed(found.select("row", "doc_id", "n", "x.term", "x.tf").join(numbers, "term").drop("term"))

    total = postings.where("t = -1").agg(F.count(F.lit(1)).alias("N"), F.sum("tf").alias("L")).first()
    n_docs, length = total["N"], total["L"] or 1
    rarity = postings.where("t >= 0").groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weights = rarity.select("t", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    blocks = max(1, -(-items.where("term = ''").count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    shards = max(1, -(-n_docs // shard))

    m = F.expr(f"25L + (75L * n * {n_docs}L) DIV {length}L")
    wanted = checkpointed(asked.join(numbers, "term").select("block", "item", "t", F.col("tf").alias("q")))
    impacts = (
        postings.join(weights, "t")
        .withColumn("m", m)
        .select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "doc_id", "t", F.expr("w * ((1000000000L * tf) DIV (1000L * tf + 8L * m))").alias("impact"))
        .join(wanted.select("t", "block").distinct(), "t")
    )
    packed = wanted.groupBy("block").agg(F.collect_list(F.struct("item", "t", "q")).alias("asked"))
    everywhere = packed.select(F.col("block").alias("of_block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("of_shard"), "asked")

    def answer(lists: pa.Table, block: pa.Table) -> pa.Table:
        out = {"item": [], "row": [], "score": []}
        if lists.num_rows and block.num_rows:
            rows = lists["row"].to_numpy()
            held = Shard(rows, _ordered(lists["doc_id"], rows), lists["t"].to_numpy(), lists["impact"].to_numpy())
            flat = block["asked"].combine_chunks().flatten()
            item, t, q = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("item", "t", "q"))
            order = np.argsort(item, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
                found, scores, _ = held.best(t[part], q[part], k)
                out["item"] += [int(item[part[0]])] * len(found)
                out["row"] += found.tolist()
                out["score"] += scores.tolist()
        ids = dict(zip(lists["row"].to_pylist(), lists["doc_id"].to_pylist(), strict=True)) if out["row"] else {}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in (out | {"doc_id": [ids[r] for r in out["row"]]}).items()})

    best = impacts.groupBy("shard", "block").cogroup(everywhere.groupBy("of_shard", "of_block")).applyInArrow(answer, "item long, row long, score long, doc_id long")
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = best.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)
    return ranked.join(items.where("term = ''").select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
