"""Fingerprint similarity search and joins.

A fingerprint table has columns ``id``, ``fp array<bigint>`` and ``popcnt``.
Scores follow Tanimoto unless stated.  Ordering is deterministic everywhere:
score descending, then id ascending.

Two sets with a and b bits can only reach score t when
``t <= min(a, b) / max(a, b)``, so searches carry an integer popcount band.
The band is one wider on each side than the real-valued bound, which keeps it
exact under floating point; the score test itself always follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import bits as B
from ..functions.once import with_once
from . import chunked
from .blocked import threshold_pairs, topk_pairs
from .scratch import written

# a (bit, popcount) group is cut into blocks of about this many rows
BLOCK_ROWS = 4_096
# and so many blocks are a chunk, where rows are compared chunk by chunk
CHUNK_BLOCKS = 24
#: Comparisons of a chunk that cost as much as one joined pair.
JOINED_PAIR = 100
#: Places over which the rows of one crowded fingerprint are dealt.
SALTS = 64


def band(count: int, threshold: float) -> tuple[int, int]:
    """Inclusive popcount range that can hold a hit for one query."""
    return max(math.ceil(count * threshold) - 1, 1), math.floor(count / threshold) + 1


def band_columns(count: Column, threshold: float) -> tuple[Column, Column]:
    return (
        F.greatest(F.ceil(count * threshold) - 1, F.lit(1)).cast("int"),
        (F.floor(count / threshold) + 1).cast("int"),
    )


def _popcount_words(words: Sequence[int]) -> int:
    return sum(bin(w & 0xFFFFFFFFFFFFFFFF).count("1") for w in words)


def _scored(rows: DataFrame, common: Column, nx: Column, ny: Column) -> DataFrame:
    """Adds ``score``; the intersection is counted once per row, whatever
    filters follow."""
    return with_once(rows, "common", common).withColumn("score", B.tanimoto_counts(F.col("common"), nx, ny))


def _literal_scored(rows: DataFrame, words: Sequence[int], count: int) -> DataFrame:
    return _scored(rows, B.intersection_literal("fp", words), F.lit(count), F.col("popcnt"))


def threshold_search(db: DataFrame, words: Sequence[int], threshold: float, use_pruning: bool = True) -> DataFrame:
    """All rows scoring at least ``threshold`` against one query.

    The band is a plain range on ``popcnt`` and reaches the Parquet scan.
    """
    count = _popcount_words(words)
    if count == 0:
        return db.where("false").select("id", F.lit(0.0).alias("score"))
    rows = db
    if use_pruning and threshold > 0:
        lo, hi = band(count, threshold)
        rows = rows.where(F.col("popcnt").between(lo, hi))
    return (
        _literal_scored(rows, words, count)
        .select("id", "score")
        .where(F.col("score") >= threshold)
        .orderBy(F.desc("score"), "id")
    )


def topk_search(db: DataFrame, words: Sequence[int], k: int) -> DataFrame:
    """The k best rows for one query; empty fingerprints are never returned."""
    count = _popcount_words(words)
    if k <= 0 or count == 0:
        return db.where("false").select("id", F.lit(0.0).alias("score"))
    return (
        _literal_scored(db.where("popcnt > 0"), words, count)
        .select("id", "score")
        .orderBy(F.desc("score"), "id")
        .limit(k)
    )


def nearest_first(count: int, k: int, most: int, read: Callable[[int, int], list[tuple[float, object]]]) -> list[tuple[float, object]]:
    """The k best (score, id) of rows of 1 to ``most`` bits for a query of ``count`` bits.

    ``read(lo, hi)`` gives the k best of the rows of lo to hi bits.  Rows of n
    bits score at most min(n, count) / max(n, count), so those nearest to the
    query's count are read first.  As soon as k rows are known, only counts
    that can still reach the k-th score are left to read; equal scores go by
    id, so counts that can just reach it are read too.
    """
    reach = lambda n: min(n, count) / max(n, count)
    best: list[tuple[float, object]] = []
    low, high, goal = count + 1, count, 0.9  # counts read so far: none
    while low > 1 or high < most:
        if len(best) >= k:
            goal = best[-1][0]
        down, up = min(low, count), max(high, count)
        while down > 1 and reach(down - 1) >= goal:
            down -= 1
        while up < most and reach(up + 1) >= goal:
            up += 1
        up = min(up, most)
        if down >= low and up <= high:
            if len(best) >= k:
                break
            goal = goal - 0.2 if goal > 0.2 else 0.0
            continue
        for lo, hi in ((down, up),) if low > high else ((down, low - 1), (high + 1, up)):
            if lo <= hi:
                best = sorted(best + read(lo, hi), key=lambda x: (-x[0], x[1]))[:k]
        low, high = min(low, down), max(high, up)
    return best


def topk_stored(db: DataFrame, words: Sequence[int], k: int) -> DataFrame:
    """The k best rows of a library stored by :func:`write_database`, nearest popcounts first.

    Each step reads a band of popcounts, which reaches the scan, and brings at
    most k rows back; bands that cannot reach the k-th score are never read.
    """
    count = _popcount_words(words)
    kind = f"id {dict(db.dtypes)['id']}, score double"
    if k <= 0 or count == 0:
        return db.sparkSession.createDataFrame([], kind)

    def read(lo: int, hi: int) -> list[tuple[float, object]]:
        return [(r.score, r.id) for r in topk_search(db.where(F.col("popcnt").between(lo, hi)), words, k).collect()]

    found = nearest_first(count, k, 64 * len(words), read)
    return db.sparkSession.createDataFrame([(i, score) for score, i in found], kind)


def superset_search(db: DataFrame, words: Sequence[int]) -> DataFrame:
    """Rows whose fingerprint has every bit of ``words``.

    A row of fewer bits cannot, so the popcount bound reaches the scan.  Only
    words that ask for a bit are looked at.
    """
    asked = [(k, w) for k, w in enumerate(words) if w]
    rows = db.where(F.col("popcnt") >= _popcount_words(words))
    for k, w in asked:
        rows = rows.where(F.get("fp", F.lit(k)).bitwiseAND(F.lit(w)) == w)
    return rows


def count_range(db: DataFrame, lo: int, hi: int) -> DataFrame:
    return db.where(F.col("popcnt").between(lo, hi))


def write_database(db: DataFrame, path: str, n_files: int | None = None) -> None:
    """Store a fingerprint table ordered by popcount, so that a band touches
    only the files and row groups that can hold hits."""
    n = n_files or int(db.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id takes part in the ranges, so one crowded popcount still splits
    db.repartitionByRange(n, "popcnt", "id").sortWithinPartitions("popcnt", "id").write.mode("overwrite").parquet(path)


def read_database(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def multi_threshold_search(db: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """Every (query_id, id, score) scoring at least ``threshold`` (> 0)."""
    return threshold_pairs(db, queries, threshold)


def multi_topk_search(db: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best rows for each query."""
    return topk_pairs(db, queries, k)


def similarity_matrix(db: DataFrame, queries: DataFrame, pack: int = 256) -> DataFrame:
    """(query_id, id, score) for every query and row, zero scores included.

    The answer has |queries| x |db| rows by definition; use
    :func:`multi_threshold_search` or :func:`multi_topk_search` where part of
    it will do.  Queries travel in packs of about ``pack`` fingerprints and
    the database in as many parts; each part meets each pack once.
    """
    sizes = [max(-(-x.count() // pack), 1) for x in (queries, db)]
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    packed = queries.groupBy(part(sizes[0]).alias("pack")).agg(F.collect_list(F.struct("id", "fp", "popcnt")).alias("qs"))
    packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sizes[1] - 1))))
    rows = db.select("id", "fp", "popcnt", part(sizes[1]).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(sizes[0] - 1))).alias("pack"))
    met = rows.join(packed, ["pack", "part"])

    def score(q):
        common = B.intersection("fp", q.fp)
        return F.struct(q.id.alias("query_id"), B.tanimoto_counts(common, F.col("popcnt"), q.popcnt).alias("score"))

    return met.select("id", F.explode(F.transform("qs", score)).alias("hit")).select("hit.query_id", "id", "hit.score")


#: Queries that visit a block of the inverted index together.
PACK_QUERIES = 256


def _on_bits(fps: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of every set bit, by row."""
    words = pc.fill_null(fps.flatten(), 0).to_numpy(zero_copy_only=False).astype("<i8")
    sizes = np.diff(fps.offsets.to_numpy())
    place, bit = np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    row = np.repeat(np.arange(len(sizes)), sizes)[place]
    return row, bit + 64 * (place - (np.cumsum(sizes) - sizes)[row])


def _numbered(side: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Distinct (id, popcnt), nulls equal, and the number of each row's among them."""
    number, codes = [], {}
    for key in zip(side["id"].to_pylist(), side["popcnt"].to_pylist(), strict=True):
        number.append(codes.setdefault(key, len(codes)))
    number = np.array(number, np.int64)
    first = np.unique(number, return_index=True)[1]
    return side.select(["id", "popcnt"]).take(pa.array(first)), number


def _meetings(schema: pa.Schema):
    """Counts of meetings of one block's rows with one pack's queries, a query at a time."""

    def count(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, q_number = _numbered(queries)
        d, d_number = _numbered(rows)
        out = []
        row, bit = _on_bits(rows["fp"].combine_chunks())
        index = d_number[row][np.argsort(bit, kind="stable")]
        begins = np.concatenate([[0], np.cumsum(np.bincount(bit))])
        row, asked = _on_bits(queries["fp"].combine_chunks())
        asked = asked[np.argsort(q_number[row], kind="stable")]
        ends = np.cumsum(np.bincount(q_number[row], minlength=len(q)))
        for k, bits in enumerate(np.split(asked, ends[:-1])):
            lists = [index[begins[b] : begins[b + 1]] for b in bits[bits < len(begins) - 1].tolist()]
            common = np.bincount(np.concatenate([np.empty(0, np.int64), *lists]))
            at = np.flatnonzero(common)
            mine, theirs = q.take(pa.array(np.full(len(at), k))), d.take(pa.array(at))
            out.append(pa.table([mine["id"], theirs["id"], mine["popcnt"], theirs["popcnt"], pa.array(common[at], pa.int64())], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return count


def sparse_matrix(db: DataFrame, queries: DataFrame, part_rows: int = BLOCK_ROWS) -> DataFrame:
    """Non-zero scores through an inverted index: rows meet on shared bits and
    the number of meetings is the intersection size.

    The database is dealt into blocks of about ``part_rows`` rows by id and
    popcount, and each block has the lists of rows of its bits.  Queries visit
    every block in packs; a query's counts are those of the rows in the lists
    of its bits, so no meeting is a row of its own and only pairs with a score
    leave the block.  Rows of one id and popcount are one, as are queries.
    """
    spark = db.sparkSession
    kept = lambda df: df.where("fp IS NOT NULL").select("id", "popcnt", "fp", F.xxhash64("id", "popcnt").alias("_hash"))
    d, q = written(kept(db), "index"), written(kept(queries), "asked")
    blocks, packs = (max(1, -(-x.count() // n)) for x, n in ((d, part_rows), (q, PACK_QUERIES)))
    part = lambda n: F.pmod("_hash", F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # few blocks of many pairs: by bytes alone they would be put together in few tasks
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * blocks * packs)
    d = d.select("id", "popcnt", "fp", part(blocks).alias("block"), every(packs).alias("pack")).repartition(n, "block", "pack")
    q = q.select("id", "popcnt", "fp", part(packs).alias("pack"), every(blocks).alias("block")).repartition(n, "block", "pack")
    kinds = dict(q.dtypes), dict(d.dtypes)
    ddl = f"query_id {kinds[0]['id']}, id {kinds[1]['id']}, q_n {kinds[0]['popcnt']}, popcnt {kinds[1]['popcnt']}, common bigint"
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    counts = q.groupBy("block", "pack").cogroup(d.groupBy("block", "pack")).applyInArrow(_meetings(schema), ddl)
    return counts.select("query_id", "id", "common", B.tanimoto_counts(F.col("common"), F.col("q_n"), F.col("popcnt")).alias("score"))


def _prefix_length(n: Column, threshold: float) -> Column:
    # a pair scoring t shares at least ceil(t * n) bits of either side, so the
    # n - ceil(t * n) + 1 rarest bits of both sides have one in common; one
    # more bit absorbs floating point at the boundary
    return F.least(n - F.ceil(n * threshold) + 2, n).cast("int")


def _popcount_class(n: Column, threshold: float) -> Column:
    # each class spans a factor 1 / threshold, so counts within the band of
    # each other differ by one class at most
    if threshold >= 1:
        return n.cast("int")
    return F.floor(F.ln(n.cast("double")) / math.log(1 / threshold)).cast("int")


def _estimated_pairs(sizes: DataFrame) -> float:
    """Comparisons that meeting places of these (bit, cls, n) sizes cause."""
    nxt = sizes.select("bit", (F.col("cls") - 1).alias("cls"), F.col("n").alias("m"))
    both = sizes.join(nxt, ["bit", "cls"], "left")
    n, m = F.col("n").cast("double"), F.coalesce("m", F.lit(0))
    return both.agg(F.sum(n * (n / 2 + m))).first()[0] or 0.0


_PLACE = ("bit", "cls", "other", "block", "other_block")


def _sides(rows: DataFrame, sizes: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of every comparison, with equal place columns where they
    meet: same bit, popcount classes at most one apart, side ``a`` the lower.

    A crowded (bit, class) is cut into blocks of about ``block_rows`` rows on
    both sides, and every block meets every block, so no task sees more than
    ``block_rows`` x ``block_rows`` pairs of one meeting place.
    """
    blocks = sizes.select("bit", "cls", F.ceil(F.col("n") / block_rows).cast("int").alias("n_blocks"))
    own = rows.join(F.broadcast(blocks), ["bit", "cls"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int")
    ).drop("n_blocks")

    def visit(other_cls: Column) -> DataFrame:
        there = blocks.select("bit", F.col("cls").alias("other"), F.col("n_blocks"))
        return (
            own.withColumn("other", F.explode(other_cls))
            .join(F.broadcast(there), ["bit", "other"])
            .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
            .drop("n_blocks")
        )

    a = visit(F.array(F.col("cls"), F.col("cls") + 1))
    b = visit(F.array(F.col("cls") - 1, F.col("cls")))
    swapped = {"cls": "other", "other": "cls", "block": "other_block", "other_block": "block"}
    b = b.select(*[F.col(c).alias(swapped.get(c, c)) for c in b.columns])
    return a, b


#: Words compared before the first rows are given up.
FIRST_WORDS = 4


def _block_hits(threshold: float):
    """Hits of one block against another, a row of words at a time, for rows that have met as cogroups.

    Sets of a and b bits that score t differ by (a + b)(1 - t) / (1 + t) bits
    at most.  Differing bits are counted a few words at a time, and a row that
    has too many of them is given up, so most pairs cost their first words.
    """

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        def side(t):
            fp = t["fp"].combine_chunks()
            words = fp.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(fp), -1)
            return words, *(t[c].to_numpy() for c in ("id", "popcnt", "copies"))

        aw, ai, an, ac = side(left)
        right = right.sort_by("popcnt")
        bw, bi, bn, bc = side(right)
        inside = len(left) > 0 and len(right) > 0 and left["cls"][0] == left["other"][0]
        first = np.ascontiguousarray(bw[:, :FIRST_WORDS].T)
        low = np.searchsorted(bn, np.ceil(an * threshold) - 1)
        high = np.searchsorted(bn, np.floor((an + 1) / threshold) + 1, side="right")
        # loose by far more than rounding; the exact test follows in the plan
        share = (1 - threshold) / (1 + threshold) + 1e-9
        out = []
        for k, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            apart = np.zeros(hi - lo, np.uint16)
            for word, own in zip(first, aw[k], strict=False):
                apart += np.bitwise_count(word[lo:hi] ^ own)
            most = share * (an[k] + bn[lo:hi]) + 1e-6
            near = apart <= most
            if inside:
                near &= bi[lo:hi] > ai[k]
            at = np.flatnonzero(near)
            apart, at = apart[at].astype(np.int64), at + lo
            done = FIRST_WORDS
            while done < bw.shape[1] and len(at):
                apart += np.bitwise_count(bw[at, done : 2 * done] ^ aw[k, done : 2 * done]).sum(axis=1, dtype=np.int64)
                near = apart <= share * (an[k] + bn[at]) + 1e-6
                apart, at, done = apart[near], at[near], 2 * done
            if len(at):
                n, common = len(at), (an[k] + bn[at] - apart) // 2
                out.append((np.full(n, ai[k]), bi[at], common, np.full(n, an[k]), bn[at], np.full(n, ac[k]), bc[at]))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        names = ("id_a", "id_b", "common", "na", "nb", "copies_a", "copies_b")
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.array([], np.int64)] * 7
        return pa.table([pa.array(c).cast(t) for c, t in zip(columns, types)], names=names)

    return compare


def all_pairs(
    db: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Distinct fingerprint pairs scoring at least ``threshold`` (> 0, <= 1).

    Returns ``id_a < id_b`` (the smallest ids of the two fingerprints), the
    score, and how many rows carry each.  Copies are folded first, so a
    fingerprint shared by a third of all rows counts once here.

    Only popcounts within the band of each other are compared.  Sparse
    fingerprints may meet on one of their rarest bits (prefix filter), if that
    makes far fewer pairs; all others are compared chunk by chunk
    (:mod:`.chunked`), which needs no row more than once on disk.  The cheaper
    of the two is chosen from the measured sizes of the meeting places; both
    are exact.
    """
    d = chunked.stored_fingerprints(db)
    hits = _prefix_pairs(d, threshold, block_rows)
    if hits is not None:
        return hits
    found = chunked.rounds(d, threshold, chunked.FoundPairs, chunked.PAIRS, chunk_rows=CHUNK_BLOCKS * block_rows)
    return d.sparkSession.createDataFrame([], chunked.PAIRS) if found is None else found


def _prefix_pairs(d: DataFrame, threshold: float, block_rows: int) -> DataFrame | None:
    """The pairs of :func:`all_pairs` by the rarest bits, or nothing where that is dearer than all comparisons."""
    d = d.withColumn("cls", _popcount_class(F.col("popcnt"), threshold))
    keep = _prefix_length(F.col("popcnt"), threshold)
    # one row per popcount class; pairs are fewest where the kept bits are spread evenly
    classes = {r.cls: r for r in d.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum(keep).alias("kept"), F.max(F.size("fp")).alias("words")).collect()}
    pairs = sum(c.n * (c.n / 2 + (classes[k + 1].n if k + 1 in classes else 0)) for k, c in classes.items())
    if JOINED_PAIR * sum(c.kept**2 / (2 * 64 * c.words) for c in classes.values()) >= pairs:
        return None
    rarity = d.select(F.explode(B.on_bits("fp")).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
    # one entry per bit position: bounded by the fingerprint length
    by_rarity = rarity.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "bit"))), lambda s: s.bit)
    ).scalar()
    prefix = F.slice(F.array_intersect(by_rarity, B.on_bits("fp")), F.lit(1), keep)

    def sizes_of(rows):
        # one row per bit and popcount class: bounded by the fingerprint length
        return rows.groupBy("bit", "cls").agg(F.count(F.lit(1)).alias("n"))

    by_prefix = d.select("*", F.explode(prefix).alias("bit"))
    prefix_sizes = sizes_of(by_prefix)
    if JOINED_PAIR * _estimated_pairs(prefix_sizes) >= pairs:
        return None
    a, b = _sides(by_prefix, prefix_sizes, block_rows)
    lo, hi = band_columns(F.col("a.popcnt"), threshold)
    met = a.alias("a").join(
        b.alias("b").hint("shuffle_hash"),
        [F.col(f"a.{c}") == F.col(f"b.{c}") for c in _PLACE]
        + [(F.col("a.cls") < F.col("a.other")) | (F.col("a.id") < F.col("b.id")), F.col("b.popcnt").between(lo, hi)],
    )
    sides = met.select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.popcnt").alias("na"), F.col("b.popcnt").alias("nb"),
        F.col("a.copies").alias("copies_a"), F.col("b.copies").alias("copies_b"), F.col("a.fp").alias("fa"), F.col("b.fp").alias("fb"),
    )
    pairs = with_once(sides, "common", B.intersection("fa", "fb"))
    score = B.tanimoto_counts(F.col("common"), F.col("na"), F.col("nb"))
    flip = F.col("id_a") > F.col("id_b")
    hits = pairs.select(
        F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), score.alias("score"),
        F.when(flip, F.col("copies_b")).otherwise(F.col("copies_a")).alias("copies_a"),
        F.when(flip, F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_b"),
    ).where(F.col("score") >= threshold)
    # a pair may meet at several bits
    return hits.dropDuplicates(["id_a", "id_b"])


def counted_fingerprints(db: DataFrame, threshold: float) -> DataFrame:
    """(number, id, copies, fp, popcnt, neighbours) of the distinct fingerprints that have bits.

    ``neighbours`` are the other rows, copies included, that score at least
    ``threshold``.  They are counted where they are found; no pair is stored.
    """
    reps = chunked.stored_fingerprints(db)
    found = chunked.rounds(reps, threshold, chunked.FoundCounts, chunked.COUNTS)
    if found is None:
        return reps.withColumn("neighbours", F.lit(0).cast("bigint"))
    near = found.groupBy("number").agg(F.sum("n").alias("n"))
    return reps.join(near, "number", "left").withColumn("neighbours", F.coalesce("n", F.lit(0)) + F.col("copies") - 1).drop("n")


def neighbour_counts(db: DataFrame, threshold: float) -> DataFrame:
    """For every row, how many other rows score at least ``threshold``.

    Works on distinct fingerprints and multiplies by their copies, so the
    answer stays linear in the number of rows however many copies there are.
    """
    db = written(db.select("id", "fp", "popcnt"), "rows")
    totals = counted_fingerprints(db, threshold).select("fp", "copies", "neighbours")
    return to_rows(db, written(totals, "neighbours")).select("id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def to_rows(db: DataFrame, per_fp: DataFrame) -> DataFrame:
    """``db`` with what is known of each fingerprint, null where nothing is.

    ``per_fp`` has one row per fingerprint, with its number of ``copies``.  A
    fingerprint of more than a thousandth of all rows is crowded; there are
    fewer than a thousand, so their list is broadcast, and their rows are dealt
    over ``SALTS`` places while all others meet at one.
    """
    total = per_fp.agg(F.sum("copies")).first()[0] or 0
    crowded = F.broadcast(per_fp.where(F.col("copies") * 1000 > total).select("fp", F.lit(True).alias("_crowded")))
    rows = db.join(crowded, "fp", "left").withColumn("_salt", F.when(F.col("_crowded"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    places = F.when(F.col("_crowded"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = per_fp.join(crowded, "fp", "left").withColumn("_salt", F.explode(places))
    return rows.drop("_crowded").join(known.drop("_crowded"), ["fp", "_salt"], "left").drop("_salt")
