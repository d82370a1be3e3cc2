"""Collection-style queries on the star schema: filters, joins, summaries,
ordering, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import descriptors as D
from ..operators import grouping as G
from ..operators import shuffling as H
from ..operators import ordering as W
from ..operators import screening as R
from ..operators import selection as Q
from ..operators.scratch import written
from . import tables as T
from .chemistry import _DSQL, _VIOL
from .registry import query


def _t(name):
    return lambda spark, sf: T.table(spark, sf, name)


lineitem, orders, part, customer, supplier, events, documents, embeddings, nation = map(
    _t, ("lineitem", "orders", "part", "customer", "supplier", "events", "documents", "embeddings", "nation")
)
# ---------------------------------------------------------------- map, filter, predicates


@query("r01_map", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity * 2 + 1 AS q FROM lineitem""")
def map_rows(spark, sf):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return lineitem(spark, sf).select("l_orderkey", "l_linenumber", net.alias("net"), (F.col("l_quantity") * 2 + 1).alias("q"))


@query("r01_zip_map", """SELECT vec_id, round(CAST(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS DOUBLE), 6) AS mirrored FROM embeddings""")
def zip_map(spark, sf):
    e = embeddings(spark, sf)
    product = F.zip_with("embedding", F.reverse("embedding"), lambda a, b: a.cast("double") * b.cast("double"))
    return e.select("vec_id", F.round(F.aggregate(product, F.lit(0.0), lambda acc, v: acc + v), 6).alias("mirrored"))


@query("r02_filter", "SELECT p_partkey, p_name FROM part WHERE p_size > 25 AND NOT (p_retailprice < 950)")
def filter_rows(spark, sf):
    return part(spark, sf).where("p_size > 25").where(~(F.col("p_retailprice") < 950)).select("p_partkey", "p_name")


@query("r03_find_and_count", """SELECT count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS n_big, min(o_orderkey) FILTER (o_totalprice > 200000) AS first_big,
  count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders""")
def find_and_count(spark, sf):
    big = F.col("o_totalprice") > 200000
    return orders(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(big).alias("n_big"), F.min(F.when(big, F.col("o_orderkey"))).alias("first_big"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_p"),
    )


@query("r04_any_all_none", """SELECT l_suppkey, bool_or(l_quantity > 49) AS any_big, bool_and(l_quantity > 0) AS all_positive, NOT bool_or(l_quantity < 0) AS none_negative FROM lineitem GROUP BY 1""")
def any_all_none(spark, sf):
    q = F.col("l_quantity")
    return lineitem(spark, sf).groupBy("l_suppkey").agg(
        F.coalesce(F.bool_or(q > 49), F.lit(False)).alias("any_big"), F.coalesce(F.bool_and(q > 0), F.lit(True)).alias("all_positive"),
        (~F.coalesce(F.bool_or(q < 0), F.lit(False))).alias("none_negative"),
    )


_DESC = ("mw", "logp", "tpsa", "hbd", "hba", "rotatable")


def _compounds(spark, sf):
    m = T.molecules(spark, sf).where("mol IS NOT NULL").withColumn("d", D.descriptors("mol", _DESC))
    return m.select("mol_id", "smiles", "d.*")


@query("r05_filter_factories", f"{_DSQL} SELECT mol_id, mw BETWEEN 100 AND 200 AS in_mw, logp <= 2 AS in_logp, tpsa BETWEEN 20 AND 140 AS in_tpsa, rotatable <= 1 AS in_rot FROM d")
def filter_factories(spark, sf):
    return _compounds(spark, sf).select(
        "mol_id", R.mw_range(100, 200).alias("in_mw"), R.logp_max(2).alias("in_logp"), R.tpsa_range(20, 140).alias("in_tpsa"),
        R.rotatable_max(1).alias("in_rot"),
    )


@query("r06_filter_algebra", f"{_DSQL} SELECT mol_id FROM d WHERE (mw BETWEEN 100 AND 200 AND logp <= 3) AND NOT (tpsa BETWEEN 0 AND 10 OR rotatable <= 0)")
def filter_algebra(spark, sf):
    lead = R.all_of([R.mw_range(100, 200), R.logp_max(3)])
    flat = R.any_of([R.tpsa_range(0, 10), R.rotatable_max(0)])
    return _compounds(spark, sf).where(R.all_of([lead, R.negate(flat)])).select("mol_id")


def _screen():
    return (
        R.StagedScreen()
        .add("MW 100-200", R.mw_range(100, 200)).add("logP <= 2.5", R.logp_max(2.5))
        .add("TPSA 20-100", R.tpsa_range(20, 100)).add("RotB <= 2", R.rotatable_max(2))
    )


_STAGES = f"""{_DSQL}, f AS (SELECT mol_id, mw BETWEEN 100 AND 200 AS a, logp <= 2.5 AS b, tpsa BETWEEN 20 AND 100 AS c, rotatable <= 2 AS e FROM d),
 n AS (SELECT count(*) AS n0, count(*) FILTER (a) AS n1, count(*) FILTER (a AND b) AS n2, count(*) FILTER (a AND b AND c) AS n3, count(*) FILTER (a AND b AND c AND e) AS n4 FROM f)"""


@query("r07_staged_screening", f"""{_STAGES} SELECT 0 AS stage, 'input' AS name, n0 AS remaining, 0::BIGINT AS removed FROM n UNION ALL SELECT 1, 'MW 100-200', n1, n0 - n1 FROM n
  UNION ALL SELECT 2, 'logP <= 2.5', n2, n1 - n2 FROM n UNION ALL SELECT 3, 'TPSA 20-100', n3, n2 - n3 FROM n UNION ALL SELECT 4, 'RotB <= 2', n4, n3 - n4 FROM n""")
def staged_screening(spark, sf):
    return _screen().report(_compounds(spark, sf))


@query("r07_staged_survivors", f"{_STAGES} SELECT mol_id FROM f WHERE a AND b AND c AND e")
def staged_survivors(spark, sf):
    return _screen().survivors(_compounds(spark, sf)).select("mol_id")


@query("r08_take_drop_while", """WITH s AS (SELECT *, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rn FROM part),
  stop AS (SELECT min(rn) AS stop_at FROM s WHERE NOT p_retailprice < 980) SELECT p_partkey, 'take' AS side FROM s, stop WHERE stop_at IS NULL OR rn < stop_at
  UNION ALL SELECT p_partkey, 'drop' FROM s, stop WHERE rn >= stop_at""")
def take_drop_while(spark, sf):
    p = part(spark, sf).select("p_partkey", "p_retailprice")
    order, cond = ["p_retailprice", "p_partkey"], F.col("p_retailprice") < 980
    take = W.take_while(p, order, cond).select("p_partkey", F.lit("take").alias("side"))
    return take.unionAll(W.drop_while(p, order, cond).select("p_partkey", F.lit("drop").alias("side")))


@query("r08_view_chain", "SELECT p_partkey, upper(p_name) AS name FROM part WHERE p_size % 2 = 0 ORDER BY p_partkey DESC LIMIT 40 OFFSET 10")
def view_chain(spark, sf):
    """filter | transform | reverse | drop | take, as one lazy plan."""
    return part(spark, sf).where("p_size % 2 = 0").select("p_partkey", F.upper("p_name").alias("name")).orderBy(F.desc("p_partkey")).offset(10).limit(40)


@query("r08_split_join_views", """SELECT event_id, list_transform(range(1, user_id % 5 + 1), lambda i: i::INT) AS iota, list_reverse(string_split(event_type, 'i')) AS pieces,
  array_to_string(string_split(event_type, 'i'), '-') AS joined FROM events""", arrays=("iota", "pieces",))
def split_join_views(spark, sf):
    n = (F.col("user_id") % 5).cast("int")
    pieces = F.split("event_type", "i", -1)
    iota = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n))
    return events(spark, sf).select("event_id", iota.alias("iota"), F.reverse(pieces).alias("pieces"), F.array_join(pieces, "-").alias("joined"))


@query("r08_keys_values", """SELECT event_id, json_keys(props) AS ks, list_sum(list_transform(json_keys(props), lambda k: CAST(json_extract(props, '$.' || k) AS BIGINT)))::BIGINT AS total FROM events""", arrays=("ks",))
def keys_values(spark, sf):
    m = F.from_json("props", "map<string,bigint>")
    total = F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return events(spark, sf).select("event_id", F.map_keys(m).alias("ks"), total.alias("total"))


@query("r09_combined_filter", f"""{_DSQL} SELECT d.mol_id, round(mw, 4) AS mw FROM d JOIN smi ON smi.mol_id = d.mol_id
  WHERE {_VIOL} <= 1 AND NOT contains(smiles, '[N+](=O)[O-]') AND NOT contains(smiles, 'Cl') AND mw BETWEEN 80 AND 180""")
def combined_filter(spark, sf):
    alerts = F.contains("smiles", F.lit("[N+](=O)[O-]")) | F.contains("smiles", F.lit("Cl"))
    m = T.molecules(spark, sf).where(F.col("mol").isNotNull() & ~alerts).withColumn("d", D.descriptors("mol", _DESC))
    return m.where(D.passes_ro5() & F.col("d.mw").between(80, 180)).select("mol_id", F.round("d.mw", 4).alias("mw"))


@query("r10_where_clamp", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS level, least(greatest(l_quantity, 10), 40) AS clamped,
  greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo FROM lineitem""")
def where_clamp(spark, sf):
    return lineitem(spark, sf).select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("level"),
        F.least(F.greatest("l_quantity", F.lit(10.0)), F.lit(40.0)).alias("clamped"), F.greatest("l_discount", "l_tax").alias("hi"),
        F.least("l_discount", "l_tax").alias("lo"),
    )


# ---------------------------------------------------------------- join shapes


@query("j05_index_lookup", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def index_lookup(spark, sf):
    c = customer(spark, sf).select("c_custkey", "c_name", "c_mktsegment")
    o = orders(spark, sf).select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")


@query("j05_first_by_text", "SELECT p_name, min(p_partkey) AS first_key, count(*) AS n FROM part GROUP BY 1")
def first_by_text(spark, sf):
    return part(spark, sf).groupBy("p_name").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n"))


@query("j06_nested_comprehension", """SELECT r_name, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem, region
  WHERE l_quantity >= r_regionkey * 10 AND l_quantity < r_regionkey * 10 + 10 AND l_discount < 0.05 GROUP BY 1""")
def nested_comprehension(spark, sf):
    """Pairs (line, region) whose quantity falls into the region's decade:
    the range condition becomes an equality on the decade."""
    li = lineitem(spark, sf).where("l_discount < 0.05").withColumn("r_regionkey", F.floor(F.col("l_quantity") / 10).cast("int"))
    r = T.table(spark, sf, "region")
    return li.join(r, "r_regionkey").groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("j07_zip_positions", """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer)
  SELECT rn - 1 AS position, p_partkey, c_custkey FROM a JOIN b USING (rn)""")
def zip_positions(spark, sf):
    a, b = part(spark, sf).select("p_partkey"), customer(spark, sf).select("c_custkey", "c_acctbal")
    return W.zip_by_position(a, ["p_partkey"], b, ["c_acctbal", "c_custkey"]).select("position", "p_partkey", "c_custkey")


@query("j08_membership", """SELECT c_custkey, true AS seen FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
  UNION ALL SELECT c_custkey, false FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def membership(spark, sf):
    c = customer(spark, sf).select("c_custkey")
    # distinct first: repeated keys are dropped before the shuffle
    o = orders(spark, sf).select(F.col("o_custkey").alias("c_custkey")).distinct()
    seen = c.join(o, "c_custkey", "left_semi").withColumn("seen", F.lit(True))
    return seen.unionAll(c.join(o, "c_custkey", "left_anti").withColumn("seen", F.lit(False)))


# ---------------------------------------------------------------- summaries


@query("a01_sum_product_fold", """SELECT l_returnflag, round(sum(l_quantity), 2) AS s, round(sum(ln(1 + l_tax / 1000)), 6) AS log_product, bit_xor(l_partkey) AS folded FROM lineitem GROUP BY 1""")
def sum_product_fold(spark, sf):
    return lineitem(spark, sf).groupBy("l_returnflag").agg(
        F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.sum(F.ln(1 + F.col("l_tax") / 1000)), 6).alias("log_product"),
        F.bit_xor("l_partkey").alias("folded"),
    )


@query("a02_mean_population_sd", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS sd FROM part GROUP BY 1")
def mean_population_sd(spark, sf):
    return part(spark, sf).groupBy("p_brand").agg(
        F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.stddev_pop("p_retailprice"), 6).alias("sd")
    )


@query("a03_min_max_argmax", """SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
  (SELECT min(o_orderkey) FROM orders x WHERE x.o_orderpriority = o.o_orderpriority AND x.o_totalprice = max(o.o_totalprice)) AS top_key FROM orders o GROUP BY 1""")
def min_max_argmax(spark, sf):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("neg")))
    return orders(spark, sf).groupBy("o_orderpriority").agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), (-best.getField("neg")).alias("top_key")
    )


@query("a04_upper_median", "SELECT l_quantity AS median FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS rn, count(*) OVER () AS n FROM lineitem) WHERE rn = n // 2 + 1")
def upper_median(spark, sf):
    return W.upper_median(lineitem(spark, sf).select("l_quantity"), "l_quantity")


@query("a05_inner_product", "SELECT l_linestatus, round(sum(l_quantity * l_discount), 4) AS dot FROM lineitem GROUP BY 1")
def inner_product(spark, sf):
    return lineitem(spark, sf).groupBy("l_linestatus").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("dot"))


@query("a06_counter", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def counter(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a06_grouped_lists", "SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")
def grouped_lists(spark, sf):
    return G.grouped_values(lineitem(spark, sf), "l_partkey", "l_quantity")


@query("a07_duplicate_keys", "SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return documents(spark, sf).groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("text")


@query("a09_mean_ignoring_missing", """SELECT d.source, round(coalesce(avg(quality), 0.0), 6) AS mean_quality, count(quality) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def mean_ignoring_missing(spark, sf):
    d, lab = documents(spark, sf).select("doc_id", "source"), T.table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").groupBy("source").agg(
        F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("mean_quality"), F.count("quality").alias("n")
    )


@query("a11_reductions", "SELECT round(sum(l_extendedprice), 1) AS total, max(l_tax) AS max_tax, count(*) AS n FROM lineitem")
def reductions(spark, sf):
    return lineitem(spark, sf).agg(F.round(F.sum("l_extendedprice"), 1).alias("total"), F.max("l_tax").alias("max_tax"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- order dependent


@query("w01_prefix_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def prefix_sum(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(20,2)").alias("p"))
    return W.prefix_sum(o, ["o_orderdate", "o_orderkey"], F.col("p")).select("o_orderkey", F.col("running").cast("double").alias("running"))


@query("w02_enumerate", "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS position FROM part")
def enumerate_rows(spark, sf):
    return W.dense_positions(part(spark, sf).select("p_partkey", "p_name"), ["p_name", "p_partkey"]).select("p_partkey", "position")


@query("w03_argsort", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS position FROM customer")
def argsort(spark, sf):
    c = customer(spark, sf).select("c_custkey", "c_acctbal")
    return W.dense_positions(c, [-F.col("c_acctbal"), "c_custkey"]).select("c_custkey", "position")


@query("w03_rank_within_group", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer QUALIFY rank <= 3")
def rank_within_group(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return customer(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_custkey", "rank")


@query("w04_rotate", "WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, ((i - 3) % n + n) % n AS position FROM p")
def rotate(spark, sf):
    s = supplier(spark, sf).select("s_suppkey")
    return W.rotate(s, ["s_suppkey"], 3, s.count())


@query("w04_reverse_and_chunk", "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS position FROM orders) SELECT o_orderkey, position, position // 7 AS chunk FROM p")
def reverse_and_chunk(spark, sf):
    o = orders(spark, sf).select("o_orderkey")
    return W.chunk(o, [-F.col("o_orderkey")], 7)


@query("k08_multi_key_sort", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey) - 1 AS position FROM part")
def multi_key_sort(spark, sf):
    p = part(spark, sf).select("p_partkey", "p_brand", "p_size")
    return W.dense_positions(p, ["p_brand", -F.col("p_size"), "p_partkey"]).select("p_partkey", "position")


@query("k09_partial_sort", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey LIMIT 30")
def partial_sort(spark, sf):
    cols = ("l_orderkey", "l_linenumber", "l_extendedprice")
    return lineitem(spark, sf).select(*cols, "l_partkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey").limit(30).select(*cols)


@query("k20_order_statistics", """WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS position, count(*) OVER () AS n FROM lineitem)
  SELECT position, v AS value FROM o WHERE position IN (0, 1000, n - 1, CAST(floor(0.25::DOUBLE * (n - 1)) AS BIGINT), CAST(floor(0.5::DOUBLE * (n - 1)) AS BIGINT), CAST(floor(0.999::DOUBLE * (n - 1)) AS BIGINT))""")
def order_statistics(spark, sf):
    """Smallest, largest, 1001st and three quantiles of a column of many values, without sorting it."""
    return Q.order_statistics(lineitem(spark, sf), "l_extendedprice", positions=[0, 1000, -1], fractions=[0.25, 0.5, 0.999])


@query("k09_is_sorted", """SELECT 'o_orderkey' AS by_column, true AS sorted UNION ALL SELECT 'o_totalprice', (SELECT coalesce(bool_and(o_totalprice <= nxt), true) FROM (SELECT o_totalprice, lead(o_totalprice) OVER (ORDER BY o_orderkey) AS nxt FROM orders))""")
def is_sorted(spark, sf):
    # both comparisons read it twice, so store it first
    o = written(W.dense_positions(orders(spark, sf).select("o_orderkey", "o_totalprice"), ["o_orderkey"]), "positions")
    parts = [W.is_sorted(o, "position", c).select(F.lit(c).alias("by_column"), "sorted") for c in ("o_orderkey", "o_totalprice")]
    return parts[0].unionAll(parts[1])


@query("k10_bounds", "SELECT count(*) FILTER (p_retailprice < 950.5) AS lower_bound, count(*) FILTER (p_retailprice <= 950.5) AS upper_bound, coalesce(bool_or(p_retailprice = 950.5), false) AS found FROM part")
def bounds(spark, sf):
    v = F.col("p_retailprice")
    return part(spark, sf).agg(
        F.count_if(v < 950.5).alias("lower_bound"), F.count_if(v <= 950.5).alias("upper_bound"),
        F.coalesce(F.bool_or(v == 950.5), F.lit(False)).alias("found"),
    )


@query("k11_weight_range", f"{_DSQL} SELECT mol_id, round(mw, 4) AS mw FROM d WHERE mw BETWEEN 120 AND 160")
def weight_range(spark, sf):
    return _compounds(spark, sf).where(R.mw_range(120, 160)).select("mol_id", F.round("mw", 4).alias("mw"))


@query("k12_topk_logp", f"{_DSQL} SELECT mol_id, round(logp, 6) AS logp FROM d ORDER BY round(logp, 6) DESC, mol_id LIMIT 15")
def topk_logp(spark, sf):
    c = _compounds(spark, sf).select("mol_id", F.round("logp", 6).alias("logp"))
    return c.orderBy(F.desc("logp"), "mol_id").limit(15)


# the network of operators/shuffling.py on the rectangle of the row count, and rows outside sent through again
def _once(p, seed=42, rounds=6):
    left, right = f"({p} // b)", f"({p} % b)"
    lets = [f"{left} AS l0, {right} AS r0"]
    for k in range(rounds):
        mixed = lambda c: f"('0x' || substr(md5('{seed}:{k}:' || {c}), 1, 8))::BIGINT"  # noqa: B023, E731
        lets.append(f"l{k} AS l{k + 1}, (r{k} + {mixed(f'l{k}')}) % b AS r{k + 1}" if k % 2 else f"(l{k} + {mixed(f'r{k}')}) % a AS l{k + 1}, r{k} AS r{k + 1}")
    return lets


def _network(source, p):
    text = source
    for k, columns in enumerate(_once(p)):
        text = f"(SELECT p_partkey, n, a, b, {columns} FROM {text})"
    return f"SELECT p_partkey, n, a, b, l6 * b + r6 AS place FROM {text}"


_PLACES = f"""WITH RECURSIVE side AS (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM part),
 numbered AS (SELECT p_partkey, n, a, (n + a - 1) // a AS b, row_number() OVER (ORDER BY p_partkey) - 1 AS p FROM part, side),
 walk AS ({_network('numbered', 'p')} UNION ALL {_network('(SELECT p_partkey, n, a, b, place AS p FROM walk WHERE place >= n)', 'p')}),
 placed AS (SELECT p_partkey, place, n FROM walk WHERE place < n)"""


@query("k13_shuffle_and_sample", f"{_PLACES} SELECT place, p_partkey, place < n // 10 AS sampled FROM placed")
def shuffle_and_sample(spark, sf):
    """Every row's place in a seeded shuffle, and a sample of exactly a tenth."""
    keys = part(spark, sf).select("p_partkey")
    drawn = H.seeded_sample(keys, ["p_partkey"], keys.count() // 10, seed=42).withColumn("sampled", F.lit(True))
    placed = H.seeded_shuffle(keys, ["p_partkey"], seed=42)
    return placed.join(drawn, "p_partkey", "left").select("place", "p_partkey", F.coalesce("sampled", F.lit(False)).alias("sampled"))


@query("k14_partition", "SELECT s_suppkey, s_acctbal > 5000 AS first_part FROM supplier")
def partition_rows(spark, sf):
    return supplier(spark, sf).select("s_suppkey", (F.col("s_acctbal") > 5000).alias("first_part")).orderBy(F.desc("first_part"), "s_suppkey")


# ---------------------------------------------------------------- sets


@query("t01_set_operations", """SELECT 'both' AS op, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000)
  UNION ALL SELECT 'either', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000)
  UNION ALL SELECT 'left', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000)""")
def set_operations(spark, sf):
    a = customer(spark, sf).where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = supplier(spark, sf).where("s_acctbal > 2000").select(F.col("s_nationkey").alias("k"))
    named = [("both", a.intersect(b)), ("either", a.union(b).distinct()), ("left", a.subtract(b))]
    out = [d.select(F.lit(n).alias("op"), "k") for n, d in named]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("t01_array_sets", """WITH d AS (SELECT doc_id, list_distinct(string_split(lower(substr(text, 1, length(text) // 2)), ' ')) AS a, list_distinct(string_split(lower(substr(text, length(text) // 2 + 1)), ' ')) AS b FROM documents)
  SELECT doc_id, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_either, len(list_filter(a, lambda w: NOT list_contains(b, w))) AS n_left FROM d""")
def array_sets(spark, sf):
    """Words of the first and the second half of each text."""
    words = lambda part: F.array_distinct(F.split(F.lower(part), " ", -1))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    d = documents(spark, sf).select("doc_id", words(first).alias("a"), words(second).alias("b"))
    n = lambda c: F.size(c).cast("bigint")
    return d.select(
        "doc_id", n(F.array_intersect("a", "b")).alias("n_both"), n(F.array_union("a", "b")).alias("n_either"), n(F.array_except("a", "b")).alias("n_left")
    )


@query("t02_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct(spark, sf):
    return lineitem(spark, sf).select("l_partkey", "l_suppkey").distinct()


@query("t03_concatenate", "SELECT c_custkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def concatenate(spark, sf):
    c = customer(spark, sf).select(F.col("c_custkey").alias("k"), F.lit("c").alias("side"))
    return c.unionAll(supplier(spark, sf).select(F.col("s_suppkey").alias("k"), F.lit("s").alias("side")))


# ---------------------------------------------------------------- scalar functions


@query("x01_string_basics", """SELECT p_partkey, length(p_name) AS len, p_name = '' AS is_empty, p_name || '/' || p_brand AS joined, substr(p_name, 3, 4) AS piece, strpos(p_name, 'e') - 1 AS at_e,
  contains(p_name, 'ed') AS has_ed, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'ring') AS ends, reverse(p_name) AS backwards, p_name < p_type AS before FROM part""")
def string_basics(spark, sf):
    n = F.col("p_name")
    return part(spark, sf).select(
        "p_partkey", F.length(n).cast("bigint").alias("len"), (n == "").alias("is_empty"), F.concat(n, F.lit("/"), F.col("p_brand")).alias("joined"),
        F.substring(n, 3, 4).alias("piece"), (F.instr(n, "e") - 1).cast("bigint").alias("at_e"), n.contains("ed").alias("has_ed"),
        n.startswith("red").alias("starts"), n.endswith("ring").alias("ends"), F.reverse(n).alias("backwards"), (n < F.col("p_type")).alias("before"),
    )


@query("x02_string_editing", r"""SELECT p_partkey, string_split(p_name, ' ') AS words, regexp_replace(chr(9) || ' ' || p_name || chr(10), '^\s+|\s+$', '', 'g') AS trimmed, array_to_string(string_split(p_name, ' '), '_') AS joined,
  replace(p_name, 'e', 'EE') AS replaced, upper(p_name) AS up, length(p_name) - length(replace(p_name, 'i', '')) AS n_i FROM part""", arrays=("words",))
def string_editing(spark, sf):
    from ..sources.smi import trim

    n = F.col("p_name")
    return part(spark, sf).select(
        "p_partkey", F.split(n, " ", -1).alias("words"), trim(F.concat(F.lit("\t "), n, F.lit("\n"))).alias("trimmed"),
        F.array_join(F.split(n, " ", -1), "_").alias("joined"), F.replace(n, F.lit("e"), F.lit("EE")).alias("replaced"), F.upper(n).alias("up"),
        F.regexp_count(n, F.lit("i")).cast("bigint").alias("n_i"),
    )


@query("x03_conversions", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS not_a_number, printf('%.6f', value) AS text6, printf('%05d', user_id) AS padded, printf('%x', user_id) AS hex FROM events""")
def conversions(spark, sf):
    return events(spark, sf).select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").try_cast("bigint").alias("not_a_number"),
        F.format_string("%.6f", "value").alias("text6"), F.format_string("%05d", "user_id").alias("padded"), F.format_string("%x", "user_id").alias("hex"),
    )


@query("x04_math", """SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity), 9) AS sq, round(pow(l_discount + 1, 3), 9) AS cube, round(exp(l_tax), 9) AS ex, round(ln(l_quantity), 9) AS lg, round(log10(l_quantity), 9) AS l10,
  round(log2(l_quantity), 9) AS l2, round(sin(l_quantity), 9) AS si, round(cos(l_quantity), 9) AS co, round(atan2(l_discount, l_quantity), 9) AS at, abs(l_discount - l_tax) < 0.02 AS near, floor(l_extendedprice / 7) AS fl,
  ceil(l_extendedprice / 7) AS ce, trunc(l_extendedprice / 7) AS tr, l_orderkey % 7 AS md, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 9) AS hy, l_partkey // 3 AS dv, round(l_discount + 0.25 * (l_tax - l_discount), 9) AS le,
  isnan(l_tax) AS nan, isfinite(l_quantity) AS fin FROM lineitem""")
def math_functions(spark, sf):
    q, d, t, e = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    r = lambda c, n: F.round(c, 9).alias(n)
    return lineitem(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", r(F.sqrt(q), "sq"), r(F.pow(d + 1, F.lit(3)), "cube"), r(F.exp(t), "ex"), r(F.ln(q), "lg"), r(F.log10(q), "l10"),
        r(F.log2(q), "l2"), r(F.sin(q), "si"), r(F.cos(q), "co"), r(F.atan2(d, q), "at"), (F.abs(d - t) < 0.02).alias("near"),
        F.floor(e / 7).cast("double").alias("fl"), F.ceil(e / 7).cast("double").alias("ce"),
        F.when(e < 0, F.ceil(e / 7)).otherwise(F.floor(e / 7)).cast("double").alias("tr"), (F.col("l_orderkey") % 7).alias("md"), r(F.hypot(q, t), "hy"),
        F.expr("l_partkey div 3").alias("dv"), r(d + 0.25 * (t - d), "le"), F.isnan(t).alias("nan"), (~F.isnan(q) & (F.abs(q) < float("inf"))).alias("fin"),
    )


@query("x04_midpoints_and_infinities", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t, CASE l_partkey % 5 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE ELSE l_quantity::DOUBLE END AS q FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(d + (t - d) / 2, 9) AS middle, CAST(CASE WHEN l_partkey >= l_orderkey THEN l_orderkey + (l_partkey - l_orderkey) // 2 ELSE l_orderkey - (l_orderkey - l_partkey) // 2 END AS BIGINT) AS whole_middle,
   isinf(q) AS infinite, q < 0 AND isinf(q) AS below_all, round(2 * pi() * d, 9) AS around, round(exp(1) * t, 9) AS e_times FROM l""")
def midpoints_and_infinities(spark, sf):
    """Midpoints (whole ones rounded towards the first number), infinite values, the constants pi and e."""
    d, t, k = F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.col("l_partkey") % 5
    inf = float("inf")
    li = lineitem(spark, sf).withColumn("q", F.when(k == 0, F.lit(inf)).when(k == 1, F.lit(-inf)).otherwise(F.col("l_quantity").cast("double")))
    return li.select(
        "l_orderkey", "l_linenumber", F.round(d + (t - d) / 2, 9).alias("middle"), F.expr("l_orderkey + (l_partkey - l_orderkey) div 2").alias("whole_middle"),
        (F.abs("q") == inf).alias("infinite"), (F.col("q") == -inf).alias("below_all"), F.round(F.pi() * 2 * d, 9).alias("around"), F.round(F.e() * t, 9).alias("e_times"),
    )


def erased(values, start: int, count: int | None = None):
    """A list without ``count`` values from position ``start`` (from 0) on, or without all that follow."""
    head = F.slice(values, 1, start)
    return head if count is None else F.concat(head, F.slice(values, F.lit(start + count + 1), F.size(values)))


def _running(values: str):
    """Cumulative sums, by a fold that keeps the last sum."""
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("sums"))
    step = lambda s, x: F.struct((s["last"] + x).alias("last"), F.array_append(s["sums"], s["last"] + x).alias("sums"))
    return F.aggregate(values, start, step, lambda s: s["sums"])


@query("x05_vectors", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT) AS v FROM embeddings)
  SELECT vec_id, list_sum(v)::BIGINT AS total, list_max(v) AS hi, (list_position(v, list_max(v)) - 1)::BIGINT AS argmax, len(list_distinct(v)) AS n_unique, list_transform(range(1, len(v) + 1), lambda i: list_sum(v[1:i])::BIGINT) AS running FROM v""", arrays=("running",))
def vectors(spark, sf):
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint"))
    e = embeddings(spark, sf).select("vec_id", v.alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return e.select(
        "vec_id", total(F.col("v")).alias("total"), F.array_max("v").alias("hi"), (F.array_position("v", F.array_max("v")) - 1).alias("argmax"),
        F.size(F.array_distinct("v")).cast("bigint").alias("n_unique"), _running("v").alias("running"),
    )


@query("x06_maps", """SELECT event_id, k AS got, k IS NOT NULL AS has_k, 'z' = 'k' AS has_z, k AS kept_first, 7::BIGINT AS overwritten, list_sort(['k', 'n']) AS ks, 1::BIGINT AS n_after_erase
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""", arrays=("ks",))
def maps(spark, sf):
    m = F.from_json("props", "map<string,bigint>")
    e = events(spark, sf).select("event_id", m.alias("m"))
    seven = F.lit(7).cast("bigint")

    def without(c, key):
        return F.map_filter(c, lambda k, _: k != key)

    kept = F.when(F.map_contains_key("m", "k"), F.col("m")).otherwise(F.map_concat("m", F.create_map(F.lit("k"), seven)))
    replaced = F.map_concat(without(F.col("m"), "k"), F.create_map(F.lit("k"), seven))
    merged = F.map_concat("m", F.create_map(F.lit("n"), F.lit(0).cast("bigint")))
    return e.select(
        "event_id", F.try_element_at("m", F.lit("k")).alias("got"), F.map_contains_key("m", "k").alias("has_k"), F.map_contains_key("m", "z").alias("has_z"),
        F.try_element_at(kept, F.lit("k")).alias("kept_first"), F.try_element_at(replaced, F.lit("k")).alias("overwritten"),
        F.sort_array(F.map_keys(merged)).alias("ks"), F.size(without(merged, "n")).cast("bigint").alias("n_after_erase"),
    )


@query("x07_optional", """SELECT d.doc_id, quality IS NOT NULL AS has_value, coalesce(quality, -1) AS value_or, quality + 1 AS transformed, CASE WHEN quality > 0 THEN toxic END AS chained FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def optional(spark, sf):
    d = documents(spark, sf).select("doc_id").join(T.table(spark, sf, "labels"), "doc_id", "left")
    q = F.col("quality")
    return d.select("doc_id", q.isNotNull().alias("has_value"), F.coalesce(q, F.lit(-1)).alias("value_or"), (q + 1).alias("transformed"), F.when(q > 0, F.col("toxic")).alias("chained"))


@query("x08_variant", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'DECIMAL' WHEN 2 THEN 'STRING' ELSE 'BOOLEAN' END AS kind,
  CASE event_id % 4 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN printf('%.3f', user_id + 0.5) WHEN 2 THEN event_type ELSE 'true' END AS shown FROM events""")
def variant(spark, sf):
    """Mixed-type properties held as VARIANT and shown by their type."""
    e = events(spark, sf)
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.concat(F.col("user_id").cast("string"), F.lit(".5")))
        .when(k == 2, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise("true")
    )
    v = e.select("event_id", F.parse_json(text).alias("v"))
    kind = F.regexp_replace(F.schema_of_variant("v"), r"\(.*", "")
    shown = F.when(kind == "DECIMAL", F.format_string("%.3f", F.variant_get("v", "$", "double"))).otherwise(F.variant_get("v", "$", "string"))
    return v.select("event_id", kind.alias("kind"), shown.alias("shown"))


@query("x09_clear_and_erase", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 100)::BIGINT) AS v FROM embeddings)
  SELECT vec_id, 0 AS n_cleared, list_concat(v[1:2], v[4:]) AS third_erased, list_concat(v[1:1], v[5:]) AS range_erased FROM v""", arrays=("third_erased", "range_erased"), ints=("n_cleared",))
def clear_and_erase(spark, sf):
    """Lists without all, the third, and the second to fourth of their values."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("bigint"))
    e = embeddings(spark, sf).select("vec_id", v.alias("v"))
    return e.select("vec_id", F.size(erased("v", 0)).alias("n_cleared"), erased("v", 2, 1).alias("third_erased"), erased("v", 1, 3).alias("range_erased"))


@query("x09_list_operations", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 100)::BIGINT) AS v FROM embeddings)
  SELECT vec_id, list_append(v, 99) AS appended, v[1:-2] AS popped, list_concat([0], v) AS inserted, list_filter(v, lambda x: x <> v[1]) AS erased, v[1:2] AS head, v[-2:] AS tail, v[3:4] AS middle,
   list_reverse(v) AS reversed, v[1] AS front, v[-1] AS back, (list_position(v, v[-1]) - 1)::BIGINT AS idx, [v[1], v[1], v[1]] AS filled, list_concat(v, v) AS doubled FROM v""", arrays=("appended", "popped", "inserted", "erased", "head", "tail", "middle", "reversed", "filled", "doubled",))
def list_operations(spark, sf):
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("bigint"))
    e = embeddings(spark, sf).select("vec_id", v.alias("v"))
    big = lambda n: F.lit(n).cast("bigint")
    return e.select(
        "vec_id", F.array_append("v", big(99)).alias("appended"), F.slice("v", F.lit(1), F.size("v") - 1).alias("popped"), F.array_insert("v", 1, big(0)).alias("inserted"),
        F.array_remove("v", F.get("v", F.lit(0))).alias("erased"), F.slice("v", 1, 2).alias("head"), F.slice("v", -2, 2).alias("tail"), F.slice("v", 3, 2).alias("middle"),
        F.reverse("v").alias("reversed"), F.element_at("v", 1).alias("front"), F.element_at("v", -1).alias("back"),
        (F.array_position("v", F.element_at("v", -1)) - 1).cast("bigint").alias("idx"), F.array_repeat(F.element_at("v", 1), 3).alias("filled"), F.concat("v", "v").alias("doubled"),
    )


@query("x10_random_columns", """SELECT p_brand, count(*) AS n, true AS uniform_in_range, true AS die_in_range, true AS normal_finite FROM part GROUP BY 1""")
def random_columns(spark, sf):
    """What holds for all seeded uniform, normal and die draws, by brand."""
    drawn = part(spark, sf).select("p_brand", F.rand(1).alias("uniform"), F.randn(2).alias("normal"), F.floor(F.rand(3) * 6).alias("die"))
    return drawn.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and((F.col("uniform") >= 0) & (F.col("uniform") < 1)).alias("uniform_in_range"),
        F.bool_and(F.col("die").between(0, 5)).alias("die_in_range"),
        F.bool_and(F.abs("normal") < 40).alias("normal_finite"),
    )
