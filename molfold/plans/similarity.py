"""Queries over sign-bit and word-bit fingerprints: bit functions and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import search as K
from ..operators import sliced as L
from ..operators.clusters import ClusterIndex
from ..operators.leaders import sphere_exclusion
from ..operators.scratch import scratch_path, written
from . import tables as T
from .registry import query

# on-bit lists of the embeddings, and the single 64-bit word they make up
_SIGN = """WITH sb AS (SELECT vec_id AS id, list_filter(range(64), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings),
 w AS (SELECT id, bits, len(bits) AS n, list_sum(list_transform(bits, lambda i: (1::HUGEINT << i)))::UBIGINT AS u FROM sb)"""
# neighbouring ids are compared with each other
_NEXT = f"{_SIGN}, p AS (SELECT x.id, x.u AS xu, y.u AS yu, x.n AS xn, y.n AS yn, x.bits AS xb, y.bits AS yb, len(list_intersect(x.bits, y.bits)) AS c FROM w x JOIN w y ON y.id = x.id + 1)"


def _pairs(spark, sf):
    """Each vector beside the one with the next id."""
    a = T.sign_bits(spark, sf)
    b = a.select((F.col("id") - 1).alias("id"), F.col("fp").alias("fp2"), F.col("popcnt").alias("popcnt2"))
    return a.join(b, "id")


_SIGNED = "CASE WHEN {u} >= 9223372036854775808::UBIGINT THEN ({u}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {u}::BIGINT END"


@query("s01_set_clear_get_bit", f"""{_SIGN} SELECT id, {_SIGNED.format(u='(u | 32::UBIGINT)')} AS with_5, {_SIGNED.format(u='(u & 18446744073709551583::UBIGINT)')} AS without_5,
  list_contains(bits, 63) AS has_63 FROM w""")
def set_clear_get_bit(spark, sf):
    return T.sign_bits(spark, sf).select(
        "id", B.set_bit("fp", 5)[0].alias("with_5"), B.clear_bit("fp", 5)[0].alias("without_5"), B.get_bit("fp", 63).alias("has_63")
    )


@query("s02_popcount", f"{_SIGN} SELECT id, n AS popcnt FROM w")
def popcount(spark, sf):
    return T.sign_bits(spark, sf).select("id", F.col("popcnt").cast("bigint").alias("popcnt"))


@query("s03_intersection", f"{_NEXT} SELECT id, c AS common FROM p")
def intersection(spark, sf):
    return _pairs(spark, sf).select("id", B.intersection("fp", "fp2").cast("bigint").alias("common"))


@query("s04_union_count", f"{_NEXT} SELECT id, xn + yn - c AS n_union FROM p")
def union_count(spark, sf):
    return _pairs(spark, sf).select("id", B.union_count("fp", "fp2").cast("bigint").alias("n_union"))


@query("s05_tanimoto", f"{_NEXT} SELECT id, CASE WHEN xn + yn - c = 0 THEN 0 ELSE c::DOUBLE / (xn + yn - c) END AS score FROM p")
def tanimoto(spark, sf):
    return _pairs(spark, sf).select("id", B.tanimoto("fp", "fp2").alias("score"))


@query("s06_tanimoto_stored_counts", f"{_NEXT} SELECT id, CASE WHEN xn + yn - c = 0 THEN 0 ELSE c::DOUBLE / (xn + yn - c) END AS score FROM p")
def tanimoto_stored_counts(spark, sf):
    return _pairs(spark, sf).select("id", B.tanimoto("fp", "fp2", "popcnt", "popcnt2").alias("score"))


@query("s07_dice", f"{_NEXT} SELECT id, CASE WHEN xn + yn = 0 THEN 0 ELSE 2 * c::DOUBLE / (xn + yn) END AS score FROM p")
def dice(spark, sf):
    return _pairs(spark, sf).select("id", B.dice("fp", "fp2").alias("score"))


@query("s08_cosine", f"{_NEXT} SELECT id, round(CASE WHEN xn * yn = 0 THEN 0 ELSE c / sqrt(xn::DOUBLE * yn) END, 12) AS score FROM p")
def cosine(spark, sf):
    return _pairs(spark, sf).select("id", F.round(B.cosine("fp", "fp2"), 12).alias("score"))


@query("s09_tversky", f"{_NEXT} SELECT id, round(CASE WHEN 0.9 * (xn - c) + 0.1 * (yn - c) + c <= 0 THEN 0 ELSE c::DOUBLE / (0.9 * (xn - c) + 0.1 * (yn - c) + c) END, 12) AS score FROM p")
def tversky(spark, sf):
    return _pairs(spark, sf).select("id", F.round(B.tversky("fp", "fp2", 0.9, 0.1), 12).alias("score"))


@query("s10_hamming", f"{_NEXT} SELECT id, xn + yn - 2 * c AS distance FROM p")
def hamming(spark, sf):
    return _pairs(spark, sf).select("id", B.hamming("fp", "fp2").cast("bigint").alias("distance"))


@query("s11_subset", f"""{_NEXT} SELECT id, c = xn AS is_subset, true AS common_in_both FROM p""")
def subset(spark, sf):
    p = _pairs(spark, sf).withColumn("both", B.bit_and("fp", "fp2"))
    return p.select("id", B.is_subset("fp", "fp2").alias("is_subset"), (B.is_subset("both", "fp") & B.is_subset("both", "fp2")).alias("common_in_both"))


@query("s12_on_bits", f"{_SIGN} SELECT id, unnest(bits)::INT AS bit FROM w")
def on_bits(spark, sf):
    return T.sign_bits(spark, sf).select("id", F.explode(B.on_bits("fp")).alias("bit"))


@query("s13_word_functions", f"""{_SIGN}, r AS (SELECT *, list_filter(range(64), lambda i: NOT list_contains(bits, i)) AS off FROM w)
  SELECT id, CASE WHEN n = 0 THEN 64 ELSE 63 - list_max(bits) END AS clz, CASE WHEN n = 0 THEN 64 ELSE list_min(bits) END AS ctz,
   CASE WHEN n = 64 THEN 64 ELSE 63 - list_max(off) END AS clo, CASE WHEN n = 64 THEN 64 ELSE list_min(off) END AS cto, n = 1 AS single,
   CASE WHEN n = 0 THEN 0 ELSE list_max(bits) + 1 END AS width, CASE WHEN n = 0 THEN 0 ELSE CASE WHEN list_max(bits) = 63 THEN -9223372036854775808 ELSE (1::HUGEINT << list_max(bits))::BIGINT END END AS floor_bit,
   list_sort(list_transform(bits, lambda i: (i + 7) % 64)) AS rot_left, list_sort(list_transform(bits, lambda i: (i + 57) % 64)) AS rot_right FROM r""", arrays=("rot_left", "rot_right",))
def word_functions(spark, sf):
    d = T.sign_bits(spark, sf).withColumn("w", F.col("fp")[0])
    big = lambda c: c.cast("bigint")
    rotated = lambda w: F.transform(B.on_bits(F.array(w)), lambda b: b.cast("bigint"))
    return d.select(
        "id", big(B.countl_zero("w")).alias("clz"), big(B.countr_zero("w")).alias("ctz"), big(B.countl_one("w")).alias("clo"),
        big(B.countr_one("w")).alias("cto"), B.has_single_bit("w").alias("single"), big(B.bit_width("w")).alias("width"),
        B.bit_floor("w").alias("floor_bit"), rotated(B.rotl("w", 7)).alias("rot_left"), rotated(B.rotr("w", 7)).alias("rot_right"),
    )


@query("s15_sparse_tanimoto", f"{_NEXT} SELECT id, c AS common, CASE WHEN xn + yn - c = 0 THEN 0 ELSE c::DOUBLE / (xn + yn - c) END AS score FROM p")
def sparse_tanimoto(spark, sf):
    p = _pairs(spark, sf).withColumns({"a": B.on_bits("fp"), "b": B.on_bits("fp2")})
    return p.select("id", B.sparse_intersection("a", "b").cast("bigint").alias("common"), B.sparse_tanimoto("a", "b").alias("score"))


def _word_sql(table, key, text, n_bits=2048):
    return f"""(SELECT {key} AS id, list(DISTINCT (('0x' || substr(md5(word), 1, 8))::BIGINT % {n_bits})::INT) AS bits
    FROM (SELECT {key}, unnest(regexp_split_to_array({text}, '[ \\n]+')) AS word FROM {table}) WHERE word <> '' GROUP BY 1)"""


_DOCS = f"WITH d AS (SELECT *, len(bits) AS n FROM {_word_sql('documents', 'doc_id', 'text')})"
_BOTH = f"{_DOCS}, q AS (SELECT id AS query_id, bits AS qb, len(bits) AS qn FROM {_word_sql('benchmark', 'item_id', 'text')})"
_SCORED = f"""{_BOTH}, one AS (SELECT id, n, unnest(bits) AS b FROM d), qone AS (SELECT query_id, qn, unnest(qb) AS b FROM q),
 cm AS (SELECT query_id, id, qn, n, count(*) AS c FROM one JOIN qone USING (b) GROUP BY ALL),
 sc AS (SELECT *, c::DOUBLE / (qn + n - c) AS score FROM cm)"""


@query("s16_lengths_512_bits", f"""WITH d AS (SELECT id, bits, len(bits) AS n FROM {_word_sql('documents', 'doc_id', 'text', 512)}), p AS (
  SELECT x.id, x.n AS xn, y.n AS yn, len(list_intersect(x.bits, y.bits)) AS c FROM d x JOIN d y ON y.id = x.id + 1)
  SELECT id, c::DOUBLE / (xn + yn - c) AS tanimoto, 2 * c::DOUBLE / (xn + yn) AS dice FROM p""")
def lengths_512(spark, sf):
    a = T.word_bits(T.table(spark, sf, "documents"), "doc_id", "text", 512)
    b = a.select((F.col("id") - 1).alias("id"), F.col("fp").alias("fp2"))
    return a.join(b, "id").select("id", B.tanimoto("fp", "fp2").alias("tanimoto"), B.dice("fp", "fp2").alias("dice"))


@query("s17_bool_list_tanimoto", f"{_NEXT} SELECT id, CASE WHEN xn + yn - c = 0 THEN 0 ELSE c::DOUBLE / (xn + yn - c) END AS score FROM p")
def bool_list_tanimoto(spark, sf):
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v > 0).alias("x"))
    nxt = e.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return e.join(nxt, "id").select("id", B.bool_tanimoto("x", "y").alias("score"))


@query("t04_bit_set_algebra", f"""{_NEXT} SELECT id, c AS n_and, xn + yn - c AS n_or, xn + yn - 2 * c AS n_xor,
  list_sort(list_intersect(xb, yb))::INT[] AS and_bits FROM p""", arrays=("and_bits",))
def bit_set_algebra(spark, sf):
    p = _pairs(spark, sf)
    n = lambda c: B.popcount(c).cast("bigint")
    return p.select(
        "id", n(B.bit_and("fp", "fp2")).alias("n_and"), n(B.bit_or("fp", "fp2")).alias("n_or"), n(B.bit_xor("fp", "fp2")).alias("n_xor"),
        B.on_bits(B.bit_and("fp", "fp2")).alias("and_bits"),
    )


@query("io18_packed_bytes", f"""{_SIGN}, hx AS (SELECT id, lpad(to_hex(u), 16, '0') AS h, lpad(to_hex(list_sum(list_transform(bits, lambda i: (1::HUGEINT << (63 - i))))::UBIGINT), 16, '0') AS m FROM w)
  SELECT id, upper(substr(h,15,2)||substr(h,13,2)||substr(h,11,2)||substr(h,9,2)||substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2)) AS little, upper(m) AS big FROM hx""")
def packed_bytes(spark, sf):
    d = T.sign_bits(spark, sf)
    return d.select("id", B.packed_bytes("fp").alias("little"), B.packed_bytes("fp", "big").alias("big"))


@query("io18_unpacked_words", f"{_SIGN} SELECT id, {_SIGNED.format(u='u')} AS little, {_SIGNED.format(u='u')} AS big, 8 AS n_bytes FROM w", ints=("n_bytes",))
def unpacked_words(spark, sf):
    """Packed bytes as binary rows and back to words, in both bit orders."""
    d = T.sign_bits(spark, sf).select("id", B.packed_binary("fp").alias("little"), B.packed_binary("fp", "big").alias("big"))
    return d.select("id", B.unpacked("little")[0].alias("little"), B.unpacked("big", "big")[0].alias("big"), F.length("little").alias("n_bytes"))


@query("s13_bit_ceil_packbits", f"""WITH v AS (SELECT vec_id AS id, embedding AS e, floor(abs(embedding[1]::DOUBLE) * 1000000)::BIGINT AS w FROM embeddings)
  SELECT id, w, CASE WHEN w <= 1 THEN 1 ELSE list_min(list_filter(list_transform(range(40), lambda i: (1::BIGINT << i)), lambda p: p >= w)) END AS ceil_bit,
   list_transform(range(8), lambda k: list_sum(list_transform(range(8), lambda j: CASE WHEN e[k * 8 + j + 1] > 0 THEN 1 << (7 - j) ELSE 0 END))::INT) AS packed FROM v""", arrays=("packed",))
def bit_ceil_packbits(spark, sf):
    """Next power of two of a number, and signs of a vector packed eight to a byte."""
    e = T.table(spark, sf, "embeddings")
    w = F.floor(F.abs(F.get("embedding", F.lit(0)).cast("double")) * 1000000).cast("bigint")
    return e.select(F.col("vec_id").alias("id"), w.alias("w"), B.packbits(F.transform(F.slice("embedding", 1, 64), lambda x: x > 0)).alias("packed")).withColumn("ceil_bit", B.bit_ceil("w"))


# ---------------------------------------------------------------- search

# one query: the words of a fixed sentence of the corpus vocabulary
QUERY_TEXT = "the of and then that than this heron eran on in an with it is was for not are be"
_QUERY_SQL = f"(SELECT list(DISTINCT (('0x' || substr(md5(word), 1, 8))::BIGINT % 2048)::INT) AS qb FROM (SELECT unnest(string_split('{QUERY_TEXT}', ' ')) AS word))"
_ONE = f"{_DOCS}, q AS (SELECT qb, len(qb) AS qn FROM {_QUERY_SQL}), cm AS (SELECT id, n, qn, len(list_intersect(bits, qb)) AS c FROM d, q), sc AS (SELECT id, c::DOUBLE / (qn + n - c) AS score, n, qn FROM cm)"


def text_words(text: str, n_bits: int = 2048) -> list[int]:
    """Fingerprint words of one query text, computed where the query is built."""
    import hashlib

    words = [0] * (n_bits // 64)
    for w in text.split():
        bit = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % n_bits
        words[bit // 64] |= 1 << (bit % 64)
    return [w - (1 << 64) if w >> 63 else w for w in words]


@query("k01_threshold_search", f"{_ONE} SELECT id, score FROM sc WHERE score >= 0.05")
def threshold_search(spark, sf):
    return K.threshold_search(T.document_bits(spark, sf), text_words(QUERY_TEXT), 0.05)


@query("k01_threshold_unpruned", f"{_ONE} SELECT id, score FROM sc WHERE score >= 0.05")
def threshold_unpruned(spark, sf):
    return K.threshold_search(T.document_bits(spark, sf), text_words(QUERY_TEXT), 0.05, use_pruning=False)


def _stored(spark, sf):
    """The documents' fingerprints as a library on disk, in popcount order."""
    path = scratch_path(spark, "library")
    K.write_database(T.document_bits(spark, sf), path)
    return K.read_database(spark, path)


@query("k01_threshold_stored", f"{_ONE} SELECT id, score FROM sc WHERE score >= 0.2")
def threshold_stored(spark, sf):
    """Against a stored library: the popcount band reaches the scan."""
    return K.threshold_search(_stored(spark, sf), text_words(QUERY_TEXT), 0.2)


@query("k02_topk_stored", f"{_ONE} SELECT id, score FROM sc WHERE n > 0 ORDER BY score DESC, id LIMIT 10")
def topk_stored(spark, sf):
    return K.topk_stored(_stored(spark, sf), text_words(QUERY_TEXT), 10)


@query("k15_stored_1024_topk", f"{_ONE.replace('2048', '1024')} SELECT id, score FROM sc WHERE n > 0 ORDER BY score DESC, id LIMIT 25")
def stored_1024_topk(spark, sf):
    """Sets of 1,024 bits, the nearest popcounts first."""
    path = scratch_path(spark, "library")
    K.write_database(T.word_bits(T.table(spark, sf, "documents"), "doc_id", "text", 1024), path)
    return K.topk_stored(K.read_database(spark, path), text_words(QUERY_TEXT, 1024), 25)


@query("k16_contains_bits", f"{_ONE} SELECT id, n AS popcnt FROM cm WHERE c >= 3 AND id IN (SELECT id FROM d, (SELECT qb[1:3] AS three FROM (SELECT list_sort(qb) AS qb FROM q)) WHERE len(list_intersect(bits, three)) = 3)")
def contains_bits(spark, sf):
    """Rows of a stored library that have all of a query's bits: the filter before a substructure test."""
    low = sorted({64 * k + j for k, w in enumerate(text_words(QUERY_TEXT)) for j in range(64) if w >> j & 1})[:3]
    words = [0] * 32
    for bit in low:
        words[bit // 64] |= 1 << (bit % 64)
    found = K.superset_search(_stored(spark, sf), [w - (1 << 64) if w >> 63 else w for w in words])
    return found.select("id", F.col("popcnt").cast("bigint").alias("popcnt"))


def _sliced(spark, sf):
    """The documents' fingerprints stored bit by bit."""
    path = scratch_path(spark, "sliced")
    L.write_sliced(T.document_bits(spark, sf), path)
    return path


@query("k19_sliced_threshold", f"{_ONE} SELECT id, score FROM sc WHERE score >= 0.05")
def sliced_threshold(spark, sf):
    """Threshold search that reads only the columns of the query's bits."""
    return L.threshold_sliced(spark, _sliced(spark, sf), text_words(QUERY_TEXT), 0.05)


@query("k19_sliced_topk", f"{_ONE} SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 25")
def sliced_topk(spark, sf):
    return L.topk_sliced(spark, _sliced(spark, sf), text_words(QUERY_TEXT), 25)


@query("k02_topk_search", f"{_ONE} SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 25")
def topk_search(spark, sf):
    return K.topk_search(T.document_bits(spark, sf), text_words(QUERY_TEXT), 25)


@query("k03_parallel_threshold_counts", f"{_SCORED} SELECT query_id, count(*) AS hits, max(score) AS best FROM sc WHERE score >= 0.2 GROUP BY 1")
def parallel_threshold_counts(spark, sf):
    hits = K.multi_threshold_search(written(T.document_bits(spark, sf), "documents"), T.benchmark_bits(spark, sf), 0.2)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"))


@query("j09_cluster_search", f"{_SCORED} SELECT query_id, id, score FROM sc WHERE score >= 0.2")
def cluster_search(spark, sf):
    """Exact search that skips clusters by the triangle bound."""
    return ClusterIndex(T.document_bits(spark, sf)).search(T.benchmark_bits(spark, sf), 0.2)


_SPHERES = _SIGN.replace("WITH", "WITH RECURSIVE", 1) + """, nb AS (SELECT x.id, y.id AS o FROM w x JOIN w y ON x.n > 0 AND y.n > 0 AND bit_count(x.u & y.u)::DOUBLE / (x.n + y.n - bit_count(x.u & y.u)) >= 0.4),
 sz AS (SELECT w.id, count(nb.o) AS size, list(nb.o) FILTER (WHERE nb.o IS NOT NULL) AS near FROM w LEFT JOIN nb ON nb.id = w.id GROUP BY w.id),
 o AS (SELECT *, row_number() OVER (ORDER BY size DESC, id) AS pos FROM sz),
 r AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS leaders UNION ALL
   SELECT o.pos, CASE WHEN list_has_any(r.leaders, o.near) THEN r.leaders ELSE list_append(r.leaders, o.id) END FROM r JOIN o ON o.pos = r.pos + 1),
 led AS (SELECT o.id AS leader, o.pos FROM o JOIN (SELECT unnest(leaders) AS id FROM r WHERE pos = (SELECT max(pos) FROM r)) USING (id))
 SELECT o.id, coalesce(arg_min(led.leader, led.pos), o.id) AS leader, greatest(o.size - 1, 0) AS neighbours FROM o LEFT JOIN nb ON nb.id = o.id LEFT JOIN led ON led.leader = nb.o GROUP BY o.id, o.size"""


@query("j09_sphere_exclusion", _SPHERES)
def sphere_clusters(spark, sf):
    """Every vector with the leader of its cluster."""
    return sphere_exclusion(written(T.sign_bits(spark, sf), "signs"), 0.4)


@query("k04_sorted_by_popcount", f"{_DOCS} SELECT id, n AS popcnt, row_number() OVER (ORDER BY n, id) - 1 AS position FROM d")
def sorted_by_popcount(spark, sf):
    """Position of each row in popcount order, from per-popcount offsets."""
    from ..operators.ordering import dense_positions

    d = T.document_bits(spark, sf).select("id", F.col("popcnt").cast("bigint").alias("popcnt"))
    return dense_positions(d, ["popcnt", "id"], "position")


@query("k05_count_range", f"{_DOCS} SELECT id, n AS popcnt FROM d WHERE n BETWEEN 100 AND 400")
def count_range(spark, sf):
    return K.count_range(T.document_bits(spark, sf), 100, 400).select("id", F.col("popcnt").cast("bigint").alias("popcnt"))


@query("k07_multi_query_topk", f"""{_BOTH}, one AS (SELECT id, n, unnest(bits) AS b FROM d), qone AS (SELECT query_id, unnest(qb) AS b FROM q),
 cm AS (SELECT query_id, id, count(*) AS c FROM one JOIN qone USING (b) GROUP BY ALL),
 sc AS (SELECT q.query_id, d.id, coalesce(c, 0)::DOUBLE / (qn + n - coalesce(c, 0)) AS score FROM q CROSS JOIN d LEFT JOIN cm ON cm.query_id = q.query_id AND cm.id = d.id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) SELECT query_id, id, score, rank::INT AS rank FROM rk WHERE rank <= 5""")
def multi_query_topk(spark, sf):
    # read for its popcounts and for its blocks, so store it first
    return K.multi_topk_search(written(T.document_bits(spark, sf), "documents"), T.benchmark_bits(spark, sf), 5)


@query("k15_sign_bit_topk", f"""{_SIGN}, sc AS (SELECT x.id AS query_id, y.id, len(list_intersect(x.bits, y.bits))::DOUBLE / (x.n + y.n - len(list_intersect(x.bits, y.bits))) AS score FROM w x JOIN w y ON x.id <> y.id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) SELECT query_id, id, score, rank::INT AS rank FROM rk WHERE rank <= 4""")
def sign_bit_topk(spark, sf):
    """Nearest neighbours of every vector among all others."""
    d = T.sign_bits(spark, sf)
    hits = K.multi_topk_search(d, d, 5)
    others = hits.where("query_id <> id")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return others.withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("query_id", "id", "score", "rank")


@query("j01_similarity_matrix", f"""{_SIGN} SELECT x.id AS query_id, y.id, CASE WHEN x.n + y.n = 0 THEN 0 ELSE bit_count(x.u & y.u)::DOUBLE / (x.n + y.n - bit_count(x.u & y.u)) END AS score FROM w x, w y WHERE x.n + y.n > 0 AND bit_count(x.u & y.u)::DOUBLE / (x.n + y.n - bit_count(x.u & y.u)) >= 0.5""")
def similarity_matrix(spark, sf):
    """The entries of the matrix from 0.5 on."""
    d = T.sign_bits(spark, sf)
    return K.multi_threshold_search(d, d, 0.5)


@query("j02_query_database_matrix", f"""{_BOTH}, one AS (SELECT id, n, unnest(bits) AS b FROM d), qone AS (SELECT query_id, unnest(qb) AS b FROM q),
 cm AS (SELECT query_id, id, count(*) AS c FROM one JOIN qone USING (b) GROUP BY ALL)
 SELECT q.query_id, d.id, round(CAST(coalesce(c, 0)::FLOAT / (qn + n - coalesce(c, 0))::FLOAT AS DOUBLE), 6) AS score FROM q CROSS JOIN d LEFT JOIN cm ON cm.query_id = q.query_id AND cm.id = d.id WHERE coalesce(c, 0)::DOUBLE / (qn + n - coalesce(c, 0)) >= 0.1""")
def query_database_matrix(spark, sf):
    """The entries of the matrix from 0.1 on."""
    m = K.multi_threshold_search(written(T.document_bits(spark, sf), "documents"), T.benchmark_bits(spark, sf), 0.1)
    return m.select("query_id", "id", F.round(F.col("score").cast("float").cast("double"), 6).alias("score"))


_PAIRS = """, u AS (SELECT list_sort(bits) AS bits, min(id) AS id, count(*) AS copies, len(any_value(bits)) AS n FROM d WHERE n > 0 GROUP BY list_sort(bits)),
 one AS (SELECT id, n, unnest(bits) AS b FROM u), cm AS (SELECT x.id AS id_a, y.id AS id_b, x.n AS xn, y.n AS yn, count(*) AS c FROM one x JOIN one y ON x.b = y.b AND x.id < y.id
   AND x.n >= {t} * y.n AND y.n >= {t} * x.n GROUP BY ALL),
 hits AS (SELECT id_a, id_b, c::DOUBLE / (xn + yn - c) AS score FROM cm WHERE c::DOUBLE / (xn + yn - c) >= {t})"""


@query("j03_pruned_all_pairs", f"{_DOCS}{_PAIRS.format(t=0.8)} SELECT id_a, id_b, score, x.copies AS copies_a, y.copies AS copies_b FROM hits JOIN u x ON x.id = id_a JOIN u y ON y.id = id_b")
def pruned_all_pairs(spark, sf):
    return K.all_pairs(T.document_bits(spark, sf), 0.8)


@query("j03_neighbour_counts", f"""{_DOCS}{_PAIRS.format(t=0.8)}, nb AS (SELECT id_a AS id, y.copies AS k FROM hits JOIN u y ON y.id = id_b UNION ALL SELECT id_b, x.copies FROM hits JOIN u x ON x.id = id_a),
 per AS (SELECT u.bits, u.copies - 1 + coalesce(sum(k), 0) AS k FROM u LEFT JOIN nb ON nb.id = u.id GROUP BY u.bits, u.copies)
 SELECT d.id, CAST(coalesce(k, 0) AS BIGINT) AS neighbours FROM d LEFT JOIN per ON per.bits = list_sort(d.bits)""")
def neighbour_counts(spark, sf):
    return K.neighbour_counts(T.document_bits(spark, sf), 0.8)


@query("j04_inverted_index", f"{_SCORED} SELECT query_id, id, c AS common, score FROM sc")
def inverted_index(spark, sf):
    return K.sparse_matrix(T.document_bits(spark, sf), T.benchmark_bits(spark, sf))
