"""DuckDB SQL that computes the same rows in other ways."""

from __future__ import annotations

from .secrets import ALLOWED, ASSIGN, CLASSES, ORDINARY, SEPARATORS, WINDOW, char_cost, most_cost

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Windows of each width are compared with every window of the same width in a document.
DECONTAMINATION = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS t
  FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(s) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, s, width, array_to_string(w[s : s + width - 1], ' ') AS t
  FROM d, (SELECT DISTINCT width FROM iw), unnest(range(1, len(w) - width + 2)) AS r(s)),
hit AS (SELECT doc_id, s, dw.width, item FROM dw JOIN iw USING (width, t)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(s, s + width)) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: Every query against every row.
TOP_PRODUCTS = """
WITH e AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding])),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(pattern: str) -> str:
    """(doc_id, s, e, m): matches of a pattern with their places."""
    fence = "chr(1)"
    cut = f"string_split(regexp_replace(replace(coalesce(text, ''), {fence}, chr(2)), {_quoted(f'({pattern})')}, {fence} || '\\1' || {fence}, 'g'), {fence})"
    return f"""
    SELECT doc_id, e - length(m) AS s, e, m FROM (
      SELECT doc_id, k, p[k] AS m, sum(length(p[k])) OVER (PARTITION BY doc_id ORDER BY k) AS e
      FROM (SELECT doc_id, {cut} AS p FROM documents), unnest(range(1, len(p) + 1)) AS r(k)) WHERE k % 2 = 0"""


def _dense(kind) -> str:
    """Every window of every run counted from scratch."""
    costs = "[" + ", ".join(map(str, char_cost(WINDOW))) + "]"
    return f"""
    SELECT doc_id, s + min(w) AS s, s + max(w) + {WINDOW} AS e FROM (
      SELECT doc_id, s, w, sum(cost) AS cost FROM (
        SELECT doc_id, s, w, c, {costs}[count(*) + 1] AS cost
        FROM ({_spans(f'{kind.pattern}{{{WINDOW},}}')}) AS runs, unnest(range(0, length(m) - {WINDOW} + 1)) AS r(w), unnest(string_split(substring(m, CAST(w AS INTEGER) + 1, {WINDOW}), '')) AS u(c)
        WHERE NOT regexp_full_match(m, {_quoted('|'.join(ALLOWED))})
          AND len(list_filter(regexp_split_to_array(m, '{SEPARATORS}'), lambda part: NOT regexp_full_match(part, {_quoted('|'.join(ORDINARY))}))) > 0
        GROUP BY doc_id, s, w, c) GROUP BY doc_id, s, w)
    WHERE cost <= {most_cost(WINDOW, kind.threshold)} GROUP BY doc_id, s"""


def _secrets() -> str:
    kinds = [
        f"SELECT doc_id, 0 AS rank, 'assign' AS kind, s, e FROM ({_spans(ASSIGN)}) WHERE length(regexp_extract(m, {_quoted(ASSIGN)}, 2)) >= 12",
        f"SELECT doc_id, 1, 'access', s, e FROM ({_spans('AKIA[A-Z0-9]+')}) WHERE e - s >= 18",
        f"SELECT doc_id, 2, 'hex', s, e FROM ({_spans('[0-9a-f]{16,}')}) WHERE e - s >= 16",
    ]
    kinds += [f"SELECT doc_id, {3 + k}, '{c.kind}', s, e FROM ({_dense(c)})" for k, c in enumerate(CLASSES)]
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""
    WITH f AS ({' UNION ALL '.join(kinds)}),
    g AS (
      SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg({one}, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg({one}, ',' ORDER BY s, rank) AS spans
      FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN g USING (doc_id)"""


SECRETS = _secrets()


#: CRC-32 by its table, made by rule; near words through deletions, told apart
#: by the edit distance of words whose Latin-1 letters are written as ASCII signs.
SPELLING = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab
  FROM range(256) AS r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS hex FROM low WHERE length(w) >= 6),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || substr(hex, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(hex) // 2)]),
    lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))) AS h FROM bytes, crc),
n AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
variant AS (SELECT word, word AS v FROM n UNION SELECT word, substr(word, 1, i) || substr(word, i + 2) FROM n, unnest(range(length(word))) AS r(i)),
met AS (SELECT DISTINCT a.word, b.word AS other FROM variant a JOIN variant b USING (v) WHERE a.word <> b.word),
near AS (
  SELECT * FROM met
  WHERE levenshtein(translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', SIGNS), translate(other, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', SIGNS)) = 1),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, {'a': -m.n, 'b': other}) AS other, max(m.n) AS most
  FROM near JOIN n AS m ON m.word = other GROUP BY near.word),
formed AS (
  SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n.n THEN other END AS form, CASE WHEN most >= 5 * n.n THEN most END AS form_n
  FROM n LEFT JOIN best USING (word)),
chain(word, reached) AS (SELECT word, word FROM n UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.n, n_near, form, form_n, reached AS root
FROM formed f JOIN (SELECT chain.word, arg_max(reached, m.n) AS reached FROM chain JOIN n AS m ON m.word = reached GROUP BY chain.word) USING (word)
""".replace("SIGNS", "'" + "".join(map(chr, range(33, 97))).replace("'", "''") + "'")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SMALL = "translate(unnest(regexp_extract_all(text, '{}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format(TERM)

#: Every document scored for every item.
RANKED_SEARCH = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {SMALL} AS term FROM documents) GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM d),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, N),
q AS (SELECT item_id, {SMALL} AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * d.n * total.N) // L)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
