"""Queries over composed molecules: parsing, graphs, descriptors, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import bitsearch as A
from ..functions import descriptors as D
from ..functions import elements as E
from ..functions import graph as G
from ..functions import morgan as M
from ..functions import text as X
from ..functions.columnar import with_molecule
from ..operators import search as K
from . import tables as T
from .pieces import graph_cte, smiles_cte
from .registry import query

_G = "WITH " + graph_cte()
_GR = "WITH RECURSIVE " + graph_cte()
_S = "WITH " + smiles_cte()

# ---------------------------------------------------------------- parsing


@query("p01_parse_atoms", f"{_G} SELECT mol_id, idx, z, charge, num_h, isotope, aromatic, in_ring, explicit_h, chirality FROM atoms", ints=("idx", "num_h",))
def parse_atoms(spark, sf):
    return G.explode_atoms(T.molecules(spark, sf), "mol_id")


@query("p01_parse_bonds", f"{_G} SELECT mol_id, a, b, ord AS bond_order, ring AS in_ring FROM bonds", ints=("a", "b",))
def parse_bonds(spark, sf):
    return G.explode_bonds(T.molecules(spark, sf), "mol_id").drop("bond_idx")


_ERRORS = f"""{_S} SELECT mol_id, smiles,
  CASE mol_id % 50 WHEN 9 THEN 'unclosed ''(''' WHEN 19 THEN 'unmatched '')''' WHEN 29 THEN 'unexpected character ''X'''
    WHEN 39 THEN 'expected '']''' ELSE 'unclosed ring bond' END AS message,
  length(smiles) - CASE WHEN mol_id % 50 = 29 THEN 1 ELSE 0 END AS position
FROM smi WHERE broken"""


@query("p01_parse_errors", _ERRORS, ints=("position",))
def parse_errors(spark, sf):
    return T.molecules(spark, sf).where("error IS NOT NULL").select("mol_id", "smiles", "error.message", "error.position")


@query("p02_bracket_atoms", f"{_G} SELECT mol_id, idx, z, charge, num_h, isotope, chirality FROM atoms WHERE explicit_h", ints=("idx", "num_h",))
def bracket_atoms(spark, sf):
    atoms = G.explode_atoms(T.molecules(spark, sf), "mol_id")
    return atoms.where("explicit_h").select("mol_id", "idx", "z", "charge", "num_h", "isotope", "chirality")


@query("p03_ring_closures", f"""{_G} SELECT mol_id, a, b, ord AS bond_order FROM bonds
  WHERE (mol_id, b) IN (SELECT mol_id, b FROM bonds GROUP BY ALL HAVING count(*) > 1)
    AND (mol_id, a, b) NOT IN (SELECT mol_id, max(a), b FROM bonds GROUP BY mol_id, b)""", ints=("a", "b",))
def ring_closures(spark, sf):
    """Closing bonds: the extra bonds to an atom that already has a predecessor."""
    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    closing = F.expr("filter(mol.bonds, x -> exists(mol.bonds, y -> y.b = x.b AND y.a > x.a))")
    return m.select("mol_id", F.explode(closing).alias("bond")).select("mol_id", "bond.a", "bond.b", "bond.bond_order")


@query("p04_implicit_hydrogens", f"""{_G} SELECT mol_id, CAST(sum(num_h) AS BIGINT) AS implicit_h, count(*) AS atoms
  FROM atoms WHERE NOT explicit_h GROUP BY mol_id""")
def implicit_hydrogens(spark, sf):
    atoms = G.explode_atoms(T.molecules(spark, sf), "mol_id").where("NOT explicit_h")
    return atoms.groupBy("mol_id").agg(F.sum("num_h").alias("implicit_h"), F.count(F.lit(1)).alias("atoms"))


@query("p05_ring_membership", f"""{_G} SELECT a.mol_id, n_ring_atoms, coalesce(n_ring_bonds, 0) AS n_ring_bonds FROM
  (SELECT mol_id, count(*) FILTER (in_ring) AS n_ring_atoms FROM atoms GROUP BY mol_id) a
  LEFT JOIN (SELECT mol_id, count(*) FILTER (ring) AS n_ring_bonds FROM bonds GROUP BY mol_id) b ON a.mol_id = b.mol_id""")
def ring_membership(spark, sf):
    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    return m.select(
        "mol_id",
        F.expr("cast(size(filter(mol.atoms, a -> a.in_ring)) as bigint)").alias("n_ring_atoms"),
        F.expr("cast(size(filter(mol.bonds, b -> b.in_ring)) as bigint)").alias("n_ring_bonds"),
    )


_TOK = r"\[[^\]]*\]|\[.*|Cl|Br|[BCNOPSFIbcnops]|[-=#$:/\\]|%[0-9]*|."
_TOKENS = f"""{_S}, toks AS (SELECT mol_id, smiles, regexp_extract_all(smiles, '{_TOK}') AS ts FROM smi),
 tok AS (SELECT mol_id, unnest(ts) AS text, unnest(range(len(ts))) AS pos FROM toks),
 kinds AS (SELECT *, CASE WHEN text LIKE '[%]' OR regexp_full_match(text, 'Cl|Br|[BCNOPSFIbcnops]') THEN 'Atom'
   WHEN text IN ('-','=','#','$',':','/','\\') THEN 'Bond' WHEN regexp_full_match(text, '%[0-9]*|[0-9]') THEN 'RingBond'
   WHEN text = '(' THEN 'BranchOpen' WHEN text = ')' THEN 'BranchClose' WHEN text = '.' THEN 'Dot' ELSE 'Unknown' END AS kind FROM tok)"""


@query("p06_tokenize", f"{_TOKENS} SELECT mol_id, CAST(pos AS INT) AS pos, kind, text FROM kinds")
def tokenize(spark, sf):
    s = T.smiles_rows(spark, sf)
    return s.select("mol_id", F.posexplode(X.tokenize("smiles")).alias("pos", "t")).select("mol_id", "pos", "t.kind", "t.text")


_CHARS = f"""{_S}, ch AS (SELECT mol_id, smiles, unnest(string_split(smiles, '')) AS c, unnest(range(length(smiles))) AS i FROM smi),
 sums AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS p,
   sum(CASE c WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w AS q FROM ch WINDOW w AS (PARTITION BY mol_id ORDER BY i))"""


@query("p07_brackets_balanced", f"""{_CHARS} SELECT mol_id, min(p) >= 0 AND min(q) >= 0 AND arg_max(p, i) = 0 AND arg_max(q, i) = 0 AS balanced
  FROM sums GROUP BY mol_id""")
def brackets_balanced(spark, sf):
    return T.smiles_rows(spark, sf).select("mol_id", X.brackets_balanced("smiles").alias("balanced"))


@query("p08_heavy_atoms_from_text", f"""{_CHARS} SELECT mol_id, count(*) FILTER (c = '[' OR (q = 0 AND contains('BCNOPSFIbcnops', c))) AS heavy
  FROM sums GROUP BY mol_id""")
def heavy_atoms_from_text(spark, sf):
    return T.smiles_rows(spark, sf).select("mol_id", X.count_heavy_atoms("smiles").cast("bigint").alias("heavy"))


@query("p09_branch_depth", f"{_CHARS} SELECT mol_id, CAST(greatest(max(p), 0) AS BIGINT) AS depth FROM sums GROUP BY mol_id")
def branch_depth(spark, sf):
    return T.smiles_rows(spark, sf).select("mol_id", X.max_branch_depth("smiles").cast("bigint").alias("depth"))


@query("p10_aromatic_letters", f"{_CHARS} SELECT mol_id, count(*) FILTER (q = 0 AND contains('bcnops', c)) AS aromatic FROM sums GROUP BY mol_id")
def aromatic_letters(spark, sf):
    return T.smiles_rows(spark, sf).select("mol_id", X.count_aromatic("smiles").cast("bigint").alias("aromatic"))


@query("p11_ring_digits_and_length", f"""{_CHARS} SELECT mol_id, count(*) AS len, count(*) FILTER (c BETWEEN '1' AND '9') // 2 AS rings
  FROM sums GROUP BY mol_id""")
def ring_digits(spark, sf):
    return T.smiles_rows(spark, sf).select(
        "mol_id", F.length("smiles").cast("bigint").alias("len"), X.ring_digit_pairs("smiles").cast("bigint").alias("rings")
    )


_ELEMENTS = "el(z, symbol, weight, valence) AS (VALUES (6,'C',12.011,4),(7,'N',14.007,3),(8,'O',15.999,2),(9,'F',18.998,1),(11,'Na',22.990,0),(16,'S',32.06,2),(17,'Cl',35.45,1),(35,'Br',79.904,1))"


@query("p12_element_lookup", f"""{_G}, {_ELEMENTS} SELECT a.z, symbol, round(CAST(weight AS DOUBLE), 4) AS weight, valence, count(*) AS n_atoms
  FROM atoms a JOIN el ON a.z = el.z GROUP BY ALL""")
def element_lookup(spark, sf):
    atoms = G.explode_atoms(T.molecules(spark, sf), "mol_id").groupBy("z").agg(F.count(F.lit(1)).alias("n_atoms"))
    el = E.element_table(spark).select("z", "symbol", "weight", "valence")
    return atoms.join(F.broadcast(el), "z").select("z", "symbol", "weight", "valence", "n_atoms")


@query("p12_element_functions", f"""{_G}, {_ELEMENTS} SELECT DISTINCT a.z, symbol, CAST(weight AS DOUBLE) AS weight, valence,
  a.z <> 11 AS organic, a.z AS number FROM atoms a JOIN el ON a.z = el.z""")
def element_functions(spark, sf):
    z = G.explode_atoms(T.molecules(spark, sf), "mol_id").select("z").distinct()
    return z.select(
        "z", E.symbol(F.col("z")).alias("symbol"), E.weight(F.col("z")).alias("weight"),
        E.default_valence(F.col("z")).alias("valence"), E.is_organic_subset(F.col("z")).alias("organic"),
        E.number(E.symbol(F.col("z"))).alias("number"),
    )


@query("p13_letter_atomic_number", f"""{_CHARS} SELECT c AS letter, CASE upper(c) WHEN 'C' THEN 6 WHEN 'N' THEN 7 WHEN 'O' THEN 8
  WHEN 'S' THEN 16 WHEN 'P' THEN 15 WHEN 'B' THEN 5 ELSE CASE c WHEN 'F' THEN 9 WHEN 'I' THEN 53 ELSE 0 END END AS z, count(*) AS n
  FROM sums GROUP BY ALL""")
def letter_atomic_number(spark, sf):
    letters = T.smiles_rows(spark, sf).select(F.explode(F.split("smiles", "")).alias("letter"))
    return letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).withColumn("z", X.letter_atomic_number("letter"))


_CHECK = f"""{_CHARS}, flagged AS (SELECT *, q > 0 OR c = ']' AS inside FROM sums),
 outer_p AS (SELECT *, sum(CASE WHEN inside THEN 0 WHEN c = '(' THEN 1 WHEN c = ')' THEN -1 ELSE 0 END) OVER (PARTITION BY mol_id ORDER BY i) AS d FROM flagged),
 per AS (SELECT mol_id, any_value(smiles) AS smiles,
   min(i) FILTER (NOT inside AND d < 0) AS extra, min(i) FILTER (NOT inside AND NOT contains('()123456789BCNOPSFIHbcnops-=#$:/\\.@+', c)) AS bad,
   arg_max(d, i) AS depth, arg_max(q, i) AS q, count(*) FILTER (c = ']' OR (NOT inside AND contains('BCNOPSFIHbcnops', c))) AS atoms,
   count(*) FILTER (NOT inside AND c BETWEEN '1' AND '9') // 2 AS ring_bonds, count(*) FILTER (NOT inside AND c = '(') AS branches FROM outer_p GROUP BY mol_id),
 graded AS (SELECT *, CASE WHEN least(coalesce(extra, 999), coalesce(bad, 999)) < 999 THEN CASE WHEN coalesce(extra, 999) < coalesce(bad, 999) THEN 'UnbalancedParen' ELSE 'InvalidCharacter' END
   WHEN depth <> 0 THEN 'UnbalancedParen' WHEN q <> 0 THEN 'UnbalancedBracket' END AS kind FROM per)
 SELECT mol_id, kind, CASE WHEN kind IS NULL THEN NULL WHEN least(coalesce(extra, 999), coalesce(bad, 999)) < 999 THEN least(coalesce(extra, 999), coalesce(bad, 999)) ELSE length(smiles) END AS position,
   CASE WHEN kind IS NULL THEN NULL WHEN kind = 'InvalidCharacter' THEN substr(smiles, bad + 1, 1) WHEN extra IS NOT NULL THEN 'extra '')'''
     WHEN kind = 'UnbalancedParen' THEN CAST(CAST(depth AS INT) AS VARCHAR) || ' unclosed' ELSE 'unclosed ''[''' END AS detail,
   CASE WHEN kind IS NULL THEN atoms END AS atoms, CASE WHEN kind IS NULL THEN ring_bonds END AS ring_bonds, CASE WHEN kind IS NULL THEN branches END AS branches FROM graded"""


@query("p14_check_smiles", _CHECK, ints=("position", "atoms", "ring_bonds", "branches",))
def check_smiles(spark, sf):
    s = T.smiles_rows(spark, sf).withColumn("r", X.check_smiles("smiles"))
    return s.select("mol_id", "r.error.kind", "r.error.position", "r.error.detail", "r.atoms", "r.ring_bonds", "r.branches")


@query("p15_parse_batch", f"""{_S} SELECT broken AS failed, count(*) AS n, min(smiles) AS first_smiles FROM smi GROUP BY broken""")
def parse_batch(spark, sf):
    failed = F.col("error").isNotNull().alias("failed")
    return T.molecules(spark, sf).groupBy(failed).agg(F.count(F.lit(1)).alias("n"), F.min("smiles").alias("first_smiles"))


@query("p16_describe_tree", f"""{_TOKENS} SELECT mol_id, 'Branch(' || string_agg(CASE kind WHEN 'Atom' THEN 'Atom(' || text || ') '
  WHEN 'BranchOpen' THEN 'Branch(' WHEN 'BranchClose' THEN ') ' ELSE '' END, '' ORDER BY pos) || ')' AS tree,
  count(*) FILTER (kind = 'Atom') AS n_atoms FROM kinds GROUP BY mol_id""")
def describe_tree(spark, sf):
    return T.smiles_rows(spark, sf).select(
        "mol_id", X.describe_tree("smiles").alias("tree"), X.tree_atom_count("smiles").cast("bigint").alias("n_atoms")
    )


# ---------------------------------------------------------------- graphs

_WALK = """ walk(mol_id, s, idx, d) AS (SELECT mol_id, idx, idx, 0 FROM atoms {where}
   UNION SELECT w.mol_id, w.s, e.nbr, w.d + 1 FROM walk w JOIN ends e ON e.mol_id = w.mol_id AND e.idx = w.idx WHERE w.d < 24),
 dist AS (SELECT mol_id, s, idx, min(d) AS d FROM walk GROUP BY ALL)"""
_REACH = """ reach(mol_id, s, idx) AS (SELECT mol_id, idx, idx FROM atoms
   UNION SELECT w.mol_id, w.s, e.nbr FROM reach w JOIN ends e ON e.mol_id = w.mol_id AND e.idx = w.idx),
 label AS (SELECT mol_id, s AS idx, min(idx) AS root FROM reach GROUP BY ALL)"""


@query("g01_shortest_paths", f"{_GR}, {_WALK.format(where='WHERE idx = 0')} SELECT a.mol_id, a.idx, CAST(coalesce(d, -1) AS INT) AS dist FROM atoms a LEFT JOIN dist ON dist.mol_id = a.mol_id AND dist.idx = a.idx", ints=("idx",))
def shortest_paths(spark, sf):
    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    return m.select("mol_id", F.posexplode(G.shortest_paths_from("mol", 0)).alias("idx", "dist"))


@query("g02_distance_matrix", f"""{_GR}, {_WALK.format(where='')} SELECT mol_id, s AS i, list(d ORDER BY idx) AS distances FROM
  (SELECT a.mol_id, a.idx AS s, b.idx, CAST(coalesce(d, -1) AS INT) AS d FROM atoms a JOIN atoms b ON a.mol_id = b.mol_id
   LEFT JOIN dist ON dist.mol_id = a.mol_id AND dist.s = a.idx AND dist.idx = b.idx) GROUP BY ALL""", arrays=("distances",), ints=("i",))
def distance_matrix(spark, sf):
    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    return m.select("mol_id", F.posexplode(G.distance_matrix("mol")).alias("i", "distances"))


@query("g03_graph_diameter", f"{_GR}, {_WALK.format(where='')} SELECT mol_id, max(d) AS diameter FROM dist GROUP BY mol_id")
def graph_diameter(spark, sf):
    return T.molecules(spark, sf).where("mol IS NOT NULL").select("mol_id", G.graph_diameter("mol").alias("diameter"))


@query("g04_connected_components", f"{_GR}, {_REACH} SELECT mol_id, idx, CAST(dense_rank() OVER (PARTITION BY mol_id ORDER BY root) - 1 AS INT) AS component FROM label", ints=("idx",))
def connected_components(spark, sf):
    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    return m.select("mol_id", F.posexplode(G.connected_components("mol")).alias("idx", "component"))


@query("g05_num_components", f"{_GR}, {_REACH} SELECT mol_id, count(DISTINCT root) AS components FROM label GROUP BY mol_id")
def num_components(spark, sf):
    return T.molecules(spark, sf).where("mol IS NOT NULL").select("mol_id", G.num_components("mol").cast("bigint").alias("components"))


_RINGS = """(SELECT x.mol_id, coalesce(nb, 0) - na + nc AS n_rings FROM (SELECT mol_id, count(*) AS na FROM atoms GROUP BY 1) x
  JOIN (SELECT mol_id, count(DISTINCT root) AS nc FROM label GROUP BY 1) y ON x.mol_id = y.mol_id
  LEFT JOIN (SELECT mol_id, count(*) AS nb FROM bonds GROUP BY 1) w ON x.mol_id = w.mol_id)"""


@query("g06_ring_count", f"{_GR}, {_REACH} SELECT mol_id, n_rings FROM {_RINGS}")
def ring_count(spark, sf):
    return T.molecules(spark, sf).where("mol IS NOT NULL").select("mol_id", G.ring_count("mol").cast("bigint").alias("n_rings"))


@query("g07_smallest_ring_size", f"""{_GR}, rb AS (SELECT mol_id, a, b FROM bonds WHERE ring),
 turn(mol_id, a, b, idx, d) AS (SELECT mol_id, a, b, a, 0 FROM rb UNION SELECT t.mol_id, t.a, t.b, e.nbr, t.d + 1 FROM turn t
   JOIN ends e ON e.mol_id = t.mol_id AND e.idx = t.idx AND NOT (t.idx = t.a AND e.nbr = t.b) AND NOT (t.idx = t.b AND e.nbr = t.a) AND e.ring WHERE t.d < 10),
 cyc AS (SELECT mol_id, a, b, min(d) + 1 AS n FROM turn WHERE idx = b GROUP BY ALL),
 ring_at AS (SELECT mol_id, a AS idx, n FROM cyc UNION ALL SELECT mol_id, b, n FROM cyc)
 SELECT a.mol_id, a.idx, CAST(coalesce(min(n), 0) AS INT) AS ring_size FROM atoms a LEFT JOIN ring_at ON ring_at.mol_id = a.mol_id AND ring_at.idx = a.idx GROUP BY ALL""", ints=("idx",))
def smallest_ring_size(spark, sf):
    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    return m.select("mol_id", F.posexplode(G.smallest_ring_size("mol")).alias("idx", "ring_size"))


_DEG = """ hd AS (SELECT a.mol_id, a.idx, count(y.z) AS degree, count(*) FILTER (y.z > 1) AS heavy_degree FROM atoms a
   LEFT JOIN ends e ON e.mol_id = a.mol_id AND e.idx = a.idx LEFT JOIN atoms y ON y.mol_id = e.mol_id AND y.idx = e.nbr GROUP BY ALL)"""


@query("g08_degrees", f"{_G}, {_DEG} SELECT mol_id, idx, degree, heavy_degree FROM hd", ints=("idx",))
def degrees(spark, sf):
    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    both = F.arrays_zip(G.degrees("mol").alias("degree"), G.heavy_degrees("mol").alias("heavy_degree"))
    rows = m.select("mol_id", F.posexplode(both).alias("idx", "d"))
    return rows.select("mol_id", "idx", F.col("d.degree").cast("bigint").alias("degree"), F.col("d.heavy_degree").cast("bigint").alias("heavy_degree"))


@query("g09_checked_bonds", f"""{_G}, n AS (SELECT mol_id, count(*) AS n FROM atoms GROUP BY 1),
 given AS (SELECT b.mol_id, a, CASE WHEN b.mol_id % 5 = 0 THEN b + 4 WHEN b.mol_id % 5 = 1 THEN a ELSE b END AS b FROM bonds b)
 SELECT g.mol_id, a, b, CASE WHEN a >= n OR b >= n THEN 'atom index out of range' WHEN a = b THEN 'bond to itself' END AS problem FROM given g JOIN n ON n.mol_id = g.mol_id""", ints=("a", "b",))
def checked_bonds(spark, sf):
    """The builder's rules for a new bond, applied to shifted bonds."""
    m = T.molecules(spark, sf).where("mol IS NOT NULL").select("mol_id", F.size("mol.atoms").alias("n"), F.explode("mol.bonds").alias("e"))
    b = F.when(F.col("mol_id") % 5 == 0, F.col("e.b") + 4).when(F.col("mol_id") % 5 == 1, F.col("e.a")).otherwise(F.col("e.b"))
    given = m.select("mol_id", "n", F.col("e.a").alias("a"), b.alias("b"))
    problem = F.when((F.col("a") >= F.col("n")) | (F.col("b") >= F.col("n")), "atom index out of range").when(F.col("a") == F.col("b"), "bond to itself")
    return given.select("mol_id", "a", "b", problem.alias("problem"))


@query("g10_describe", f"""{_G}, {_ELEMENTS}, {_DEG},
 al AS (SELECT a.mol_id, string_agg(printf('[%d] %s H%d q%s%d%s%s deg=%d', a.idx, symbol, num_h, CASE WHEN charge < 0 THEN '-' ELSE '+' END, abs(charge), CASE WHEN aromatic THEN ' arom' ELSE '' END,
   CASE WHEN in_ring THEN ' ring' ELSE '' END, degree), chr(10) ORDER BY a.idx) AS t FROM atoms a JOIN el ON el.z = a.z JOIN hd ON hd.mol_id = a.mol_id AND hd.idx = a.idx GROUP BY 1),
 bl AS (SELECT mol_id, string_agg(a || CASE ord WHEN 1 THEN '-' WHEN 2 THEN '=' WHEN 3 THEN '#' ELSE ':' END || b || CASE WHEN ring THEN ' (ring)' ELSE '' END, chr(10) ORDER BY b, a DESC) AS t FROM bonds GROUP BY 1)
 SELECT s.mol_id, smiles || chr(10) || CASE WHEN broken THEN 'PARSE ERROR: ' || CASE s.mol_id % 50 WHEN 9 THEN 'unclosed ''(''' WHEN 19 THEN 'unmatched '')''' WHEN 29 THEN 'unexpected character ''X'''
    WHEN 39 THEN 'expected '']''' ELSE 'unclosed ring bond' END || ' at ' || (length(smiles) - CASE WHEN s.mol_id % 50 = 29 THEN 1 ELSE 0 END)
   ELSE al.t || coalesce(chr(10) || bl.t, '') END AS listing FROM smi s LEFT JOIN al ON al.mol_id = s.mol_id LEFT JOIN bl ON bl.mol_id = s.mol_id""")
def describe(spark, sf):
    return T.molecules(spark, sf).select("mol_id", G.describe("mol", "error", "smiles").alias("listing"))


# ---------------------------------------------------------------- descriptors

_PER_ATOM = f""" {_ELEMENTS}, nb AS (
  SELECT a.mol_id, a.idx, count(*) FILTER (e.ord = 2) AS dbl, count(*) FILTER (e.ord = 3) AS tri, count(*) FILTER (e.ord = 5) AS aro,
    count(*) FILTER (y.z NOT IN (1, 6)) AS het, count(*) FILTER (y.z > 1) AS hdeg, count(*) FILTER (e.ord = 2 AND y.z = 8) AS dbl_o
  FROM atoms a LEFT JOIN ends e ON e.mol_id = a.mol_id AND e.idx = a.idx LEFT JOIN atoms y ON y.mol_id = e.mol_id AND y.idx = e.nbr GROUP BY ALL),
 fx AS (SELECT a.*, nb.* EXCLUDE (mol_id, idx), el.symbol, el.weight FROM atoms a JOIN nb ON nb.mol_id = a.mol_id AND nb.idx = a.idx JOIN el ON el.z = a.z),
 pa AS (SELECT *,
   CASE WHEN z = 7 AND aromatic THEN CASE WHEN aro = 2 AND num_h = 0 AND charge = 0 THEN 12.89 WHEN aro = 2 AND num_h = 1 AND charge = 0 THEN 15.79
       WHEN aro >= 3 AND num_h = 0 AND charge = 0 THEN 4.41 WHEN charge = 1 THEN 14.14 ELSE 12.89 END
     WHEN z = 7 AND charge > 0 THEN CASE num_h WHEN 3 THEN 27.64 WHEN 2 THEN 25.59 WHEN 1 THEN 19.03 ELSE 0 END
     WHEN z = 7 THEN CASE WHEN tri = 1 THEN 23.79 WHEN dbl = 1 AND num_h = 0 THEN 12.36 WHEN dbl = 1 AND num_h = 1 THEN 23.85
       WHEN num_h = 2 THEN 26.02 WHEN num_h = 1 THEN 12.03 ELSE 3.24 END
     WHEN z = 8 THEN CASE WHEN aromatic THEN 13.14 WHEN charge < 0 THEN 23.06 WHEN dbl = 1 THEN 17.07 WHEN num_h = 1 THEN 20.23 ELSE 9.23 END
     ELSE 0 END AS psa,
   num_h * 0.1230 + CASE z
     WHEN 6 THEN CASE WHEN aromatic THEN CASE WHEN het > 0 THEN 0.1360 ELSE 0.1581 END ELSE CASE het WHEN 0 THEN 0.1441 WHEN 1 THEN 0 ELSE -0.2035 END END
     WHEN 7 THEN CASE WHEN NOT aromatic AND num_h = 2 THEN -1.0190 WHEN NOT aromatic AND num_h = 1 THEN -0.7096 ELSE -0.3187 END - CASE WHEN charge > 0 THEN 0.5 ELSE 0 END
     WHEN 8 THEN CASE WHEN NOT aromatic AND num_h = 1 THEN -0.2893 ELSE 0.1552 END - CASE WHEN charge < 0 THEN 1.0 ELSE 0 END
     WHEN 9 THEN 0.4202 WHEN 16 THEN 0.6482 WHEN 17 THEN 0.6895 WHEN 35 THEN 0.8456 ELSE 0 END AS lp
   FROM fx),
 rot AS (SELECT b.mol_id, count(*) AS rotatable FROM bonds b JOIN pa x ON x.mol_id = b.mol_id AND x.idx = b.a JOIN pa y ON y.mol_id = b.mol_id AND y.idx = b.b
   WHERE ord = 1 AND NOT ring AND x.hdeg >= 2 AND y.hdeg >= 2 AND NOT (x.z = 6 AND y.z = 7 AND x.dbl_o > 0) AND NOT (y.z = 6 AND x.z = 7 AND y.dbl_o > 0) GROUP BY 1),
 arom AS (SELECT mol_id, count(*) FILTER (ord = 5) // 6 AS n_arom_rings FROM bonds GROUP BY 1),
 desc0 AS (SELECT mol_id, CAST(sum(weight + num_h * 1.008) AS DOUBLE) AS mw, CAST(sum(weight) AS DOUBLE) AS heavy_mw, CAST(sum(lp) AS DOUBLE) AS logp, CAST(sum(psa) AS DOUBLE) AS tpsa,
   CASE WHEN count(*) FILTER (z = 6) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (z = 6 AND NOT aromatic AND dbl + tri + aro = 0)::DOUBLE / count(*) FILTER (z = 6) END AS fraction_csp3,
   count(*) FILTER (z > 1) AS heavy_atoms, count(*) FILTER (z NOT IN (1, 6)) AS hetero_atoms, count(*) FILTER (z IN (7, 8) AND num_h > 0) AS hbd,
   count(*) FILTER (z IN (7, 8) AND charge <= 0 AND NOT (z = 7 AND aromatic AND num_h > 0)) AS hba,
   count(*) FILTER (chirality <> 0) AS n_stereo, CAST(sum(charge) AS BIGINT) AS formal_charge FROM pa GROUP BY mol_id),
 {_REACH},
 d AS (SELECT d0.*, coalesce(rotatable, 0) AS rotatable, n_rings, coalesce(n_arom_rings, 0) AS n_arom_rings FROM desc0 d0
   JOIN {_RINGS} r ON r.mol_id = d0.mol_id LEFT JOIN rot ON rot.mol_id = d0.mol_id LEFT JOIN arom ON arom.mol_id = d0.mol_id)"""
_DSQL = f"{_GR}, {_PER_ATOM}"
_VIOL = "(CASE WHEN mw > 500 THEN 1 ELSE 0 END + CASE WHEN logp > 5 THEN 1 ELSE 0 END + CASE WHEN hbd > 5 THEN 1 ELSE 0 END + CASE WHEN hba > 10 THEN 1 ELSE 0 END)"


def _curve(x, best, low, high):
    return f"exp(-0.5 * pow(({x} - {best}) / CASE WHEN {x} < {best} THEN {(best - low) / 2.0} ELSE {(high - best) / 2.0} END, 2))"


_QED = "pow(" + " * ".join(
    _curve(*c) for c in (
        ("mw", 300.0, 150.0, 500.0), ("logp", 2.5, -2.0, 6.0), ("hba", 4.0, 0.0, 12.0), ("hbd", 1.5, 0.0, 6.0),
        ("tpsa", 70.0, 0.0, 150.0), ("rotatable", 4.0, 0.0, 12.0), ("n_arom_rings", 2.0, 0.0, 5.0),
    )
) + ", 1.0 / 7.0)"
_FORMULA = f"""{_GR}, {_ELEMENTS}, parts AS (SELECT mol_id, symbol, count(*) AS n FROM atoms JOIN el ON el.z = atoms.z GROUP BY ALL
   UNION ALL SELECT mol_id, 'H', sum(num_h) FROM atoms GROUP BY 1 HAVING sum(num_h) > 0),
 ranked AS (SELECT *, bool_or(symbol = 'C') OVER (PARTITION BY mol_id) AS has_c FROM parts)
 SELECT mol_id, string_agg(symbol || CASE WHEN n > 1 THEN CAST(n AS BIGINT)::VARCHAR ELSE '' END, '' ORDER BY
   CASE WHEN has_c AND symbol = 'C' THEN 0 WHEN has_c AND symbol = 'H' THEN 1 ELSE 2 END, symbol) AS formula FROM ranked GROUP BY mol_id"""


def _parsed(spark, sf):
    return T.molecules(spark, sf).where("mol IS NOT NULL")


@query("d01_molecular_weight", f"{_DSQL} SELECT mol_id, round(mw, 4) AS mw FROM d")
def molecular_weight(spark, sf):
    return _parsed(spark, sf).select("mol_id", F.round(D.molecular_weight("mol"), 4).alias("mw"))


@query("d02_molecular_formula", _FORMULA)
def molecular_formula(spark, sf):
    return _parsed(spark, sf).select("mol_id", D.molecular_formula("mol").alias("formula"))


def _single(name, column, decimals=None):
    sql_value = f"round({column}, {decimals})" if decimals else column

    @query(name, f"{_DSQL} SELECT mol_id, {sql_value} AS {column} FROM d")
    def one(spark, sf):
        value = D.descriptor("mol", column)
        value = F.round(value, decimals) if decimals else value.cast("bigint")
        return _parsed(spark, sf).select("mol_id", value.alias(column))

    return one


_single("d03_hydrogen_bond_donors", "hbd")
_single("d04_hydrogen_bond_acceptors", "hba")
_single("d05_rotatable_bonds", "rotatable")
_single("d06_tpsa", "tpsa", 4)
_single("d07_logp", "logp", 6)
_single("d08_fraction_csp3", "fraction_csp3", 9)

_ROUNDED = {"mw": 4, "heavy_mw": 4, "logp": 6, "tpsa": 4, "fraction_csp3": 9}


def _rounded_columns(names):
    return [
        (F.round(f"d.{n}", _ROUNDED[n]) if n in _ROUNDED else F.col(f"d.{n}").cast("bigint")).alias(n) for n in names
    ]


def _rounded_sql(names):
    return ", ".join(f"round({n}, {_ROUNDED[n]}) AS {n}" if n in _ROUNDED else n for n in names)


_ALL = tuple(D.DESCRIPTOR_SQL)


@query("d09_descriptors", f"{_DSQL} SELECT mol_id, {_rounded_sql(_ALL)} FROM d")
def all_descriptors(spark, sf):
    return _parsed(spark, sf).withColumn("d", D.descriptors("mol")).select("mol_id", *_rounded_columns(_ALL))


@query("d10_lipinski", f"{_DSQL} SELECT mol_id, {_VIOL} AS violations, {_VIOL} <= 1 AS passes FROM d")
def lipinski(spark, sf):
    d = _parsed(spark, sf).withColumn("d", D.descriptors("mol", ("mw", "logp", "hbd", "hba")))
    return d.select("mol_id", D.lipinski_violations().alias("violations"), D.passes_ro5().alias("passes"))


@query("d11_qed", f"{_DSQL} SELECT mol_id, round({_QED}, 6) AS qed FROM d")
def qed(spark, sf):
    d = _parsed(spark, sf).withColumn("d", D.descriptors("mol", tuple(c[0] for c in D.QED_CURVES)))
    return d.select("mol_id", F.round(D.qed_score(), 6).alias("qed"))


@query("d12_ligand_efficiency", f"""{_DSQL} SELECT mol_id, round(CASE WHEN mw <= 0 THEN 0 ELSE p_retailprice / 100.0 * 1.37 / (mw / 13.0) END, 6) AS efficiency
  FROM d JOIN part ON p_partkey = mol_id""")
def ligand_efficiency(spark, sf):
    p = T.table(spark, sf, "part")
    rows = with_molecule(p.select("p_partkey", "p_retailprice", T.compose_smiles(F.col("p_partkey"), F.col("p_size")).alias("smiles"))).where("mol IS NOT NULL")
    mw = rows.withColumn("mw", D.molecular_weight("mol"))
    eff = D.ligand_efficiency(F.col("p_retailprice") / 100.0, F.col("mw"))
    return mw.select(F.col("p_partkey").alias("mol_id"), F.round(eff, 6).alias("efficiency"))


@query("d13_estimated_fraction_csp3", f"{_DSQL} SELECT mol_id, round(CASE WHEN heavy_atoms = 0 THEN 0 ELSE 1.0::DOUBLE - (n_rings * 6)::DOUBLE / heavy_atoms END, 9) AS estimate FROM d")
def estimated_fraction_csp3(spark, sf):
    d = _parsed(spark, sf).withColumn("d", D.descriptors("mol", ("n_rings", "heavy_atoms")))
    return d.select("mol_id", F.round(D.estimated_fraction_csp3(F.col("d.n_rings"), F.col("d.heavy_atoms")), 9).alias("estimate"))


@query("d14_descriptor_registry", f"""{_DSQL} SELECT mol_id, name, round(value, 6) AS value FROM (
  SELECT mol_id, 'MW' AS name, mw AS value FROM d UNION ALL SELECT mol_id, 'LogP', logp FROM d
  UNION ALL SELECT mol_id, 'Ro5_violations', {_VIOL} FROM d
  UNION ALL SELECT mol_id, 'FractionCSP3', CASE WHEN heavy_atoms = 0 THEN 0 ELSE 1.0::DOUBLE - (n_rings * 6)::DOUBLE / heavy_atoms END FROM d
  UNION ALL SELECT mol_id, 'NoSuchDescriptor', NULL FROM d)""")
def descriptor_registry(spark, sf):
    from ..operators.screening import compute_all

    d = _parsed(spark, sf).withColumn("d", D.descriptors("mol", ("mw", "logp", "hbd", "hba", "n_rings", "heavy_atoms"))).select("mol_id", "d")
    rows = compute_all(d, "mol_id", ("MW", "LogP", "Ro5_violations", "FractionCSP3", "NoSuchDescriptor"))
    return rows.select("mol_id", "name", F.round("value", 6).alias("value"))


@query("d15_descriptor_matrix", f"{_DSQL} SELECT s.mol_id, {_rounded_sql(D.MATRIX_COLUMNS)} FROM smi s LEFT JOIN d ON d.mol_id = s.mol_id")
def descriptor_matrix(spark, sf):
    d = T.molecules(spark, sf).withColumn("d", D.descriptors("mol", D.MATRIX_COLUMNS))
    return d.select("mol_id", *_rounded_columns(D.MATRIX_COLUMNS))


@query("d16_all_weights", f"{_DSQL} SELECT s.mol_id, smiles, round(mw, 4) AS mw FROM smi s LEFT JOIN d ON d.mol_id = s.mol_id")
def all_weights(spark, sf):
    return T.molecules(spark, sf).select("mol_id", "smiles", F.round(D.molecular_weight("mol"), 4).alias("mw"))


# ---------------------------------------------------------------- fingerprints

_U = "4294967295::UBIGINT"


def _sql_combine(parts: str) -> str:
    return f"list_reduce({parts}, lambda s, v: xor(s, (v + 2654435769::UBIGINT + (s << 6) + (s >> 2)) & {_U}))"


def _sql_mix(e: str) -> str:
    return (
        f"list_transform(list_transform(list_transform([{e}], lambda v: (xor(v, v >> 16) * 2246822507::UBIGINT) & {_U}), "
        f"lambda v: (xor(v, v >> 13) * 3266489909::UBIGINT) & {_U}), lambda v: xor(v, v >> 16))[1]"
    )


def _list(*parts: str) -> str:
    return "[" + ", ".join(f"({p})::UBIGINT" for p in parts) + "]"


_ECFP = _sql_mix(_sql_combine(_list("0", "hdeg", "osum", "z", "isotope", "charge + 128", "num_h", "in_ring::INT")))
_ECFP_CHIRAL = _sql_mix(_sql_combine(_list("0", "hdeg", "osum", "z", "isotope", "charge + 128", "num_h", "in_ring::INT", "chirality")))
_FCFP = _sql_mix("""(CASE WHEN z IN (7, 8) AND num_h > 0 THEN 1 ELSE 0 END + CASE WHEN z IN (7, 8) THEN 2 ELSE 0 END + CASE WHEN aromatic THEN 4 ELSE 0 END
  + CASE WHEN charge > 0 THEN 8 ELSE 0 END + CASE WHEN charge < 0 THEN 16 ELSE 0 END + CASE WHEN z IN (6, 9, 17, 35) THEN 32 ELSE 0 END)::UBIGINT""")


def morgan_cte(radius: int = 2, invariant: str = _ECFP) -> str:
    """``layers(mol_id, idx, r, h)``: one hash per atom and radius."""
    out = f""" inv AS (SELECT a.mol_id, a.idx, {invariant} AS h FROM (
    SELECT a.*, count(e.nbr) FILTER (y.z <> 1) AS hdeg, coalesce(sum(CASE e.ord WHEN 5 THEN 1 ELSE e.ord END) FILTER (y.z <> 1), 0) AS osum
    FROM atoms a LEFT JOIN ends e ON e.mol_id = a.mol_id AND e.idx = a.idx LEFT JOIN atoms y ON y.mol_id = e.mol_id AND y.idx = e.nbr GROUP BY ALL) a),
  l0 AS (SELECT mol_id, idx, h FROM inv)"""
    for r in range(1, radius + 1):
        seq = f"list_concat([{r}::UBIGINT, any_value(c.h)], coalesce(flatten(list([e.ord::UBIGINT, n.h] ORDER BY e.ord, n.h) FILTER (e.nbr IS NOT NULL)), []))"
        out += f""",
  l{r} AS (SELECT c.mol_id, c.idx, {_sql_mix(_sql_combine(seq))} AS h FROM l{r - 1} c LEFT JOIN ends e ON e.mol_id = c.mol_id AND e.idx = c.idx
    LEFT JOIN l{r - 1} n ON n.mol_id = e.mol_id AND n.idx = e.nbr GROUP BY c.mol_id, c.idx)"""
    unions = " UNION ALL ".join(f"SELECT mol_id, idx, {r} AS r, h FROM l{r}" for r in range(radius + 1))
    return out + f",\n  layers AS ({unions})"


_M = f"{_G}, {morgan_cte()}"


@query("f01_hash_combine", f"""SELECT l_orderkey, l_linenumber, {_sql_combine(_list('l_partkey', 'l_suppkey', 'l_quantity'))}::BIGINT AS h FROM lineitem""")
def hash_combine(spark, sf):
    li = T.table(spark, sf, "lineitem")
    h = M.combine_column(M.combine_column(F.col("l_partkey"), F.col("l_suppkey")), F.col("l_quantity").cast("bigint"))
    return li.select("l_orderkey", "l_linenumber", h.alias("h"))


@query("f02_hash_mix", f"SELECT l_orderkey, l_linenumber, {_sql_mix('((l_orderkey * 65599 + l_partkey) & 4294967295)::UBIGINT')}::BIGINT AS h FROM lineitem")
def hash_mix(spark, sf):
    li = T.table(spark, sf, "lineitem")
    x = (F.col("l_orderkey") * 65599 + F.col("l_partkey")).bitwiseAND(F.lit(4294967295))
    return li.select("l_orderkey", "l_linenumber", M.mix_column(x).alias("h"))


def _hash_rows(spark, sf, **options):
    m = _parsed(spark, sf).select("mol_id", M.morgan_hashes("mol", **options).alias("h"))
    return m.select("mol_id", F.explode_outer("h").alias("hash")).where("hash IS NOT NULL")


@query("f03_ecfp_invariants", f"{_G}, {morgan_cte(0)} SELECT DISTINCT mol_id, h::BIGINT AS hash FROM layers")
def ecfp_invariants(spark, sf):
    return _hash_rows(spark, sf, radius=0)


@query("f04_fcfp_hashes", f"{_G}, {morgan_cte(2, _FCFP)} SELECT DISTINCT mol_id, h::BIGINT AS hash FROM layers")
def fcfp_hashes(spark, sf):
    return _hash_rows(spark, sf, features=True)


@query("f05_morgan_hashes", f"{_M} SELECT DISTINCT mol_id, h::BIGINT AS hash FROM layers")
def morgan_hashes(spark, sf):
    return _hash_rows(spark, sf)


@query("f06_morgan_fingerprint", f"{_M} SELECT mol_id, list(DISTINCT (h % 2048)::INT ORDER BY (h % 2048)::INT) AS bits, count(DISTINCT h % 2048) AS popcnt FROM layers GROUP BY mol_id", arrays=("bits",))
def morgan_fingerprint(spark, sf):
    m = _parsed(spark, sf).select("mol_id", M.morgan_fingerprint("mol").alias("fp"))
    return m.select("mol_id", B.on_bits("fp").alias("bits"), B.popcount("fp").cast("bigint").alias("popcnt"))


@query("f07_morgan_options", f"{_G}, {morgan_cte(3, _ECFP_CHIRAL)} SELECT mol_id, list(DISTINCT (h % 512)::INT ORDER BY (h % 512)::INT) AS bits FROM layers GROUP BY mol_id", arrays=("bits",))
def morgan_options(spark, sf):
    m = _parsed(spark, sf).select("mol_id", M.morgan_fingerprint("mol", radius=3, n_bits=512, chirality=True).alias("fp"))
    return m.select("mol_id", B.on_bits("fp").alias("bits"))


@query("f08_morgan_counts", f"{_M} SELECT mol_id, h::BIGINT AS hash, count(*) AS n FROM layers GROUP BY ALL")
def morgan_counts(spark, sf):
    m = _parsed(spark, sf).select("mol_id", M.morgan_counts("mol").alias("c"))
    rows = m.select("mol_id", F.explode_outer("c").alias("hash", "n")).where("hash IS NOT NULL")
    return rows.withColumn("n", F.col("n").cast("bigint"))


@query("f09_collision_report", f"""{_M} SELECT mol_id, n_bits, count(DISTINCT h) AS features, count(DISTINCT h % n_bits) AS bits_set, count(DISTINCT h) - count(DISTINCT h % n_bits) AS collisions
  FROM (SELECT *, unnest([256, 512, 1024, 2048, 4096]) AS n_bits FROM layers) GROUP BY ALL""")
def collision_report(spark, sf):
    m = _parsed(spark, sf).select("mol_id", M.morgan_hashes("mol").alias("h"))
    rows = m.select("mol_id", F.inline(M.collision_report("h")))
    return rows.select("mol_id", "n_bits", *[F.col(c).cast("bigint").alias(c) for c in ("features", "bits_set", "collisions")])


@query("f10_radius_sweep", f"""{_G}, {morgan_cte(4)}, sweep AS (SELECT unnest([0, 1, 2, 3, 4]) AS radius)
  SELECT mol_id, radius, count(DISTINCT h) AS features, count(DISTINCT h % 2048) AS bits_set FROM layers JOIN sweep ON r <= radius GROUP BY ALL""")
def radius_sweep(spark, sf):
    m = _parsed(spark, sf)
    within = lambda r: F.transform(F.filter("found", lambda f: f["r"] <= r), lambda f: f["h"])
    entries = [
        F.struct(
            F.lit(r).alias("radius"), F.size(within(r)).cast("bigint").alias("features"),
            F.size(F.array_distinct(F.transform(within(r), lambda h: h % 2048))).cast("bigint").alias("bits_set"),
        )
        for r in range(5)
    ]
    return m.select("mol_id", M.morgan_first_radii("mol", radius=4).alias("found")).select("mol_id", F.inline(F.array(*entries)))


@query("f11_atom_pairs", f"""{_GR}, {_WALK.format(where='')} SELECT DISTINCT a.mol_id, least(a.z, b.z) * 1000000 + greatest(a.z, b.z) * 1000 + d AS pair
  FROM dist JOIN atoms a ON a.mol_id = dist.mol_id AND a.idx = dist.s JOIN atoms b ON b.mol_id = dist.mol_id AND b.idx = dist.idx WHERE a.idx < b.idx""")
def atom_pairs(spark, sf):
    m = _parsed(spark, sf)
    return m.select("mol_id", F.explode(A.atom_pairs("mol")).alias("pair"))


# ---------------------------------------------------------------- library search

QUERY_SMILES = "CC(=O)Oc1ccc(cc1)C(=O)O"
# the same structure as a row of the composed table
_QUERY_KEY = 52800197
_LIB = "(SELECT p_partkey, p_size FROM part UNION ALL SELECT 52800197, 0)"
_LIBSQL = f"""WITH {graph_cte(source=_LIB)}, {morgan_cte()},
 fps AS (SELECT mol_id, list(DISTINCT (h % 2048)::INT) AS bits FROM layers GROUP BY 1),
 scored AS (SELECT d.mol_id AS id, len(list_intersect(d.bits, q.bits))::DOUBLE / (len(d.bits) + len(q.bits) - len(list_intersect(d.bits, q.bits))) AS score
   FROM fps d, fps q WHERE q.mol_id = {_QUERY_KEY} AND d.mol_id <> {_QUERY_KEY})"""


def library(spark, sf):
    """(id, fp, popcnt) of every molecule that parses."""
    return M.fingerprint_table(_parsed(spark, sf).withColumnRenamed("mol_id", "id"))


def query_words(spark, smiles: str):
    """Fingerprint words of one query structure (a single small row)."""
    row = with_molecule(spark.createDataFrame([(smiles,)], "smiles string")).select("error", M.morgan_fingerprint("mol").alias("fp")).first()
    if row.error is not None:
        raise ValueError(f"{row.error.message} at {row.error.position}")
    return list(row.fp)


@query("k06_screen_library", f"{_LIBSQL} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20")
def screen_library(spark, sf):
    return K.topk_search(library(spark, sf), query_words(spark, QUERY_SMILES), 20)


@query("k01_threshold_molecules", f"{_LIBSQL} SELECT id, score FROM scored WHERE score >= 0.3")
def threshold_molecules(spark, sf):
    return K.threshold_search(library(spark, sf), query_words(spark, QUERY_SMILES), 0.3)


@query("j03_similar_molecule_pairs", f"""WITH {graph_cte()}, {morgan_cte()}, fps AS (SELECT mol_id, list_sort(list(DISTINCT (h % 2048)::INT)) AS bits FROM layers GROUP BY 1),
 u AS (SELECT bits, min(mol_id) AS id, count(*) AS n FROM fps GROUP BY bits),
 one AS (SELECT id, unnest(bits) AS b FROM u),
 common AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM one x JOIN one y ON x.b = y.b AND x.id < y.id GROUP BY ALL)
 SELECT id_a, id_b, c::DOUBLE / (len(x.bits) + len(y.bits) - c) AS score, x.n AS copies_a, y.n AS copies_b FROM common JOIN u x ON x.id = id_a JOIN u y ON y.id = id_b
 WHERE c::DOUBLE / (len(x.bits) + len(y.bits) - c) >= 0.7""")
def similar_molecule_pairs(spark, sf):
    return K.all_pairs(library(spark, sf), 0.7)


_LINE_KEY = "(l_partkey * 7 + l_linenumber) * 4 + CAST(l_quantity AS BIGINT) % 4"
_LINES = f"(SELECT DISTINCT {_LINE_KEY} AS k, CAST(l_quantity AS BIGINT) % 4 AS q FROM lineitem)"


@query("a08_library_statistics", f"""WITH RECURSIVE {graph_cte(key='k', pad='q', source=_LINES)}, {_PER_ATOM}
 SELECT l_returnflag AS flag, round(sum(mw), 1) AS sum_mw, round(sum(logp), 1) AS sum_logp, count(*) AS n, count(*) FILTER ({_VIOL} <= 1) AS ro5_pass
 FROM lineitem JOIN d ON d.mol_id = {_LINE_KEY} GROUP BY 1""")
def library_statistics(spark, sf):
    d = T.line_molecules(spark, sf).where("mol IS NOT NULL").withColumn("d", D.descriptors("mol", ("mw", "logp", "hbd", "hba")))
    return d.groupBy("flag").agg(
        F.round(F.sum(F.col("d.mw") * F.col("n")), 1).alias("sum_mw"), F.round(F.sum(F.col("d.logp") * F.col("n")), 1).alias("sum_logp"),
        F.sum("n").alias("n"), F.sum(F.when(D.passes_ro5(), F.col("n")).otherwise(0)).alias("ro5_pass"),
    )
