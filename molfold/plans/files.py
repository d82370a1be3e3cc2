"""Queries over file formats: written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import descriptors as D
from ..functions import morgan as M
from ..functions.columnar import with_molecule
from ..operators.scratch import scratch_path
from ..sources import csvfile, formats, fpfile, sdf, smi
from ..sources.listing import list_files
from . import tables as T
from .chemistry import _DSQL, _ELEMENTS, _G, _M, _QED, _S, _VIOL, library
from .pieces import smiles_cte
from .registry import query


def _lines(spark, sf):
    """One text line per part: plain, padded, bare, comment, blank, extra tab, empty first field."""
    k, s = F.col("mol_id"), F.col("smiles")
    ident = F.concat(F.lit("ID"), k.cast("string"))
    return T.smiles_rows(spark, sf).select(
        F.when(k % 7 == 0, F.concat(s, F.lit("\t"), ident))
        .when(k % 7 == 1, F.concat(s, F.lit("\t  "), ident, F.lit(" \r")))
        .when(k % 7 == 2, s)
        .when(k % 7 == 3, F.concat(F.lit("# "), s))
        .when(k % 7 == 4, F.lit(""))
        .when(k % 7 == 5, F.concat(s, F.lit("\t"), ident, F.lit("\tmore")))
        .otherwise(F.concat(F.lit("\t"), ident))
        .alias("value")
    )


_RECORDS = f"""{_S} SELECT CASE WHEN mol_id % 7 = 6 THEN '' ELSE smiles END AS smiles,
  CASE mol_id % 7 WHEN 2 THEN '' WHEN 5 THEN 'ID' || mol_id || chr(9) || 'more' ELSE 'ID' || mol_id END AS id FROM smi WHERE mol_id % 7 NOT IN (3, 4)"""


@query("io01_smi_scan", _RECORDS)
def smi_scan(spark, sf):
    path = scratch_path(spark, "smi")
    _lines(spark, sf).write.text(path)
    return smi.read_smi(spark, path)


@query("io02_smi_records", _RECORDS)
def smi_records(spark, sf):
    """The same rows straight from a column of lines."""
    return smi.records_from_lines(_lines(spark, sf))


@query("io16_directory_scan", f"""{_S} SELECT '.txt' AS extension, true AS named, sum(strlen(smiles) + strlen('ID' || mol_id) + 2)::BIGINT AS n_bytes FROM smi""")
def directory_scan(spark, sf):
    """Sizes of the files of a written library, from the listing alone."""
    path = scratch_path(spark, "listed")
    smi.write_smi(T.smiles_rows(spark, sf).select("smiles", F.concat(F.lit("ID"), "mol_id").alias("id")), path)
    files = list_files(spark, path, "*.txt").where("length > 0")
    named = F.bool_and(F.concat("stem", "extension") == F.col("name"))
    return files.groupBy("extension").agg(named.alias("named"), F.sum("length").alias("n_bytes"))


@query("io03_whole_files", f"""{_S} SELECT sum(1 + CASE mol_id % 7 WHEN 0 THEN length(smiles || 'ID' || mol_id) + 1 WHEN 1 THEN length(smiles || 'ID' || mol_id) + 5 WHEN 2 THEN length(smiles)
  WHEN 3 THEN length(smiles) + 2 WHEN 4 THEN 0 WHEN 5 THEN length(smiles || 'ID' || mol_id) + 6 ELSE length('ID' || mol_id) + 1 END)::BIGINT AS n_chars FROM smi""")
def whole_files(spark, sf):
    """Characters of the written files, read as whole texts."""
    path = scratch_path(spark, "whole")
    _lines(spark, sf).write.text(path)
    return smi.read_file(spark, path).agg(F.sum(F.length("value")).alias("n_chars"))


@query("io04_split_lines", r"""WITH d AS (SELECT doc_id, replace(text, '. ', '.' || chr(13) || chr(10)) || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END AS t FROM documents),
  l AS (SELECT doc_id, CASE WHEN ends_with(t, chr(10)) THEN substr(t, 1, length(t) - 1) ELSE t END AS t FROM d),
  e AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM l)
  SELECT doc_id, count(*) AS n_lines, sum(length(regexp_replace(line, '\r$', '')))::BIGINT AS n_chars FROM e GROUP BY 1""")
def split_lines(spark, sf):
    d = T.table(spark, sf, "documents")
    text = F.concat(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.when(F.col("doc_id") % 2 == 0, "\n").otherwise(""))
    lines = d.select("doc_id", F.explode(smi.split_lines(text)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("io05_default_ids", f"""{_S}, ok AS (SELECT *, row_number() OVER (ORDER BY mol_id) - 1 AS n FROM smi WHERE NOT broken)
  SELECT mol_id, CASE WHEN mol_id % 3 = 0 THEN 'MOL' || n ELSE 'ID' || mol_id END AS id FROM ok""")
def default_ids(spark, sf):
    k = F.col("mol_id")
    m = T.molecules(spark, sf).select(
        "mol_id", "mol", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("ID"), k.cast("string"))).alias("id"),
        F.lit("a.smi").alias("file"), (F.floor(k / 64) * 64).alias("block"), k.alias("row"),
    )
    return smi.fill_ids(m).select("mol_id", "id")


@query("io06_space_separated", f"""{_S} SELECT CASE WHEN mol_id % 7 = 6 THEN '' ELSE smiles END AS smiles,
  CASE mol_id % 7 WHEN 2 THEN '' WHEN 5 THEN 'ID' || mol_id || ' more' ELSE 'ID' || mol_id END AS id FROM smi WHERE mol_id % 7 NOT IN (3, 4)""")
def space_separated(spark, sf):
    lines = _lines(spark, sf).select(F.translate("value", "\t", " ").alias("value"))
    return smi.records_from_lines(lines, any_space=True)


def _fixed_sql(x, n):
    # ties and float noise: settle nine decimals first, then half up
    return f"printf('%.{n}f', sign({x}) * floor(abs(round({x}, 9)) * {10 ** n} + 0.5 + 1e-7) / {10 ** n})"


_FORMULA_CTE = """, fparts AS (SELECT mol_id, symbol, count(*) AS n FROM atoms JOIN el ON el.z = atoms.z GROUP BY ALL
   UNION ALL SELECT mol_id, 'H', sum(num_h) FROM atoms GROUP BY 1 HAVING sum(num_h) > 0),
 franked AS (SELECT *, bool_or(symbol = 'C') OVER (PARTITION BY mol_id) AS has_c FROM fparts),
 fm AS (SELECT mol_id, string_agg(symbol || CASE WHEN n > 1 THEN CAST(n AS BIGINT)::VARCHAR ELSE '' END, '' ORDER BY
   CASE WHEN has_c AND symbol = 'C' THEN 0 WHEN has_c AND symbol = 'H' THEN 1 ELSE 2 END, symbol) AS formula FROM franked GROUP BY mol_id)"""


@query("io07_descriptor_file", f"""{_DSQL}{_FORMULA_CTE} SELECT d.mol_id::VARCHAR AS "ID", smiles AS "SMILES", formula AS "Formula", {_fixed_sql('mw', 3)} AS "MW", heavy_atoms AS "HeavyAtoms", hetero_atoms AS "HeteroAtoms",
  {_fixed_sql('logp', 3)} AS "LogP", {_fixed_sql('tpsa', 2)} AS "TPSA", hbd AS "HBD", hba AS "HBA", rotatable AS "RotB", n_rings AS "Rings", n_arom_rings AS "AromRings", {_fixed_sql('fraction_csp3', 3)} AS "FracCsp3",
  formal_charge AS "Charge", CAST({_VIOL} AS BIGINT) AS "Ro5Violations", {_fixed_sql('(' + _QED + ')', 3)} AS "QED" FROM d JOIN smi ON smi.mol_id = d.mol_id JOIN fm ON fm.mol_id = d.mol_id""")
def descriptor_file(spark, sf):
    """The CSV as written, read back with its header."""
    path = scratch_path(spark, "csv")
    csvfile.write_descriptors(T.molecules(spark, sf).withColumnRenamed("mol_id", "id"), path)
    ints = ("HeavyAtoms", "HeteroAtoms", "HBD", "HBA", "RotB", "Rings", "AromRings", "Charge", "Ro5Violations")
    schema = ", ".join(f"{c} {'bigint' if c in ints else 'string'}" for c in csvfile.DESCRIPTOR_COLUMNS)
    return spark.read.csv(path, header=True, schema=schema)


@query("io09_fingerprint_file", f"{_M} SELECT mol_id::VARCHAR AS id, count(DISTINCT h % 2048) AS popcnt, sum(DISTINCT h % 2048)::BIGINT AS bit_sum FROM layers GROUP BY mol_id")
def fingerprint_file(spark, sf):
    """Binary shards written and read back."""
    path = scratch_path(spark, "fpdb")
    fpfile.write_shards(library(spark, sf), path)
    d = fpfile.read_shards(spark, path)
    total = F.aggregate(B.on_bits("fp"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return d.select("id", F.col("popcnt").cast("bigint").alias("popcnt"), total.alias("bit_sum"))


@query("io10_popcount_layout", f"{_M}, f AS (SELECT mol_id AS id, count(DISTINCT h % 2048) AS popcnt FROM layers GROUP BY 1) SELECT id, popcnt FROM f WHERE popcnt BETWEEN 15 AND 30")
def popcount_layout(spark, sf):
    """Stored in popcount order and read through a band."""
    from ..operators import search as K

    path = scratch_path(spark, "library")
    K.write_database(library(spark, sf), path)
    return K.count_range(K.read_database(spark, path), 15, 30).select("id", F.col("popcnt").cast("bigint").alias("popcnt"))


def _structures(spark, sf):
    """Records with invented coordinates and two properties."""
    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    axis = lambda f: F.transform("mol.atoms", f)
    return m.select(
        F.col("smiles").alias("name"), "mol",
        axis(lambda a, i: i * 1.5).alias("x"), axis(lambda a, i: F.lit(-0.25)).alias("y"), axis(lambda a, i: a.z / 4.0).alias("z"),
        F.create_map(
            F.lit("ID"), F.col("mol_id").cast("string"), F.lit("MW"), F.format_string("%.3f", F.round(D.molecular_weight("mol"), 9)),
            F.lit("NOTE"), F.concat(F.lit("line one\nkey "), F.col("mol_id").cast("string")),
        ).alias("props"),
    )


_SDF = f"""{_G}, {_ELEMENTS}, za AS (SELECT mol_id, list(z::INT ORDER BY idx) AS zs, sum(idx * 1.5)::DOUBLE AS sx, sum(z / 4.0)::DOUBLE AS sz FROM atoms GROUP BY 1),
 bo AS (SELECT mol_id, list(a || '-' || b || '-' || ord ORDER BY a, b) AS bs FROM bonds GROUP BY 1)
 SELECT smiles AS name, zs, sx, sz, coalesce(bs, []) AS bs, s.mol_id::VARCHAR AS id, 'line one' || chr(10) || 'key ' || s.mol_id AS note FROM smi s JOIN za ON za.mol_id = s.mol_id LEFT JOIN bo ON bo.mol_id = s.mol_id"""


@query("io11_sdf_scan", _SDF, arrays=("zs", "bs",))
def sdf_scan(spark, sf):
    path = scratch_path(spark, "sdf")
    sdf.write_sdf(_structures(spark, sf), path)
    r = sdf.read_sdf(spark, path)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    rows = F.array_sort(F.transform("mol.bonds", lambda b: F.struct(b.a.alias("a"), b.b.alias("b"), b.bond_order.alias("o"))))
    bonds = F.transform(rows, lambda b: F.concat_ws("-", b.a, b.b, b.o))
    return r.select(
        "name", F.transform("mol.atoms", lambda a: a.z).alias("zs"), total("x").alias("sx"), total("z").alias("sz"), bonds.alias("bs"),
        F.col("props")["ID"].alias("id"), F.col("props")["NOTE"].alias("note"),
    )


@query("io19_sdf_format", _SDF.replace("zs, sx, sz, coalesce(bs, []) AS bs, s.mol_id::VARCHAR AS id, ", "sz, s.mol_id::VARCHAR AS id, ") + " WHERE smiles LIKE 'C%'")
def sdf_format(spark, sf):
    """Some columns of the records whose names begin with a C, by ``spark.read.format``."""
    path = scratch_path(spark, "sdf")
    sdf.write_sdf(_structures(spark, sf), path)
    formats.register_formats(spark)
    r = spark.read.format("sdf").schema("name string, z array<double>, props map<string,string>").load(path).where(F.col("name").startswith("C"))
    return r.select("name", F.aggregate("z", F.lit(0.0), lambda a, v: a + v).alias("sz"), F.col("props")["ID"].alias("id"), F.col("props")["NOTE"].alias("note"))


@query("io12_sdf_number_property", f"{_DSQL} SELECT mol_id, {_fixed_sql('mw', 3)}::DOUBLE AS mw, NULL::DOUBLE AS note FROM d")
def sdf_number_property(spark, sf):
    texts = _structures(spark, sf).select(sdf.format_record("name", "mol", "x", "y", "z", "props").alias("value"))
    r = sdf.records_from_texts(texts.select(F.regexp_replace("value", r"\n\$\$\$\$$", "").alias("value")))
    return r.select(F.col("props")["ID"].cast("bigint").alias("mol_id"), sdf.prop_double("MW").alias("mw"), sdf.prop_double("NOTE").alias("note"))


@query("io13_sdf_text", f"""{_G}, {_ELEMENTS}, al AS (SELECT a.mol_id, string_agg(printf('%10.4f%10.4f%10.4f ', idx * 1.5, -0.25, a.z / 4.0) || rpad(symbol, 3, ' ') || ' 0  0  0  0  0  0  0  0  0  0  0  0', chr(10) ORDER BY idx) AS t, count(*) AS n
   FROM atoms a JOIN el ON el.z = a.z GROUP BY 1), bl AS (SELECT mol_id, count(*) AS n FROM bonds GROUP BY 1)
 SELECT s.mol_id, printf('%3d%3d  0  0  0  0  0  0  0  0999 V2000', al.n, coalesce(bl.n, 0)) AS counts_line, al.t AS atom_block FROM smi s JOIN al ON al.mol_id = s.mol_id LEFT JOIN bl ON bl.mol_id = s.mol_id""")
def sdf_text(spark, sf):
    d = _structures(spark, sf).withColumn("lines", F.split(sdf.format_record("name", "mol", "x", "y", "z", "props"), "\n"))
    return d.select(
        F.col("props")["ID"].cast("bigint").alias("mol_id"), F.get("lines", F.lit(3)).alias("counts_line"),
        F.array_join(F.slice("lines", F.lit(5), F.size("mol.atoms")), "\n").alias("atom_block"),
    )


@query("io14_csv_fields", """SELECT p_partkey, [p_name, 'say "' || p_brand || '", twice', '', p_size::VARCHAR, p_type] AS fields FROM part""", arrays=("fields",))
def csv_fields(spark, sf):
    p = T.table(spark, sf, "part")
    line = F.concat(
        F.col("p_name"), F.lit(',"say ""'), F.col("p_brand"), F.lit('"", twice",,'), F.col("p_size").cast("string"), F.lit(","), F.col("p_type"), F.lit("\r")
    )
    return p.select("p_partkey", csvfile.parse_csv_line(line).alias("fields"))


@query("io15_csv_round_trip", "SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS label, p_size FROM part")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "quoted")
    p = T.table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"')).alias("label"), "p_size")
    csvfile.write_csv(p, path)
    return spark.read.csv(path, header=True, escape='"', schema="p_partkey bigint, label string, p_size int")


@query("io17_compressed_smi", _RECORDS)
def compressed_smi(spark, sf):
    path = scratch_path(spark, "gz")
    _lines(spark, sf).write.option("compression", "gzip").text(path)
    return smi.read_smi(spark, path)


@query("a10_element_counts", f"""{_G}, {_ELEMENTS}, c AS (SELECT symbol, count(*) AS n FROM atoms JOIN el ON el.z = atoms.z GROUP BY 1 UNION ALL SELECT 'H', sum(num_h) FROM atoms)
  SELECT symbol, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def element_counts(spark, sf):
    from ..functions import elements as E

    m = T.molecules(spark, sf).where("mol IS NOT NULL")
    z = m.select(F.explode("mol.atoms").alias("a")).select("a.z", "a.num_h")
    heavy = z.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("num_h").alias("h"))
    rows = heavy.select("z", "n").unionAll(heavy.select(F.lit(1).alias("z"), F.col("h").alias("n")))
    return rows.groupBy("z").agg(F.sum("n").alias("n")).select(E.symbol(F.col("z")).alias("symbol"), "n").where("n > 0")


@query("a12_success_rate", f"{_S} SELECT count(*) AS n, count(*) FILTER (NOT broken) AS n_ok, count(*) FILTER (broken) AS n_fail, round(count(*) FILTER (NOT broken)::DOUBLE / count(*), 6) AS rate FROM smi")
def success_rate(spark, sf):
    m = T.molecules(spark, sf)
    return m.agg(
        F.count(F.lit(1)).alias("n"), F.count("mol").alias("n_ok"), F.count("error").alias("n_fail"),
        F.round(F.count("mol") / F.count(F.lit(1)), 6).alias("rate"),
    )
