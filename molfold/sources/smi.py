"""Line-notation (.smi) files: one SMILES per line, then an optional id."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def trim(c) -> Column:
    """Strip white space of any kind from both ends."""
    return F.regexp_replace(c, SPACES, "")


def split_record(line: Column, delimiter: str = "\t", any_space: bool = False) -> tuple[Column, Column]:
    """(smiles, id): cut at the first delimiter; only the id is trimmed."""
    cut = "[ \t]" if any_space else re.escape(delimiter)
    return (
        F.regexp_extract(line, rf"(?s)^(.*?)(?:{cut}|\z)", 1),
        trim(F.regexp_extract(line, rf"(?s)^.*?{cut}(.*)\z", 1)),
    )


def records_from_lines(
    lines: DataFrame, delimiter: str = "\t", any_space: bool = False, line: str = "value"
) -> DataFrame:
    """(smiles, id) from raw lines: drops one trailing CR, blanks and comments.
    Other columns are kept."""
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    smiles, ident = split_record(F.col("_text"), delimiter, any_space)
    return (
        lines.withColumn("_text", text)
        .where((F.col("_text") != "") & ~F.startswith(F.col("_text"), F.lit("#")))
        .withColumns({"smiles": smiles, "id": ident})
        .drop("_text", line)
    )


def read_smi(
    spark: SparkSession,
    path: str,
    delimiter: str = "\t",
    has_header: bool = False,
    any_space: bool = False,
    with_position: bool = False,
) -> DataFrame:
    """(smiles, id) rows of one or more files; a missing path is an error.

    ``with_position`` adds (file, block, row): the reading order inside a
    file.  ``has_header`` drops the first line of every file.
    """
    raw = spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    if has_header:
        # the header is the first row of the block that starts a file
        first = raw.where("block = 0").groupBy("file").agg(F.min("row").alias("head"))
        raw = raw.join(first, "file", "left").where("head IS NULL OR row <> head OR block <> 0").drop("head")
    out = records_from_lines(raw, delimiter, any_space)
    return out if with_position else out.select("smiles", "id")


def fill_ids(parsed: DataFrame, prefix: str = "MOL", order=("file", "block", "row")) -> DataFrame:
    """Name anonymous rows ``MOL<n>``, n counting successes in file order.

    The running count is built from per-block totals, so no task ever sorts
    more than one block: counts inside a block come from a window over that
    block, and the offset of a block from the totals of those before it.
    """
    file, block, row = order
    ok = parsed.where(F.col("mol").isNotNull())
    inside = Window.partitionBy(file, block).orderBy(row)
    numbered = ok.withColumn("_k", F.row_number().over(inside) - 1)
    totals = ok.groupBy(file, block).agg(F.count(F.lit(1)).alias("_n"))
    # one row per file block: as many as there are scan tasks
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(file, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.join(offsets, [file, block])
        .withColumn("id", F.when(F.col("id") == "", F.concat(F.lit(prefix), (F.col("_k") + F.col("_offset")).cast("string"))).otherwise(F.col("id")))
        .drop("_k", "_offset")
    )


def write_smi(df: DataFrame, path: str, smiles: str = "smiles", ident: str = "id") -> None:
    df.select(F.concat_ws("\t", smiles, ident).alias("value")).write.mode("overwrite").text(path)


def split_lines(c) -> Column:
    """Lines of a text: CRLF aware, inner blanks kept, no trailing blank."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(F.regexp_replace(c, r"\n\z", ""), "\n", -1)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(
        F.transform(parts, lambda v: F.regexp_replace(v, r"\r\z", ""))
    )


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, one row each (for single-file configuration-sized texts)."""
    return spark.read.text(path, wholetext=True)
