"""Folder listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, extension, length) of the files under a folder.

    Contents are not read: only listing columns are selected.  Empty files are
    left out, as Spark's scans leave them out.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(folder).select(
        "path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"), "length",
    )
