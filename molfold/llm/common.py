"""Helpers that several operators share."""

from __future__ import annotations

import string
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes to bytes: ASCII capitals to small letters, all else unchanged.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())

#: As LOWER, and every ASCII character that is no letter or digit to a space.
#: Bytes of multi-byte characters stay, so words may hold any of those.
WORDS_ONLY = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, in small letters."""
    return text.translate(WORDS_ONLY).split()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text, none for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Only a session in one process (tests) may leave it unset and gets a
    temporary folder; on a cluster each machine would write to its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        wanted = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="molfold-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows and their partitions as written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
