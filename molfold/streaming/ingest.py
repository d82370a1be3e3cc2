"""Streaming arrival of .smi lines: the batch plan on an unbounded input.

Parsing, fingerprinting and screening keep no state between rows, so the
stream needs no watermark and any trigger works.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morgan import fingerprint_table
from ..functions.columnar import with_molecule
from ..operators.search import _literal_scored, _popcount_words, band
from ..sources.smi import records_from_lines


def stream_smi(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """(smiles, id) rows of files as they appear in a folder."""
    return records_from_lines(spark.readStream.text(path, lineSep="\n"), delimiter)


def stream_hits(records: DataFrame, words: Sequence[int], threshold: float) -> DataFrame:
    """(id, score) of arriving molecules that match one query (threshold > 0)."""
    count = _popcount_words(words)
    lo, hi = band(count, threshold)
    db = fingerprint_table(with_molecule(records))
    hits = _literal_scored(db.where(F.col("popcnt").between(lo, hi)), words, count)
    return hits.select("id", "score").where(F.col("score") >= threshold)
