"""Tables the registered queries run on, all derived from the given parquet.

``molecules``      one composed SMILES per row of ``part`` (or ``lineitem``),
``sign_bits``      64-bit fingerprints from the signs of ``embeddings``,
``word_bits``      2048-bit fingerprints from the words of a text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.elements import _lit_array
from ..functions.columnar import with_molecule
from ..operators.spread import spread_small

# SMILES pieces that are strung together: left + carbons + core + right.
LEFT = ("C", "O", "N", "Cl", "[NH3+]", "CC(=O)O", "N#C", "[Na+].[O-]")
CORE = ("c1ccc(cc1)", "c1cc2ccccc2cc1", "C1CCC(CC1)", "N1CCN(CC1)", "c1ccn(c1)", "c1cncc(c1)",
        "C(=O)N", "C1=CC(=O)C=CC1", "[C@@H](N)", "C12CCC(CC1)CC2", "S(=O)(=O)", "/C=C/")
RIGHT = ("C", "O", "C(=O)O", "N", "c1ccccc1", "[N+](=O)[O-]", "C(F)(F)F", "C#N", "Br", "[13CH3]", "-c1ccncc1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(_lit_array(values), (index % len(values) + 1).cast("int"))


def compose_smiles(key: Column, pad: Column) -> Column:
    """SMILES for an integer key; every tenth key is broken in one of five ways."""
    whole = F.concat(
        _pick(LEFT, key),
        F.repeat(F.lit("C"), (pad % 4).cast("int")),
        _pick(CORE, F.floor(key / len(LEFT))),
        _pick(RIGHT, F.floor(key / (len(LEFT) * len(CORE)))),
    )
    return (
        F.when(key % 50 == 9, F.concat(whole, F.lit("(")))
        .when(key % 50 == 19, F.concat(whole, F.lit(")")))
        .when(key % 50 == 29, F.concat(whole, F.lit("X")))
        .when(key % 50 == 39, F.concat(whole, F.lit("[C")))
        .when(key % 50 == 49, F.concat(whole, F.lit("%12")))
        .otherwise(whole)
    )


def smiles_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, smiles) for every part."""
    p = table(spark, sf_dir, "part")
    p = spread_small(p.select("p_partkey", "p_size"))
    return p.select(
        F.col("p_partkey").alias("mol_id"), compose_smiles(F.col("p_partkey"), F.col("p_size")).alias("smiles")
    )


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, smiles, mol, error) for every part."""
    return with_molecule(smiles_rows(spark, sf_dir))


def line_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, n, smiles, mol, error): the molecules of lineitem by return flag.

    Equal rows are counted first, so a molecule that many lines share is
    parsed once per flag and the copies never leave the map side.
    """
    li = table(spark, sf_dir, "lineitem")
    key = (F.col("l_partkey") * 7 + F.col("l_linenumber")) * 4 + F.col("l_quantity").cast("bigint") % 4
    lines = li.select(F.col("l_returnflag").alias("flag"), compose_smiles(key, F.col("l_quantity").cast("bigint")).alias("smiles"))
    counted = lines.groupBy("flag", "smiles").agg(F.count(F.lit(1)).alias("n"))
    # few distinct rows would end up in one task; parsing wants all cores
    return with_molecule(counted.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def sign_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, fp, popcnt): bit i is on where embedding[i] > 0."""
    e = table(spark, sf_dir, "embeddings")
    word = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(
            F.when(
                F.get(F.col("embedding"), i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
            ).otherwise(F.lit(0).cast("bigint"))
        ),
    )
    return e.select(F.col("vec_id").alias("id"), F.array(word).alias("fp")).withColumn("popcnt", B.popcount("fp"))


def word_rows(df: DataFrame, key: str, text: str, n_bits: int = 2048) -> DataFrame:
    """(id, bit) for every word: the first 32 bits of its md5, modulo n_bits."""
    words = spread_small(df.select(F.col(key).alias("id"), F.col(text).alias("_text"))).select("id", F.explode(F.split("_text", r"[ \n]+")).alias("word"))
    return words.where("word <> ''").select(
        "id", (F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % n_bits).cast("int").alias("bit")
    )


def word_bits(df: DataFrame, key: str, text: str, n_bits: int = 2048) -> DataFrame:
    """(id, fp, popcnt) from the words of a text column."""
    return B.words_from_rows(word_rows(df, key, text, n_bits), "id", "bit", n_bits)


def document_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bits(table(spark, sf_dir, "documents"), "doc_id", "text")


def benchmark_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bits(table(spark, sf_dir, "benchmark"), "item_id", "text")
