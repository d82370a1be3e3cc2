"""Comma-separated output of descriptors, and field splitting of CSV lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import descriptors as D

# Header and decimals of the descriptor file.
DESCRIPTOR_COLUMNS = (
    "ID", "SMILES", "Formula", "MW", "HeavyAtoms", "HeteroAtoms", "LogP", "TPSA", "HBD", "HBA",
    "RotB", "Rings", "AromRings", "FracCsp3", "Charge", "Ro5Violations", "QED",
)


def _fixed(c: str, decimals: int) -> Column:
    # settle float noise first, so that exact ties always round up
    return F.format_string(f"%.{decimals}f", F.round(F.col(c), 9))


def descriptor_rows(df: DataFrame, ident: str = "id") -> DataFrame:
    """The 17 text columns of the descriptor file, for rows that parsed."""
    d = df.where(F.col("mol").isNotNull()).withColumn("d", D.descriptors("mol"))
    d = d.withColumns({"formula": D.molecular_formula("mol"), "ro5": D.lipinski_violations(), "qed": D.qed_score()})
    fields = (
        F.col(ident).cast("string"), F.col("smiles"), F.col("formula"), _fixed("d.mw", 3),
        F.col("d.heavy_atoms"), F.col("d.hetero_atoms"), _fixed("d.logp", 3), _fixed("d.tpsa", 2),
        F.col("d.hbd"), F.col("d.hba"), F.col("d.rotatable"), F.col("d.n_rings"), F.col("d.n_arom_rings"),
        _fixed("d.fraction_csp3", 3), F.col("d.formal_charge"), F.col("ro5"), _fixed("qed", 3),
    )
    return d.select(*[f.alias(n) for f, n in zip(fields, DESCRIPTOR_COLUMNS)])


def write_descriptors(df: DataFrame, path: str, ident: str = "id") -> None:
    """Unquoted CSV with a header, written by every task in parallel."""
    rows = descriptor_rows(df, ident)
    rows.write.mode("overwrite").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def parse_csv_line(line, delimiter: str = ",") -> Column:
    """Fields of one CSV line as an array.

    A quote opens or closes a quoted stretch wherever it stands, a doubled
    quote inside one is a quote, and carriage returns outside quotes are
    dropped.
    """
    line = F.col(line) if isinstance(line, str) else line
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(False).alias("quoted")
    )

    def step(a, t):
        # a run of quotes: outside, the first one opens; then pairs are quote
        # characters and a single one left over closes
        run = F.when(F.startswith(t, F.lit('"')), F.length(t)).otherwise(0)
        inner = F.when(a.quoted, run).otherwise(run - 1)
        cut = ~a.quoted & (t == delimiter)
        text = (
            F.when(run > 0, F.concat(a.text, F.repeat(F.lit('"'), F.floor(inner / 2).cast("int"))))
            .when(cut, F.lit(""))
            .when(~a.quoted & (t == "\r"), a.text)
            .otherwise(F.concat(a.text, t))
        )
        return F.struct(
            F.when(cut, F.array_append(a.done, a.text)).otherwise(a.done).alias("done"),
            text.alias("text"),
            F.when(run > 0, inner % 2 == 0).otherwise(a.quoted).alias("quoted"),
        )

    pieces = F.regexp_extract_all(line, F.lit(r'(?s)"+|[^"]'), 0)
    return F.aggregate(pieces, start, step, lambda a: F.array_append(a.done, a.text))
