"""Filters, staged screening and the descriptor registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import descriptors as D


def mw_range(lo: float, hi: float, column: str = "mw") -> Column:
    return F.col(column).between(lo, hi)


def logp_max(v: float, column: str = "logp") -> Column:
    return F.col(column) <= v


def tpsa_range(lo: float, hi: float, column: str = "tpsa") -> Column:
    return F.col(column).between(lo, hi)


def rotatable_max(n: int, column: str = "rotatable") -> Column:
    return F.col(column) <= n


def all_of(filters: Sequence[Column]) -> Column:
    """True where every filter holds (true for no filters)."""
    return reduce(lambda a, b: a & b, filters, F.lit(True))


def any_of(filters: Sequence[Column]) -> Column:
    """True where some filter holds (false for no filters)."""
    return reduce(lambda a, b: a | b, filters, F.lit(False))


def negate(f: Column) -> Column:
    return ~f


class StagedScreen:
    """Named filters applied one after the other, counted in a single pass."""

    def __init__(self, stages: Sequence[tuple[str, Column]] = ()):
        self.stages = list(stages)

    def add(self, name: str, condition: Column) -> StagedScreen:
        return StagedScreen([*self.stages, (name, condition)])

    def _reached(self) -> list[Column]:
        """Per stage, whether a row survives up to and including it."""
        out, so_far = [], F.lit(True)
        for _, condition in self.stages:
            so_far = so_far & F.coalesce(condition, F.lit(False))
            out.append(so_far)
        return out

    def survivors(self, df: DataFrame) -> DataFrame:
        return df.where(all_of([c for _, c in self.stages]))

    def report(self, df: DataFrame) -> DataFrame:
        """(stage, name, remaining, removed): one aggregation over the input."""
        counts = [F.count(F.lit(1)).alias("c0")]
        counts += [F.count_if(c).alias(f"c{i}") for i, c in enumerate(self._reached(), 1)]
        entries = [F.struct(F.lit(0).alias("stage"), F.lit("input").alias("name"), F.col("c0").alias("remaining"), F.lit(0).cast("bigint").alias("removed"))]
        entries += [
            F.struct(
                F.lit(i).alias("stage"), F.lit(name).alias("name"), F.col(f"c{i}").alias("remaining"),
                (F.col(f"c{i - 1}") - F.col(f"c{i}")).alias("removed"),
            )
            for i, (name, _) in enumerate(self.stages, 1)
        ]
        return df.agg(*counts).select(F.inline(F.array(*entries)))


# named calculators over a descriptor struct column ``d``
CALCULATORS: dict[str, Callable[[str], Column]] = {
    "MW": lambda d: F.col(f"{d}.mw"),
    "LogP": lambda d: F.col(f"{d}.logp"),
    "Ro5_violations": lambda d: D.lipinski_violations(d),
    "FractionCSP3": lambda d: D.estimated_fraction_csp3(F.col(f"{d}.n_rings"), F.col(f"{d}.heavy_atoms")),
}


def register_calculator(name: str, build: Callable[[str], Column]) -> None:
    """Add a calculator: a function from struct column name to Column."""
    CALCULATORS[name] = build


def calculator(name: str, d: str = "d") -> Column:
    """Value of a named descriptor; NULL for an unknown name."""
    build = CALCULATORS.get(name)
    return (build(d) if build else F.lit(None)).cast("double")


def compute_all(df: DataFrame, key: str, names: Sequence[str], d: str = "d") -> DataFrame:
    """(key, name, value) for every named calculator."""
    entries = [F.struct(F.lit(n).alias("name"), calculator(n, d).alias("value")) for n in names]
    return df.select(key, F.inline(F.array(*entries)))
