"""Element dimension: symbols, weights and default valences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (periodic table; index = atomic number, 0 = wildcard atom).
SYMBOLS = (
    "",
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne",
    "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K", "Ca",
    "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn",
    "Ga", "Ge", "As", "Se", "Br", "Kr", "Rb", "Sr", "Y", "Zr",
    "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn",
    "Sb", "Te", "I", "Xe", "Cs", "Ba", "La", "Ce", "Pr", "Nd",
    "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb",
    "Lu", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg",
    "Tl", "Pb", "Bi", "Po", "At", "Rn", "Fr", "Ra", "Ac", "Th",
    "Pa", "U", "Np", "Pu", "Am", "Cm", "Bk", "Cf", "Es", "Fm",
    "Md", "No", "Lr", "Rf", "Db", "Sg", "Bh", "Hs", "Mt", "Ds",
    "Rg", "Cn", "Nh", "Fl", "Mc", "Lv", "Ts", "Og",
)

# Fixed values (standard atomic weights, same index).
WEIGHTS = (
    0.0,
    1.008, 4.0026, 6.94, 9.0122, 10.81, 12.011, 14.007, 15.999, 18.998, 20.180,
    22.990, 24.305, 26.982, 28.085, 30.974, 32.06, 35.45, 39.948, 39.098, 40.078,
    44.956, 47.867, 50.942, 51.996, 54.938, 55.845, 58.933, 58.693, 63.546, 65.38,
    69.723, 72.630, 74.922, 78.971, 79.904, 83.798, 85.468, 87.62, 88.906, 91.224,
    92.906, 95.95, 98.0, 101.07, 102.91, 106.42, 107.87, 112.41, 114.82, 118.71,
    121.76, 127.60, 126.90, 131.29, 132.91, 137.33, 138.91, 140.12, 140.91, 144.24,
    145.0, 150.36, 151.96, 157.25, 158.93, 162.50, 164.93, 167.26, 168.93, 173.05,
    174.97, 178.49, 180.95, 183.84, 186.21, 190.23, 192.22, 195.08, 196.97, 200.59,
    204.38, 207.2, 208.98, 209.0, 210.0, 222.0, 223.0, 226.0, 227.0, 232.04,
    231.04, 238.03, 237.0, 244.0, 243.0, 247.0, 247.0, 251.0, 252.0, 257.0,
    258.0, 259.0, 266.0, 267.0, 268.0, 269.0, 270.0, 269.0, 278.0, 281.0,
    282.0, 285.0, 286.0, 289.0, 290.0, 293.0, 294.0, 294.0,
)

# Fixed values (single default valence per element; others get no implicit H).
VALENCES = {
    "H": 1, "B": 3, "C": 4, "N": 3, "O": 2, "F": 1,
    "P": 3, "S": 2, "Cl": 1, "Br": 1, "I": 1,
}

# Fixed values (elements that may be written without brackets).
ORGANIC_SUBSET = ("B", "C", "N", "O", "F", "P", "S", "Cl", "Br", "I")

Z = {s: z for z, s in enumerate(SYMBOLS) if s}


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def symbol(z: Column) -> Column:
    """Symbol of an atomic number; ``??`` outside 0..118."""
    return F.when(z.between(0, 118), F.element_at(_lit_array(SYMBOLS), z + 1)).otherwise("??")


def weight(z: Column) -> Column:
    """Atomic weight; 0.0 outside 0..118."""
    return F.when(z.between(0, 118), F.element_at(_lit_array(WEIGHTS), z + 1)).otherwise(0.0)


def number(sym: Column) -> Column:
    """Atomic number of a symbol; 0 when unknown or empty."""
    return F.array_position(_lit_array(SYMBOLS[1:]), sym).cast("int")


def default_valence(z: Column) -> Column:
    out = None
    for s, v in VALENCES.items():
        out = F.when(z == Z[s], v) if out is None else out.when(z == Z[s], v)
    return out.otherwise(0)


def is_organic_subset(z: Column) -> Column:
    return z.isin([Z[s] for s in ORGANIC_SUBSET])


def element_table(spark: SparkSession) -> DataFrame:
    """The 119-row element dimension (a fixed size, so safe to broadcast)."""
    rows = [(z, s, WEIGHTS[z], VALENCES.get(s, 0), s in ORGANIC_SUBSET) for z, s in enumerate(SYMBOLS)]
    return spark.createDataFrame(
        rows, "z int, symbol string, weight double, valence int, organic boolean"
    )
