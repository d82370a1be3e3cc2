"""Bit-set fingerprints held as ``array<bigint>`` (64 bits per word).

All functions are length-agnostic Column expressions.  Where the query side is
a Python list of words, ``*_literal`` variants unroll the words so that the
work stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elements import _lit_array


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v)


def set_bit(fp, pos: int) -> Column:
    """Copy of the fingerprint with one bit on."""
    return F.transform(
        _col(fp),
        lambda w, i: F.when(i == pos // 64, w.bitwiseOR(F.shiftleft(F.lit(1).cast("bigint"), pos % 64))).otherwise(w),
    )


def clear_bit(fp, pos: int) -> Column:
    """Copy of the fingerprint with one bit off."""
    return F.transform(
        _col(fp),
        lambda w, i: F.when(
            i == pos // 64, w.bitwiseAND(F.bitwise_not(F.shiftleft(F.lit(1).cast("bigint"), pos % 64)))
        ).otherwise(w),
    )


def get_bit(fp, pos: int) -> Column:
    return F.getbit(F.element_at(_col(fp), pos // 64 + 1), F.lit(pos % 64)) == 1


def popcount(fp) -> Column:
    return _fold_sum(F.transform(_col(fp), F.bit_count))


def intersection(x, y) -> Column:
    return _fold_sum(F.zip_with(_col(x), _col(y), lambda a, b: F.bit_count(a.bitwiseAND(b))))


def union_count(x, y) -> Column:
    return _fold_sum(F.zip_with(_col(x), _col(y), lambda a, b: F.bit_count(a.bitwiseOR(b))))


def hamming(x, y) -> Column:
    return _fold_sum(F.zip_with(_col(x), _col(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))))


def is_subset(x, y) -> Column:
    """Every bit of x is also in y (the empty set is a subset of all)."""
    return F.forall(
        F.zip_with(_col(x), _col(y), lambda a, b: a.bitwiseAND(F.bitwise_not(b))), lambda w: w == 0
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def tanimoto_counts(common: Column, nx: Column, ny: Column) -> Column:
    return _ratio(common, nx + ny - common)


def dice_counts(common: Column, nx: Column, ny: Column) -> Column:
    return _ratio(2 * common, nx + ny)


def cosine_counts(common: Column, nx: Column, ny: Column) -> Column:
    return _ratio(common, F.sqrt(nx.cast("double") * ny))


def tversky_counts(common: Column, nx: Column, ny: Column, alpha: float, beta: float) -> Column:
    return _ratio(common, alpha * (nx - common) + beta * (ny - common) + common)


def tanimoto(x, y, nx=None, ny=None) -> Column:
    """Common bits over all bits; stored popcounts are used when given."""
    return tanimoto_counts(
        intersection(x, y), popcount(x) if nx is None else _col(nx), popcount(y) if ny is None else _col(ny)
    )


def dice(x, y) -> Column:
    return dice_counts(intersection(x, y), popcount(x), popcount(y))


def cosine(x, y) -> Column:
    return cosine_counts(intersection(x, y), popcount(x), popcount(y))


def tversky(x, y, alpha: float, beta: float) -> Column:
    return tversky_counts(intersection(x, y), popcount(x), popcount(y), alpha, beta)


def intersection_literal(fp, words: Sequence[int]) -> Column:
    """Common bits with a constant fingerprint; zero words cost nothing."""
    terms = [
        F.bit_count(F.element_at(_col(fp), i + 1).bitwiseAND(F.lit(int(w)).cast("bigint")))
        for i, w in enumerate(words)
        if w
    ]
    return sum(terms[1:], terms[0]) if terms else F.lit(0)


def on_bits(fp) -> Column:
    """Ascending positions of the set bits."""
    return F.flatten(
        F.transform(
            _col(fp),
            lambda w, i: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w, b) == 1), lambda b: i * 64 + b
            ),
        )
    )


def from_bits(bits, n_bits: int) -> Column:
    """Words of a list of bit positions (repeats allowed)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bits // 64 - 1)),
        lambda k: F.aggregate(
            F.filter(_col(bits), lambda b: F.floor(b / 64) == k),
            F.lit(0).cast("bigint"),
            lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (b % 64).cast("int"))),
        ),
    )


def fold_hashes(hashes, n_bits: int) -> Column:
    """Distinct bit positions of hashed features."""
    return F.array_distinct(F.transform(_col(hashes), lambda h: (h % n_bits).cast("int")))


def words_from_rows(df: DataFrame, key: str, bit: str, n_bits: int) -> DataFrame:
    """Fingerprint per key from (key, bit) rows: one shuffle, with the OR of
    the words already taken on the map side."""
    one = F.lit(1).cast("bigint")
    mask = F.call_function("shiftleft", one, (F.col(bit) % 64).cast("int"))
    word = F.floor(F.col(bit) / 64)
    aggs = [F.bit_or(F.when(word == k, mask).otherwise(F.lit(0).cast("bigint"))).alias(f"_w{k}") for k in range(n_bits // 64)]
    wide = df.groupBy(key).agg(*aggs)
    fp = F.array(*[f"_w{k}" for k in range(n_bits // 64)])
    return wide.select(key, fp.alias("fp")).withColumn("popcnt", popcount("fp"))


def sparse_intersection(a, b) -> Column:
    return F.size(F.array_intersect(_col(a), _col(b)))


def sparse_tanimoto(a, b) -> Column:
    common = sparse_intersection(a, b)
    return tanimoto_counts(common, F.size(_col(a)), F.size(_col(b)))


def bool_tanimoto(x, y) -> Column:
    """Tanimoto of two ``array<boolean>`` columns."""
    def count(f):
        return F.size(F.filter(F.zip_with(_col(x), _col(y), f), lambda v: v))

    return _ratio(count(lambda a, b: a & b), count(lambda a, b: a | b))


def bit_and(x, y) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a.bitwiseAND(b))


def bit_or(x, y) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a.bitwiseOR(b))


def bit_xor(x, y) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a.bitwiseXOR(b))


def packed_bytes(fp, bitorder: str = "little") -> Column:
    """Hex text of the packed bytes: bit b sits in byte b div 8.

    ``little`` puts bit b at position b mod 8 of its byte, ``big`` mirrors it.
    """
    nibble = "0123456789ABCDEF"

    def byte(w, k):
        v = F.call_function("shiftrightunsigned", w, k * 8).bitwiseAND(F.lit(255))
        if bitorder == "big":
            v = F.aggregate(
                F.sequence(F.lit(0), F.lit(7)),
                F.lit(0).cast("bigint"),
                lambda acc, b: acc * 2 + F.call_function("shiftright", v, b).bitwiseAND(F.lit(1)),
            )
        table = _lit_array(list(nibble))
        return F.concat(
            F.element_at(table, (F.floor(v / 16) + 1).cast("int")), F.element_at(table, (v % 16 + 1).cast("int"))
        )

    return F.array_join(
        F.flatten(F.transform(_col(fp), lambda w: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: byte(w, k)))), ""
    )


def packed_binary(fp, bitorder: str = "little") -> Column:
    """The packed bytes as BINARY, one row of a fingerprint matrix."""
    return F.unhex(packed_bytes(fp, bitorder))


def unpacked(packed, bitorder: str = "little") -> Column:
    """Words of packed bytes (BINARY), the inverse of :func:`packed_binary`.

    Bytes missing from the last word count as zero.
    """
    text = F.hex(_col(packed))
    n_words = F.ceil(F.length(text) / 16).cast("int")
    text = F.rpad(text, n_words * 16, F.lit("0"))
    if bitorder == "big":  # bits of a byte mirrored: halves swapped, each mirrored
        text = F.regexp_replace(F.translate(text, "0123456789ABCDEF", "084C2A6E195D3B7F"), "(.)(.)", "$2$1")

    def word(k):
        return F.conv(F.concat(*[F.substring(text, k * 16 + 15 - 2 * b, F.lit(2)) for b in range(8)]), 16, -10).cast("bigint")

    return F.when(n_words > 0, F.transform(F.sequence(F.lit(0), n_words - 1), word)).otherwise(F.array().cast("array<bigint>"))


def packbits(flags) -> Column:
    """Bytes (0 to 255) of a list of booleans, the first in the highest bit of
    its byte; the last byte is filled up with zeros, null counts as false."""
    flags = _col(flags)
    at = lambda k, j: F.when(F.get(flags, k * 8 + j), F.lit(1 << (7 - j))).otherwise(0)
    byte = lambda k: sum((at(k, j) for j in range(1, 8)), at(k, 0))
    n = F.ceil(F.size(flags) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).when(n == 0, F.array().cast("array<int>"))


# --- single 64-bit words -----------------------------------------------------

def countl_zero(w) -> Column:
    return F.when(_col(w) == 0, 64).otherwise(64 - F.length(F.bin(_col(w))))


def countr_zero(w) -> Column:
    text = F.bin(_col(w))
    return F.when(_col(w) == 0, 64).otherwise(F.length(text) - F.length(F.regexp_replace(text, "0+$", "")))


def countl_one(w) -> Column:
    return countl_zero(F.bitwise_not(_col(w)))


def countr_one(w) -> Column:
    return countr_zero(F.bitwise_not(_col(w)))


def has_single_bit(w) -> Column:
    return F.bit_count(_col(w)) == 1


def bit_width(w) -> Column:
    return 64 - countl_zero(w)


def bit_floor(w) -> Column:
    one = F.lit(1).cast("bigint")
    return F.when(_col(w) == 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftleft", one, (bit_width(w) - 1).cast("int"))
    )


def bit_ceil(w) -> Column:
    """The least power of two not below ``w``, read as unsigned; null if that is 2^64."""
    w = _col(w)
    exponent = F.when(w == 0, 0).when(has_single_bit(w), bit_width(w) - 1).otherwise(bit_width(w)).cast("int")
    return F.when(exponent < 64, F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent))


def rotl(w, s: int) -> Column:
    s %= 64
    return F.shiftleft(_col(w), s).bitwiseOR(F.shiftrightunsigned(_col(w), (64 - s) % 64)) if s else _col(w)


def rotr(w, s: int) -> Column:
    return rotl(w, 64 - s % 64)
