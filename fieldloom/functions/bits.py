"""Bit-level functions of floats and the small integer formulas of the coders, as columns."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift_right(c: Column, by: Column) -> Column:
    """Logical shift by a column of bit counts."""
    return F.call_function("shiftrightunsigned", c, by.cast("int"))


def float_bits(c: Column) -> Column:
    """The raw bits of a float as an int."""
    return F.call_function("reflect", F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), c.cast("float")).cast("int")


def bits_float(c: Column) -> Column:
    return F.call_function("reflect", F.lit("java.lang.Float"), F.lit("intBitsToFloat"), c.cast("int")).cast("float")


def exponent(bits: Column) -> Column:
    """The unbiased exponent of a float from its bits."""
    return F.shiftrightunsigned(bits, 23).bitwiseAND(F.lit(255)) - 127


def exponent_of_bound(eb: float) -> int:
    """The unbiased exponent of a double."""
    return (struct.unpack("<Q", struct.pack("<d", eb))[0] >> 52 & 2047) - 1023


def required_length(radius_exponent: Column, bound_exponent: int) -> Column:
    """Bits that keep a value within the bound, before capping at 32; at least 9."""
    return F.greatest(F.lit(9), 9 + radius_exponent - bound_exponent + 1)


def lose_mantissa_bits(c: Column, bits: Column) -> Column:
    """Clear low bits of a float: as many as 32 less those of the mask 0xFFFFFFFF >> (23 - bits) leave."""
    mask = F.expr("-1")
    cleared = shift_right(mask, 23 - bits)
    return bits_float(float_bits(c).bitwiseAND(F.bitwise_not(cleared)))


def whole(x: Column) -> Column:
    """Truncation; what a search tries far below a float's digits stays within a long."""
    return F.greatest(F.least(x, F.lit(4e18)), F.lit(-4e18)).cast("long")


def quantize_half_away(c: Column, eb: float) -> Column:
    """Steps of 2 eb: truncation of x + 0.5, one less below -0.5."""
    x = c.cast("double") * (0.5 / eb)
    return whole(x + 0.5) - F.when(x < -0.5, F.lit(1)).otherwise(F.lit(0))


def quantize_truncate(c: Column, eb: float) -> Column:
    return whole(c.cast("double") * (1 / eb))


def sign_bytes(n: int) -> int:
    return -(-n // 8)


def saved_bit_bytes(n: int, bits: Column) -> Column:
    """Bytes of n magnitudes of some bits each: whole bytes apart, the rest packed."""
    rest = bits % 8
    return F.floor(bits / 8) * n + F.when(rest == 0, F.lit(0)).otherwise(F.floor((rest * n - 1) / 8) + 1)


def bit_width(c: Column) -> Column:
    return F.when(c == 0, F.lit(0)).otherwise(F.length(F.bin(c.cast("long"))))


def leading_zeros(c: Column) -> Column:
    return 32 - bit_width(c)


def leading_bytes(xored: Column) -> Column:
    """Whole leading bytes that two values share, from their exclusive or; at most 3."""
    return (
        F.when(F.shiftrightunsigned(xored, 8) == 0, F.lit(3))
        .when(F.shiftrightunsigned(xored, 16) == 0, F.lit(2))
        .when(F.shiftrightunsigned(xored, 24) == 0, F.lit(1))
        .otherwise(F.lit(0))
    )


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def logit(c: Column, edge: float = 1e-7) -> Column:
    x = F.least(F.greatest(c, F.lit(edge)), F.lit(1 - edge))
    return F.log(x / (1 - x))


def arctanh(c: Column, edge: float = 1e-7) -> Column:
    x = F.least(F.greatest(c, F.lit(edge - 1)), F.lit(1 - edge))
    return 0.5 * F.log((1 + x) / (1 - x))


def level_bound(eb: float, level: int, alpha: float = -1.0, beta: float = -1.0, ratio: float = 0.5) -> float:
    """The bound of an interpolation level."""
    if alpha < 0:
        return eb * ratio if level >= 3 else eb
    if alpha >= 1:
        return eb / min(alpha ** (level - 1), beta)
    return eb * max(1 - (level - 1) * alpha, beta)


def interpolation_levels(dims: tuple[int, ...]) -> int:
    return max(math.ceil(math.log2(d)) if d > 1 else 0 for d in dims)


def wavelet_levels(length: int) -> int:
    return 0 if length < 8 else min(6, int(math.floor(math.log2(length / 8))) + 1)


def band_lengths(length: int, level: int) -> tuple[int, int]:
    """(low, high) lengths after some halvings."""
    high = 0
    for _ in range(level):
        high = length // 2
        length -= high
    return length, high


def power_of_two_up(x: int) -> int:
    return 1 << max(0, (x - 1).bit_length())


def big_endian(value: int | float, kind: str) -> bytes:
    return struct.pack(">" + kind, value)


def truncate_float(c: Column, keep_bytes: int) -> Column:
    """A float with its low bytes cleared."""
    return bits_float(float_bits(c).bitwiseAND(F.lit(-1 << 8 * (4 - keep_bytes) if keep_bytes else 0)))
