"""The rest of the byte and bit kit: conversions, flags, shared leading bytes, and quantization steps."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.bits import bits_float, float_bits, shift_right


def to_bytes(values: np.ndarray, big_endian: bool = True) -> bytes:
    """Any of the ten types in either byte order."""
    return values.astype(values.dtype.newbyteorder(">" if big_endian else "<")).tobytes()


def from_bytes(data: bytes, kind: str, big_endian: bool = True) -> np.ndarray:
    return np.frombuffer(data, np.dtype(kind).newbyteorder(">" if big_endian else "<")).astype(kind)


def pack_flags(flags: np.ndarray) -> bytes:
    """Eight flags a byte, the first highest; a rest fills a byte of its own."""
    return np.packbits(flags.astype(bool)).tobytes()


def unpack_flags(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def mask_code(bits: int) -> int:
    """A byte whose lowest bits are set."""
    return (1 << bits) - 1


def bit_string(c: Column) -> Column:
    """A float's 32 bits as text."""
    return F.lpad(F.bin(float_bits(c).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 32, "0")


def shared_leading_bytes(a: Column, b: Column) -> Column:
    """Whole leading bytes that two floats share, 0 to 4."""
    x = float_bits(a).bitwiseXOR(float_bits(b))
    return F.when(x == 0, 4).when(F.shiftrightunsigned(x, 8) == 0, 3).when(F.shiftrightunsigned(x, 16) == 0, 2).when(F.shiftrightunsigned(x, 24) == 0, 1).otherwise(0)


def strip_shared(a: Column, b: Column) -> Column:
    """The bits of b that a reader who has a still needs, as a number."""
    n = shared_leading_bytes(a, b)
    keep = F.when(n == 4, F.lit(0)).otherwise(shift_right(F.lit(-1), (8 * n).cast("int")))
    return float_bits(b).bitwiseAND(keep)


def join_shared(a: Column, rest: Column, n: Column) -> Column:
    """The inverse of strip_shared()."""
    keep = F.when(n == 4, F.lit(0)).otherwise(shift_right(F.lit(-1), (8 * n).cast("int")))
    return bits_float(float_bits(a).bitwiseAND(F.bitwise_not(keep)).bitwiseOR(rest))


def factorial(n: int) -> int:
    return math.factorial(n)


def finest_step_pwe(bound: float) -> float:
    """The last quantization step of a coder that keeps a pointwise bound."""
    return 1.5 * bound


def finest_step_psnr(coefficients: np.ndarray, psnr: float, range_: float) -> float:
    """The largest step, by quarter powers of two, whose rounding error meets a quality."""
    target = range_ * 10 ** (-psnr / 20)
    step = float(np.abs(coefficients).max()) or 1.0
    while step > 1e-300 and math.sqrt(float(np.mean((coefficients - step * np.rint(coefficients / step)) ** 2))) > target:
        step /= 2**0.25
    return step


def double_halves(x: float) -> tuple[int, int]:
    return struct.unpack(">II", struct.pack(">d", x))
