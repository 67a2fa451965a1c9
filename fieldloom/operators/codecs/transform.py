"""Transform coding of blocks of 4^d: common exponent, integer lifting, negabinary bit planes down to the tolerance."""

from __future__ import annotations

import itertools
import math
import struct

import numpy as np

from fieldloom.operators.codecs.packing import Bits, pack, read_shape, shape_bytes, squeeze, unpack, unsqueeze

PRECISION = 30
NEGABINARY = 0xAAAAAAAA


def lift(a: np.ndarray, axis: int) -> None:
    x, y, z, w = (np.take(a, i, axis=axis) for i in range(4))
    x = (x + w) >> 1
    w = w - x
    z = (z + y) >> 1
    y = y - z
    x = (x + z) >> 1
    z = z - x
    w = (w + y) >> 1
    y = y - w
    w = w + (y >> 1)
    y = y - (w >> 1)
    np.moveaxis(a, axis, 0)[:] = np.stack([x, y, z, w])


def unlift(a: np.ndarray, axis: int) -> None:
    x, y, z, w = (np.take(a, i, axis=axis) for i in range(4))
    y = y + (w >> 1)
    w = w - (y >> 1)
    y = y + w
    w = (w << 1) - y
    z = z + x
    x = (x << 1) - z
    y = y + z
    z = (z << 1) - y
    w = w + x
    x = (x << 1) - w
    np.moveaxis(a, axis, 0)[:] = np.stack([x, y, z, w])


def sequency(rank: int) -> np.ndarray:
    """Places of a block by the sum of their frequencies."""
    places = list(itertools.product(range(4), repeat=rank))
    return np.array(sorted(range(len(places)), key=lambda i: (sum(places[i]), sum(p * p for p in places[i]), i)))


def planes_kept(exponent: int, tolerance: int, rank: int) -> int:
    """Bit planes to code: those above the tolerance, with guard bits for the transform's gain."""
    return max(0, min(32, exponent - tolerance + 2 * (rank + 1)))


def code_planes(u: list[int], kept: int, bits: Bits) -> None:
    n_known = 0
    for plane in range(31, 31 - kept, -1):
        row = [x >> plane & 1 for x in u]
        for i in range(n_known):
            bits.put(row[i])
        while n_known < len(u) and bits.put(int(any(row[n_known:]))):
            while n_known < len(u) - 1 and not bits.put(row[n_known]):
                n_known += 1
            n_known += 1


def read_planes(size: int, kept: int, bits: Bits) -> list[int]:
    u, n_known = [0] * size, 0
    for plane in range(31, 31 - kept, -1):
        for i in range(n_known):
            u[i] |= bits.get() << plane
        while n_known < size and bits.get():
            while n_known < size - 1 and not bits.get():
                n_known += 1
            u[n_known] |= 1 << plane
            n_known += 1
    return u


def encode(values: np.ndarray, eb: float) -> bytes:
    rank = values.ndim
    x = np.pad(np.ascontiguousarray(values, "<f4").astype(float), [(0, -d % 4) for d in values.shape], mode="edge")
    tolerance = math.frexp(eb)[1] - 1 if eb > 0 else -1074
    order, bits, raw = sequency(rank), Bits(), []
    for start in itertools.product(*(range(0, d, 4) for d in x.shape)):
        block = x[tuple(slice(s, s + 4) for s in start)]
        top = float(np.abs(block).max())
        exponent = math.frexp(top)[1] if top else -1074
        kept = planes_kept(exponent, tolerance, rank)
        if not bits.put(int(kept > 0)):
            continue
        whole = np.rint(block * 2.0 ** (PRECISION - exponent)).astype(np.int64)
        for axis in range(rank):
            lift(whole, axis)
        u = ((whole.ravel()[order] + NEGABINARY) & 0xFFFFFFFF) ^ NEGABINARY
        mark = len(bits.bits)
        for k in range(11):
            bits.put((exponent + 1074) >> k & 1)
        code_planes(u.tolist(), kept, bits)
        back = restore(read_planes(len(u), kept, Bits.of(bits.bits[mark + 11 :])), exponent, order, rank)
        if np.abs(back.astype("<f4").astype(float) - block).max() > eb:  # past a float's digits: store it as it is
            del bits.bits[mark:]
            for _ in range(11):
                bits.put(1)
            raw.append(block.astype("<f4").tobytes())
    return pack(shape_bytes(values.shape), struct.pack("<i", tolerance), squeeze(bits.tobytes()), squeeze(b"".join(raw)))


def restore(u: list[int], exponent: int, order: np.ndarray, rank: int) -> np.ndarray:
    flat = np.zeros(len(u), np.int64)
    raw = np.array(u, np.int64)
    flat[order] = (((raw ^ NEGABINARY) - NEGABINARY + 2**31) & 0xFFFFFFFF) - 2**31
    whole = flat.reshape((4,) * rank)
    for axis in reversed(range(rank)):
        unlift(whole, axis)
    return whole * 2.0 ** (exponent - PRECISION)


def decode(data: bytes) -> np.ndarray:
    shape, head, body, raw = unpack(data)
    shape, tolerance = read_shape(shape), struct.unpack("<i", head)[0]
    rank, bits = len(shape), Bits(unsqueeze(body))
    stored, used = np.frombuffer(unsqueeze(raw), "<f4"), 0
    padded = tuple(d + -d % 4 for d in shape)
    out, order = np.zeros(padded), sequency(rank)
    for start in itertools.product(*(range(0, d, 4) for d in padded)):
        if not bits.get():
            continue
        exponent = sum(bits.get() << k for k in range(11))
        at = tuple(slice(s, s + 4) for s in start)
        if exponent == 2047:
            out[at] = stored[used : used + 4**rank].reshape((4,) * rank)
            used += 4**rank
        else:
            exponent -= 1074
            out[at] = restore(read_planes(4**rank, planes_kept(exponent, tolerance, rank), bits), exponent, order, rank)
    return out[tuple(slice(0, d) for d in shape)].astype("<f4")
