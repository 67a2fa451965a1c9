"""Multilevel interpolation: coarse to fine, every point predicted from points already decoded.

Coarser levels may have smaller bounds than the finest, by alpha and beta of level_bound(); with both 1 all have the bound itself.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from fieldloom.functions.bits import level_bound
from fieldloom.operators.codecs.packing import huffman_decode, huffman_encode, pack, read_shape, shape_bytes, squeeze, unpack, unsqueeze

RADIUS = 32768


def passes(shape: tuple[int, ...]):
    """(level, axis, stride) from the coarsest level on."""
    top = max((math.ceil(math.log2(d)) if d > 1 else 0 for d in shape), default=0)
    for level in range(top, 0, -1):
        for axis in range(len(shape)):
            yield level, axis, 1 << (level - 1)


def lines(shape: tuple[int, ...], axis: int, s: int) -> tuple[slice, ...]:
    """The grid that a pass works on: earlier axes at its stride, later ones at twice it, the axis itself at its stride."""
    return tuple(slice(None, None, s if i <= axis else 2 * s) for i in range(len(shape)))


def predict(grid: np.ndarray, straight: bool = False) -> np.ndarray:
    """Odd points along the first axis from even ones: cubic inside, lower order at the edges; or linear."""
    n = grid.shape[0]
    i = np.arange(1, n, 2)

    def at(k: int) -> np.ndarray:
        return grid[np.clip(i + k, 0, n - 1 - (n - 1) % 2)]

    shape = (-1,) + (1,) * (grid.ndim - 1)

    def where(c: np.ndarray) -> np.ndarray:
        return c.reshape(shape)

    linear = (at(-1) + at(1)) / 2
    if straight:
        return np.where(where(i + 1 >= n), at(-1), linear)
    cubic = (-at(-3) + 9 * at(-1) + 9 * at(1) - at(3)) / 16
    front, back = (3 * at(-1) + 6 * at(1) - at(3)) / 8, (-at(-3) + 6 * at(-1) + 3 * at(1)) / 8
    out = np.where(where((i >= 3) & (i + 3 < n)), cubic, linear)
    out = np.where(where((i < 3) & (i + 3 < n)), front, out)
    out = np.where(where((i >= 3) & (i + 3 >= n) & (i + 1 < n)), back, out)
    return np.where(where(i + 1 >= n), np.where(where(i >= 3), -0.5 * at(-3) + 1.5 * at(-1), at(-1)), out)


def encode(values: np.ndarray, eb: float, alpha: float = 1.0, beta: float = 1.0, linear: bool = False) -> bytes:
    return encode_and_decode(values, eb, alpha, beta, linear)[0]


def encode_and_decode(values: np.ndarray, eb: float, alpha: float = 1.0, beta: float = 1.0, linear: bool = False) -> tuple[bytes, np.ndarray]:
    """What encode() gives, and what decode() makes of that: points are predicted from decoded ones, so coding has them all."""
    bound, work = eb, np.ascontiguousarray(values, "<f4").astype(float)
    first = float(work.flat[0]) if work.size else 0.0
    codes, raw = [], []
    for level, axis, s in passes(work.shape):
        grid = np.moveaxis(work[lines(work.shape, axis, s)], axis, 0)
        if grid.shape[0] < 2:
            continue
        eb = level_bound(bound, level, alpha, beta)
        guess, true = predict(grid, linear), grid[1::2]
        step = np.rint((true - guess) / (2 * eb)) if eb > 0 else np.full(true.shape, float(RADIUS))
        step = np.clip(np.nan_to_num(step, nan=RADIUS, posinf=RADIUS, neginf=-RADIUS), -RADIUS, RADIUS)
        back = (guess + 2 * eb * step).astype("<f4").astype(float)
        bad = ~((np.abs(step) < RADIUS) & (np.abs(back - true) <= eb))
        codes.append(np.where(bad, 0, step + RADIUS).astype(np.int64).ravel())
        raw.append(true[bad].astype("<f4"))
        grid[1::2] = np.where(bad, true, back)
    coded = huffman_encode(np.concatenate(codes) if codes else np.zeros(0, np.int64))
    return pack(shape_bytes(values.shape), struct.pack("<dfdd?", bound, first, alpha, beta, linear), squeeze(coded), squeeze(b"".join(r.tobytes() for r in raw))), work.astype("<f4")


def decode(data: bytes) -> np.ndarray:
    shape, head, coded, raw = unpack(data)
    shape = read_shape(shape)
    bound, first, alpha, beta, linear = struct.unpack("<dfdd?", head)
    codes, rest = huffman_decode(unsqueeze(coded)), np.frombuffer(unsqueeze(raw), "<f4").astype(float)
    work = np.zeros(shape)
    if work.size:
        work.flat[0] = first
    at = used = 0
    for level, axis, s in passes(shape):
        grid = np.moveaxis(work[lines(shape, axis, s)], axis, 0)
        if grid.shape[0] < 2:
            continue
        eb = level_bound(bound, level, alpha, beta)
        guess = predict(grid, linear)
        own = codes[at : at + guess.size].reshape(guess.shape)
        at += guess.size
        bad = own == 0
        back = (guess + 2 * eb * (own - RADIUS)).astype("<f4").astype(float)
        back[bad] = rest[used : used + int(bad.sum())]
        used += int(bad.sum())
        grid[1::2] = back
    return work.astype("<f4")
