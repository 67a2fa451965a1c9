"""Arithmetic coding of integers under a static frequency table."""

from __future__ import annotations

import struct

import numpy as np

from fieldloom.operators.codecs.packing import Bits, pack, unpack

TOP, QUARTER, HALF, THREE = (1 << 32) - 1, 1 << 30, 1 << 31, 3 << 30


def encode(values: np.ndarray) -> bytes:
    symbols, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts).tolist()
    starts, total = [0, *ends[:-1]], int(counts.sum())
    low, high, waiting, bits = 0, TOP, 0, Bits()

    def out(bit: int) -> None:
        nonlocal waiting
        bits.put(bit)
        for _ in range(waiting):
            bits.put(1 - bit)
        waiting = 0

    for s in inverse.tolist():
        width = high - low + 1
        low, high = low + width * starts[s] // total, low + width * ends[s] // total - 1
        while True:
            if high < HALF:
                out(0)
            elif low >= HALF:
                out(1)
                low, high = low - HALF, high - HALF
            elif low >= QUARTER and high < THREE:
                waiting += 1
                low, high = low - QUARTER, high - QUARTER
            else:
                break
            low, high = 2 * low, 2 * high + 1
    waiting += 1
    out(int(low >= QUARTER))
    return pack(symbols.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), struct.pack("<Q", len(values)), bits.tobytes())


def decode(data: bytes) -> np.ndarray:
    symbols, counts, count, body = unpack(data)
    symbol, number = np.frombuffer(symbols, "<i8"), np.frombuffer(counts, "<i8")
    n = struct.unpack("<Q", count)[0]
    ends = np.cumsum(number)
    starts, total = (ends - number).tolist(), int(number.sum())
    bits = [*np.unpackbits(np.frombuffer(body, np.uint8)).tolist(), *[0] * 40]
    code, at = 0, 0
    for _ in range(32):
        code, at = code << 1 | bits[at], at + 1
    low, high, out = 0, TOP, np.empty(n, np.int64)
    for i in range(n):
        width = high - low + 1
        s = int(np.searchsorted(ends, ((code - low + 1) * total - 1) // width, side="right"))
        out[i] = symbol[s]
        low, high = low + width * starts[s] // total, low + width * int(ends[s]) // total - 1
        while True:
            if high < HALF:
                pass
            elif low >= HALF:
                low, high, code = low - HALF, high - HALF, code - HALF
            elif low >= QUARTER and high < THREE:
                low, high, code = low - QUARTER, high - QUARTER, code - QUARTER
            else:
                break
            low, high, code, at = 2 * low, 2 * high + 1, code << 1 | bits[min(at, len(bits) - 1)], at + 1
    return out
