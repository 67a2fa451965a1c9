"""Fixed-length deltas: blocks of 32 with a first code, a width, signs, and magnitudes of that width."""

from __future__ import annotations

import struct

import numpy as np

from fieldloom.operators.codecs.packing import pack, read_shape, shape_bytes, unpack

BLOCK = 32


def encode(values: np.ndarray, eb: float) -> bytes:
    flat = np.ascontiguousarray(values, "<f4").ravel().astype(float)
    code = np.clip(np.rint(flat / (2 * eb)), -(2.0**40), 2.0**40).astype(np.int64)  # past 2^30 it is not used
    back = (code * (2 * eb)).astype("<f4").astype(float)
    if len(code) and (np.abs(code).max() >= 2**30 or np.abs(back - flat).max() > eb):  # finer than a float's digits
        return pack(shape_bytes(values.shape), b"", np.ascontiguousarray(values, "<f4").tobytes())
    out = []
    for at in range(0, len(code), BLOCK):
        own = code[at : at + BLOCK]
        step = np.diff(own)
        width = int(np.abs(step).max()).bit_length() if len(step) else 0
        out.append(struct.pack("<iB", int(own[0]), width))
        if width:
            out.append(np.packbits(step < 0).tobytes())
            bits = (np.abs(step)[:, None] >> np.arange(width)[::-1]) & 1
            out.append(np.packbits(bits.astype(np.uint8).ravel()).tobytes())
    return pack(shape_bytes(values.shape), struct.pack("<d", eb), b"".join(out))


def decode(data: bytes) -> np.ndarray:
    shape, eb, body = unpack(data)
    shape = read_shape(shape)
    n = int(np.prod(shape))
    if not eb:
        return np.frombuffer(body, "<f4").reshape(shape).copy()
    eb, out, at = struct.unpack("<d", eb)[0], np.empty(n), 0
    for begin in range(0, n, BLOCK):
        size = min(BLOCK, n - begin)
        first, width = struct.unpack_from("<iB", body, at)
        at += 5
        step = np.zeros(size - 1, np.int64)
        if width:
            k = -(-(size - 1) // 8)
            sign = np.unpackbits(np.frombuffer(body, np.uint8, k, at), count=size - 1)
            at += k
            k = -(-(size - 1) * width // 8)
            bits = np.unpackbits(np.frombuffer(body, np.uint8, k, at), count=(size - 1) * width).reshape(-1, width)
            at += k
            step = (bits.astype(np.int64) << np.arange(width)[::-1]).sum(axis=1) * np.where(sign, -1, 1)
        out[begin : begin + size] = np.r_[first, first + np.cumsum(step)]
    return (out * (2 * eb)).astype("<f4").reshape(shape)
