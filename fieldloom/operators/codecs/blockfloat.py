"""Blocks of 128 around their middle: constant ones take a float, others the high bytes that the bound needs."""

from __future__ import annotations

import math
import struct

import numpy as np

from fieldloom.operators.codecs.packing import pack, read_shape, shape_bytes, unpack

BLOCK = 128


def encode(values: np.ndarray, eb: float) -> bytes:
    flat = np.ascontiguousarray(values, "<f4").ravel()
    out = []
    for at in range(0, len(flat), BLOCK):
        own = flat[at : at + BLOCK]
        low, high = float(own.min()), float(own.max())
        middle = np.float32(low + (high - low) / 2)
        if max(high - float(middle), float(middle) - low) <= eb:
            out.append(struct.pack("<Bf", 0, middle))
            continue
        rest = own - middle
        for keep in range(1, 5):
            mask = np.uint32((0xFFFFFFFF << 8 * (4 - keep)) & 0xFFFFFFFF)
            back = ((rest.view("<u4") & mask).view("<f4") + middle).astype("<f4")
            if np.abs(back.astype(float) - own.astype(float)).max() <= eb:
                break
        else:
            keep, middle, rest = 5, np.float32(0), own  # not even the whole difference holds: the values themselves
        k = min(keep, 4)
        words = rest.astype("<f4").view("<u4") >> np.uint32(8 * (4 - k))
        xored = words ^ np.r_[np.uint32(0), words[:-1]]
        lead = np.zeros(len(own), np.uint8)
        for j in range(1, k + 1):
            lead[(xored >> np.uint32(8 * (k - j))) == 0] = min(j, 3)
        tails = [int(w).to_bytes(k, "big")[n:] for w, n in zip(words.tolist(), lead.tolist(), strict=True)]
        out.append(struct.pack("<Bf", keep, middle) + np.packbits(((lead[:, None] >> [1, 0]) & 1).astype(np.uint8).ravel()).tobytes() + b"".join(tails))
    return pack(shape_bytes(values.shape), b"".join(out))


def decode(data: bytes) -> np.ndarray:
    shape, body = unpack(data)
    shape = read_shape(shape)
    n = math.prod(shape)
    out, at = np.empty(n, "<f4"), 0
    for begin in range(0, n, BLOCK):
        size = min(BLOCK, n - begin)
        keep, middle = struct.unpack_from("<Bf", body, at)
        at += 5
        if not keep:
            out[begin : begin + size] = middle
            continue
        k, m = min(keep, 4), -(-2 * size // 8)
        lead = np.unpackbits(np.frombuffer(body, np.uint8, m, at), count=2 * size).reshape(-1, 2) @ [2, 1]
        at += m
        words, before = np.empty(size, "<u4"), bytes(k)
        for i, j in enumerate(lead.tolist()):
            before = before[:j] + body[at : at + k - j]
            at += k - j
            words[i] = int.from_bytes(before, "big") << 8 * (4 - k)
        out[begin : begin + size] = words.view("<f4") + np.float32(middle)
    return out.reshape(shape)
