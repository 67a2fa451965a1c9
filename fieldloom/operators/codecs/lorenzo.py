"""A composed predictor by block: Lorenzo, a regression plane, or zero; quantized, Huffman-coded and squeezed.

Values are first rounded to steps of twice the bound; Lorenzo differences of whole numbers are exact, so blocks decode
with running sums.  A block takes the predictor whose codes are smallest in sum, the plane at the price of its
coefficients; values that the steps cannot hold are stored as they are.
"""

from __future__ import annotations

import itertools
import struct

import numpy as np

from fieldloom.operators.codecs.packing import huffman_decode, huffman_encode, pack, read_shape, shape_bytes, squeeze, unpack, unsqueeze

EDGE = {1: 128, 2: 16, 3: 6, 4: 4}
MOST = 2**40
STEP, PLANE, ZERO = range(3)  # predictors of a block
PLANE_PRICE = 32  # in steps


def tiles(shape: tuple[int, ...]):
    edge = EDGE[len(shape)]
    for start in itertools.product(*(range(0, d, edge) for d in shape)):
        yield tuple(slice(s, min(s + edge, d)) for s, d in zip(start, shape, strict=True))


def differences(a: np.ndarray) -> np.ndarray:
    for axis in range(a.ndim):
        a = np.diff(a, axis=axis, prepend=0)
    return a


def plane(a: np.ndarray) -> np.ndarray:
    """Least-squares plane of a block: slopes and constant, as floats."""
    at = np.indices(a.shape).reshape(a.ndim, -1).T
    design = np.c_[at, np.ones(len(at))]
    return np.linalg.lstsq(design, a.ravel().astype(float), rcond=None)[0].astype("<f4")


def plane_values(c: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    at = np.indices(shape).reshape(len(shape), -1).T
    return np.rint(at @ c[:-1].astype(float) + float(c[-1])).astype(np.int64).reshape(shape)


def encode(values: np.ndarray, eb: float) -> bytes:
    x = np.ascontiguousarray(values, "<f4")
    whole = np.rint(x.astype(float) / (2 * eb)) if eb > 0 else np.full(x.shape, float(MOST))
    back = (whole * (2 * eb)).astype("<f4").astype(float)
    if not (np.abs(whole) < MOST).all() or not (np.abs(back - x.astype(float)) <= eb).all():
        return pack(shape_bytes(values.shape), b"", squeeze(x.tobytes()))
    q, codes, kinds, planes = whole.astype(np.int64), [], [], []
    for tile in tiles(x.shape):
        block = q[tile]
        by_step = differences(block)
        c = plane(block)
        by_plane = block - plane_values(c, block.shape)
        choices = by_step, by_plane, block
        kinds.append(int(np.argmin([np.abs(x).sum() + price for x, price in zip(choices, (0, PLANE_PRICE, 0), strict=True)])))
        if kinds[-1] == PLANE:
            planes.append(c.tobytes())
        codes.append(choices[kinds[-1]].ravel())
    coded = huffman_encode(np.concatenate(codes) if codes else np.zeros(0, np.int64))
    return pack(shape_bytes(values.shape), struct.pack("<d", eb), squeeze(coded), squeeze(bytes(kinds)), squeeze(b"".join(planes)))


def decode(data: bytes) -> np.ndarray:
    shape, eb, body, *rest = unpack(data)
    shape = read_shape(shape)
    if not eb:
        return np.frombuffer(unsqueeze(body), "<f4").reshape(shape).copy()
    eb, codes = struct.unpack("<d", eb)[0], huffman_decode(unsqueeze(body))
    kinds, planes = unsqueeze(rest[0]), np.frombuffer(unsqueeze(rest[1]), "<f4").reshape(-1, len(shape) + 1)
    out, at, used = np.zeros(shape, np.int64), 0, 0
    for kind, tile in zip(kinds, tiles(shape), strict=True):
        block = out[tile]
        own = codes[at : at + block.size].reshape(block.shape)
        at += block.size
        if kind == PLANE:
            own = own + plane_values(planes[used], block.shape)
            used += 1
        elif kind == STEP:
            for axis in range(own.ndim):
                own = np.cumsum(own, axis=axis)
        out[tile] = own
    return (out * (2 * eb)).astype("<f4")
