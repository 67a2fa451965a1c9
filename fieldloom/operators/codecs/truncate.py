"""Keep the high bytes of floats."""

from __future__ import annotations

import numpy as np

from fieldloom.operators.codecs.packing import pack, read_shape, shape_bytes, squeeze, unpack, unsqueeze


def keep_bytes(values: np.ndarray, eb: float) -> int:
    bits = values.astype("<f4").view("<u4")
    for k in range(1, 4):
        back = (bits & np.uint32((0xFFFFFFFF << 8 * (4 - k)) & 0xFFFFFFFF)).view("<f4")
        if len(values) == 0 or np.abs(back.astype(float) - values.astype(float)).max() <= eb:
            return k
    return 4


def encode(values: np.ndarray, eb: float) -> bytes:
    flat = np.ascontiguousarray(values, "<f4").ravel()
    k = keep_bytes(flat, eb)
    planes = flat.view(np.uint8).reshape(-1, 4)[:, 4 - k :].T
    return pack(shape_bytes(values.shape), bytes([k]), squeeze(np.ascontiguousarray(planes).tobytes()))


def decode(data: bytes) -> np.ndarray:
    shape, k, body = unpack(data)
    shape = read_shape(shape)
    out = np.zeros((int(np.prod(shape)), 4), np.uint8)
    out[:, 4 - k[0] :] = np.frombuffer(unsqueeze(body), np.uint8).reshape(k[0], -1).T
    return out.view("<f4").reshape(shape)
