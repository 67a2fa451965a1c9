"""Error-bounded codecs of blocks, in NumPy: each has encode(values, eb) -> bytes and decode(bytes) -> values."""

from __future__ import annotations

from types import ModuleType

import numpy as np

from fieldloom.operators.codecs import blockfloat, delta, lorenzo, multilevel, transform, truncate, wavelet
from fieldloom.operators.codecs.packing import pack, read_shape, shape_bytes, unpack

AS_IT_IS = b"\xff" * 8  # in place of the first part's length


class Codec:
    """A codec of finite values; a block with any other is stored as it is, so that no cell of it is lost."""

    def __init__(self, own: ModuleType):
        self.own = own

    def encode(self, values: np.ndarray, eb: float, **options) -> bytes:
        if values.size and not np.isfinite(values).all():
            return AS_IT_IS + pack(shape_bytes(values.shape), np.ascontiguousarray(values, "<f4").tobytes())
        return self.own.encode(values, eb, **options)

    def decode(self, data: bytes) -> np.ndarray:
        if data[: len(AS_IT_IS)] == AS_IT_IS:
            shape, body = unpack(data[len(AS_IT_IS) :])
            return np.frombuffer(body, "<f4").reshape(read_shape(shape)).copy()
        return self.own.decode(data)


CODECS = {name: Codec(own) for name, own in (("sz3", multilevel), ("zfp", transform), ("szx", blockfloat), ("sperr", wavelet), ("szp", delta), ("qoz", lorenzo), ("trunc", truncate))}


class Smaller:
    """Of several codecs the one with the smallest result for the block, whose number goes first."""

    def __init__(self, *names: str):
        self.names = names

    def encode(self, values: np.ndarray, eb: float) -> bytes:
        tried = [CODECS[n].encode(values, eb) for n in self.names]
        best = min(range(len(tried)), key=lambda i: (len(tried[i]), i))
        return bytes([best]) + tried[best]

    def decode(self, data: bytes) -> np.ndarray:
        return CODECS[self.names[data[0]]].decode(data[1:])


#: Names of the algorithms that block settings may ask for.
ALGORITHMS = {"LORENZO_REG": CODECS["qoz"], "INTERP": CODECS["sz3"], "INTERP_LORENZO": Smaller("sz3", "qoz")}


def codec(name: str) -> Codec | Smaller:
    """A codec by its name or its algorithm's."""
    known = {**CODECS, **ALGORITHMS}
    if name not in known:
        raise ValueError(f"no codec named {name}; there are {', '.join(known)}")
    return known[name]
