"""Containers, lossless stage and Huffman coding that the codecs share."""

from __future__ import annotations

import struct
import zlib

import numpy as np

try:
    import zstandard
except ImportError:  # the lossless stage then is zlib's
    zstandard = None


def squeeze(data: bytes, level: int = 3) -> bytes:
    return b"Z" + zstandard.ZstdCompressor(level).compress(data) if zstandard else b"z" + zlib.compress(data, 6)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"Z" else zlib.decompress(data[1:])


def pack(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<Q", len(p)) + p for p in parts)


def unpack(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from("<Q", data, at)[0]
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def shape_bytes(shape: tuple[int, ...]) -> bytes:
    return np.array(shape, "<i8").tobytes()


def read_shape(data: bytes) -> tuple[int, ...]:
    return tuple(np.frombuffer(data, "<i8").tolist())


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the symbols in order of length, then number."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def huffman_encode(values: np.ndarray) -> bytes:
    """Integers to a canonical Huffman code with its table."""
    from fieldloom.operators.predict import huffman_lengths

    symbols, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    if not len(symbols):
        return pack(b"", b"", struct.pack("<Q", 0), b"")
    by_symbol = huffman_lengths(dict(enumerate(counts.tolist())))
    lengths = np.array([by_symbol[i] for i in range(len(symbols))], np.int64)
    codes = canonical(lengths)
    n = lengths[inverse]
    ends = np.cumsum(n)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(lengths.max())):
        has = n > k
        bits[ends[has] - 1 - k] = (codes[inverse[has]] >> np.uint64(k)) & np.uint64(1)
    return pack(symbols.astype("<i8").tobytes(), lengths.astype("<u1").tobytes(), struct.pack("<Q", len(values)), np.packbits(bits).tobytes())


def huffman_decode(data: bytes) -> np.ndarray:
    symbols, lengths, count, packed = unpack(data)
    symbol, length = np.frombuffer(symbols, "<i8"), np.frombuffer(lengths, "<u1").astype(np.int64)
    n = struct.unpack("<Q", count)[0]
    table = {(int(k), int(c)): int(s) for k, c, s in zip(length, canonical(length), symbol, strict=True)}
    out, code, k = np.empty(n, np.int64), 0, 0
    at = 0
    for bit in np.unpackbits(np.frombuffer(packed, np.uint8)).tolist():
        if at == n:
            break
        code, k = code << 1 | bit, k + 1
        if (k, code) in table:
            out[at] = table[k, code]
            at, code, k = at + 1, 0, 0
    return out


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[start], np.diff(np.r_[start, len(values)])


class Bits:
    """A growing list of bits, and a reader of one."""

    def __init__(self, data: bytes | None = None):
        self.bits = [] if data is None else np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    @classmethod
    def of(cls, bits: list[int]) -> Bits:
        out = cls()
        out.bits = bits
        return out

    def put(self, bit: int) -> int:
        self.bits.append(bit)
        return bit

    def put_all(self, bits: np.ndarray) -> None:
        self.bits += bits.astype(np.uint8).tolist()

    def get_all(self, n: int) -> np.ndarray:
        self.at += n
        return np.array(self.bits[self.at - n : self.at], np.uint8)

    def get(self) -> int:
        self.at += 1
        return self.bits[self.at - 1]

    def tobytes(self) -> bytes:
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()
