"""Shapes, methods and packed configurations."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a goal holds fast and what it improves, and the codes of types.
METRICS = ("eb", "psnr", "ssim", "cr")
DTYPES = ("float", "double", "uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64")
WIDTHS = {"float": 4, "double": 8, "uint8": 1, "int8": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4, "uint64": 8, "int64": 8}
SPARK_TYPES = {"float": "float", "double": "double", "uint8": "short", "int8": "byte", "uint16": "int", "int16": "short", "uint32": "long", "int32": "int", "uint64": "decimal(20,0)", "int64": "long"}
GOALS = {1: "eb_psnr", 2: "eb_ssim", 3: "eb_cr", 6: "psnr_ssim", 7: "psnr_cr", 11: "ssim_cr", 12: "cr_eb", 13: "cr_psnr", 14: "cr_ssim"}
REGISTERED = (1, 2, 3, 7, 11, 12, 13, 14)

#: The numbers of error modes in packed words.  VR_REL is another name of REL.
MODE_NUMBERS = {
    "ABS": 0,
    "REL": 1,
    "VR_REL": 1,
    "ABS_AND_REL": 2,
    "ABS_OR_REL": 3,
    "PSNR": 4,
    "NORM": 5,
    "FIX_RATE": 6,
    "PW_REL": 10,
    "ABS_AND_PW_REL": 11,
    "ABS_OR_PW_REL": 12,
    "REL_AND_PW_REL": 13,
    "REL_OR_PW_REL": 14,
}


def mode_name(number: int) -> str:
    """The mode of a number; the first of its names."""
    for name, own in MODE_NUMBERS.items():
        if own == number:
            return name
    raise ValueError(f"{number} is no error mode")



def method_name(method: Column) -> Column:
    names = F.array(*[F.lit(m) for m in METRICS])
    return F.concat_ws("_", F.element_at(names, (F.floor(method / 4) + 1).cast("int")), F.element_at(names, (method % 4 + 1).cast("int")))


def method_of(goal: str) -> int:
    a, b = goal.split("_")
    return METRICS.index(a) * 4 + METRICS.index(b)


def normalise_dims(dims: Column) -> Column:
    """Extents over one; [1] if none is."""
    kept = F.filter(dims, lambda d: d > 1)
    return F.when(F.size(kept) == 0, F.array(F.lit(1).cast("long"))).otherwise(kept)


def reverse_dims(dims: Column) -> Column:
    """Extents from the fastest on instead of the slowest, or back; the cells stay where they are."""
    return F.reverse(dims)


def product(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(1).cast("long"), lambda a, d: a * d)


def dims_status(dims: Column) -> Column:
    """0: nothing dropped, 1: some extents dropped, 2: all dropped."""
    ones = F.size(F.filter(dims, lambda d: d <= 1))
    return F.when(ones == 0, F.lit(0)).when(ones < F.size(dims), F.lit(1)).otherwise(F.lit(2))


def computed_rank(r5: int, r4: int, r3: int, r2: int, r1: int) -> int:
    """The rank of extents of which 0 means absent, from the fastest on."""
    rank = 0
    for extent in (r1, r2, r3, r4, r5):
        if not extent:
            break
        rank += 1
    return rank


def computed_length(*extents: int) -> int:
    out, found = 1, False
    for e in extents:
        if e:
            out, found = out * e, True
    return out if found else 0


def pack_config(eb: float, method: int, dtype: str = "float", dims: Sequence[int] = ()) -> bytes:
    """Bound, method, type, rank, bit width and extents, extents packed from the lowest bit on."""
    width = max((d.bit_length() for d in dims), default=1 if not dims else 0)
    head = struct.pack("<dbBbB", eb, method, DTYPES.index(dtype), len(dims) or 1, width if dims else 0)
    bits = sum(d << i * width for i, d in enumerate(dims))
    return head + bits.to_bytes(-(-len(dims) * width // 8), "little")


def unpack_config(data: bytes) -> dict:
    eb, method, dtype, rank, width = struct.unpack_from("<dbBbB", data)
    bits = int.from_bytes(data[12:], "little")
    dims = [bits >> i * width & (1 << width) - 1 for i in range(rank)] if width else []
    return {"eb": eb, "method": method, "dtype": DTYPES[dtype], "dims": dims, "bit_width": width}


def cd_values(eb: float, method: int) -> tuple[int, int, int]:
    """The three words that a user passes: the bound's halves, low first, and the method with its defaults."""
    if method not in REGISTERED:
        raise ValueError(f"method {method} is no goal")
    return struct.unpack("<III", pack_config(eb, method)[:12])


def double_words(x: float) -> tuple[int, int]:
    """High and low half of a double."""
    return struct.unpack(">II", struct.pack(">d", x))


def legacy_error_words(mode: str, abs_: float = 0.0, rel: float = 0.0, pw_rel: float = 0.0, psnr: float = 0.0, ratio: float = 0.0) -> list[int]:
    """A mode and five doubles as big-endian halves: eleven words."""
    return [MODE_NUMBERS[mode], *(w for x in (abs_, rel, pw_rel, psnr, ratio) for w in double_words(x))]


def read_legacy_error_words(words: Sequence[int]) -> dict:
    values = [struct.unpack(">d", struct.pack(">II", words[i], words[i + 1]))[0] for i in range(1, 11, 2)]
    return {"mode": mode_name(words[0]), **dict(zip(("abs", "rel", "pw_rel", "psnr", "ratio"), values, strict=True))}


def legacy_cd_values(dims: Sequence[int], dtype: str) -> list[int]:
    """Rank, type and extents (slowest first); the length of one dimension takes two words."""
    body = [dims[0] >> 32, dims[0] & 0xFFFFFFFF] if len(dims) == 1 else list(dims)
    return [len(dims), DTYPES.index(dtype), *body]


def read_legacy_cd_values(words: Sequence[int]) -> tuple[list[int], str]:
    body = [words[2] << 32 | words[3]] if words[0] == 1 else list(words[2 : 2 + words[0]])
    return body, DTYPES[words[1]]


def h5repack_words(mode: str, bound: float) -> list[int]:
    """The nine words of one error mode: mode, and the bound in the mode's place."""
    places = {"ABS": 0, "REL": 1, "VR_REL": 1, "PW_REL": 2, "PSNR": 3}
    if mode not in places:
        raise ValueError(f"mode {mode} has no place in the words")
    values = [0.0] * 4
    values[places[mode]] = bound
    return [MODE_NUMBERS[mode], *(w for x in values for w in double_words(x))]


def chunk_header(size: int, method: int, eb: float) -> bytes:
    return struct.pack("<Qid", size, method, eb)


def read_chunk_header(data: bytes) -> tuple[int, int, float]:
    return struct.unpack_from("<Qid", data)
