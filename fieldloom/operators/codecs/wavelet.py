"""Wavelet coding: CDF 9/7, set partitioning of bit planes, and a list of corrections for what exceeds the bound."""

from __future__ import annotations

import math
import struct
from functools import cached_property, lru_cache

import numpy as np

from fieldloom.functions.bits import wavelet_levels
from fieldloom.operators.codecs.packing import Bits, pack, read_shape, shape_bytes, squeeze, unpack, unsqueeze

#: The lifting steps of the CDF 9/7 wavelet, and its scaling.
ALPHA, BETA, GAMMA, DELTA, EPSILON = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971, 1.149604398860241


def _neighbours(even: np.ndarray, n_odd: int) -> np.ndarray:
    """Sum of the even samples around each odd one, mirrored at the end."""
    right = even[1 : n_odd + 1]
    if len(right) < n_odd:
        right = np.concatenate([right, even[-1:]])
    return even[:n_odd] + right


def _odd_neighbours(odd: np.ndarray, n_even: int) -> np.ndarray:
    left = np.concatenate([odd[:1], odd])[:n_even]
    right = odd[:n_even]
    if len(right) < n_even:
        right = np.concatenate([right, odd[-1:]])
    return left + right


def forward(a: np.ndarray) -> np.ndarray:
    """One level along the first axis: low band, then high band."""
    even, odd = a[0::2].copy(), a[1::2].copy()
    odd += ALPHA * _neighbours(even, len(odd))
    even += BETA * _odd_neighbours(odd, len(even))
    odd += GAMMA * _neighbours(even, len(odd))
    even += DELTA * _odd_neighbours(odd, len(even))
    return np.concatenate([even * EPSILON, odd / -EPSILON])


def inverse(a: np.ndarray) -> np.ndarray:
    n = len(a)
    even, odd = a[: n - n // 2] / EPSILON, a[n - n // 2 :] * -EPSILON
    even = even - DELTA * _odd_neighbours(odd, len(even))
    odd = odd - GAMMA * _neighbours(even, len(odd))
    even = even - BETA * _odd_neighbours(odd, len(even))
    odd = odd - ALPHA * _neighbours(even, len(odd))
    out = np.empty_like(a)
    out[0::2], out[1::2] = even, odd
    return out


def bands(shape: tuple[int, ...]):
    """(level's extents, axes to transform), finest first; an axis rests when its own levels are used up."""
    size = list(shape)
    levels = [wavelet_levels(d) for d in shape]
    for level in range(max(levels, default=0)):
        axes = [i for i in range(len(shape)) if level < levels[i]]
        yield tuple(size), axes
        for i in axes:
            size[i] -= size[i] // 2


def dwt(a: np.ndarray) -> np.ndarray:
    out = a.astype(float).copy()
    for size, axes in bands(a.shape):
        part = out[tuple(slice(0, s) for s in size)]
        for axis in axes:
            moved = np.moveaxis(part, axis, 0)
            moved[:] = forward(moved)
    return out


def idwt(a: np.ndarray) -> np.ndarray:
    out = a.astype(float).copy()
    for size, axes in reversed(list(bands(a.shape))):
        part = out[tuple(slice(0, s) for s in size)]
        for axis in reversed(axes):
            moved = np.moveaxis(part, axis, 0)
            moved[:] = inverse(moved)
    return out


def split(box: tuple[tuple[int, int], ...]):
    """The halves of a box along all of its axes, the low ones first."""
    parts = [()]
    for low, high in box:
        middle = low + (high - low + 1) // 2
        halves = [(low, middle)] + ([(middle, high)] if middle < high else [])
        parts = [(*p, h) for p in parts for h in halves]
    return parts


@lru_cache(maxsize=8)
def tree(shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The boxes that splitting leads to, each before its parts: (parent, cell or -1, number of boxes in it, boxes of each depth)."""
    parent, cell, depth, todo = [], [], [], [(-1, 0, tuple((0, d) for d in shape))] if math.prod(shape) else []
    stride = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
    while todo:
        above, level, box = todo.pop()
        parent.append(above)
        depth.append(level)
        if all(b - a == 1 for a, b in box):
            cell.append(sum(a * n for (a, _), n in zip(box, stride, strict=True)))
        else:
            cell.append(-1)
            todo += [(len(parent) - 1, level + 1, part) for part in split(box)[::-1]]
    above, level = np.array(parent, np.int32), np.array(depth, np.int16)
    levels = [np.flatnonzero(level == n) for n in range(int(level.max(initial=-1)) + 1)]
    size = np.ones(len(above), np.int32)
    for own in levels[:0:-1]:
        np.add.at(size, above[own], size[own])
    return above, np.array(cell, np.int32), size, levels


def bit_lengths(a: np.ndarray) -> np.ndarray:
    n = np.frexp(a.astype(float))[1]
    return n - ((a >> np.maximum(n - 1, 0) == 0) & (a > 0))  # where a float rounds up to the next power


def set_partition(magnitude: np.ndarray | None, shape: tuple[int, ...], planes: int, bits: Bits) -> np.ndarray:
    """Code (or, without magnitudes, decode) whole numbers plane by plane.

    A set is a box; it is insignificant until one of its numbers has the plane's bit.  Significant boxes split until
    they are cells; known cells are refined.  Gives the numbers.

    A plane visits its boxes in the tree's order, those whose parent is significant and that were not so before.
    """
    parent, cell, size, levels = tree(shape)
    if magnitude is not None:
        flat = magnitude.ravel()
        most = np.where(cell >= 0, flat[cell], 0)
        for own in levels[:0:-1]:
            np.maximum.at(most, parent[own], most[own])
        top = bit_lengths(most) - 1  # the plane from which on a box is significant
        above = np.where(parent >= 0, top[parent], planes)
        cells = np.flatnonzero((cell >= 0) & (top >= 0))
        cells = cells[np.argsort(-top[cells], kind="stable")]  # in the order in which they become known
        value, since = flat[cell[cells]], -top[cells]
        for plane in range(planes - 1, -1, -1):
            bits.put_all(top[(above >= plane) & (top <= plane)] == plane)
            bits.put_all(value[: np.searchsorted(since, -plane)] >> plane & 1)
        return magnitude
    out = np.zeros(math.prod(shape), np.int64)
    waiting, known, of_box, within = [0] if len(parent) else [], [], cell.tolist(), size.tolist()
    for plane in range(planes - 1, -1, -1):
        old, todo, waiting = len(known), waiting[::-1], []
        while todo:
            box = todo.pop()
            if not bits.get():
                waiting.append(box)
            elif of_box[box] >= 0:
                known.append(of_box[box])
            else:
                part, parts = box + 1, []
                while part < box + within[box]:
                    parts.append(part)
                    part += within[part]
                todo += parts[::-1]
        cells = np.array(known, np.int64)
        out[cells[old:]] = 1 << plane
        out[cells[:old]] |= bits.get_all(old).astype(np.int64) << plane
    return out.reshape(shape)


def conditioned(a: np.ndarray) -> tuple[float, np.ndarray]:
    mean = float(a.mean()) if a.size else 0.0
    return mean, a - mean


def transform(x: np.ndarray) -> tuple[float, np.ndarray]:
    mean, centred = conditioned(x)
    return mean, dwt(centred)


def encode(values: np.ndarray, eb: float) -> bytes:
    """Every value within eb: cells that the coefficients leave further off are corrected."""
    x = np.ascontiguousarray(values, "<f4").astype(float)
    if x.size and (x == x.flat[0]).all():
        return pack(shape_bytes(values.shape), struct.pack("<f", x.flat[0]))
    return encode_step(x, 1.5 * eb, eb)


def in_steps(coefficients: np.ndarray, step: float) -> np.ndarray:
    return np.floor(np.abs(coefficients) / step).astype(np.int64)


def encode_step(x: np.ndarray, step: float, eb: float = 0.0, transformed: tuple[float, np.ndarray] | None = None) -> bytes:
    """Coefficients in steps; corrections up to the bound eb if there is one.  transformed: the mean and coefficients, if known."""
    mean, coefficients = transformed or transform(x)
    whole = in_steps(coefficients, step)
    planes = int(whole.max()).bit_length() if whole.size else 0
    bits = Bits()
    set_partition(whole, x.shape, planes, bits)
    bits.put_all((coefficients < 0)[whole > 0])
    head = struct.pack("<ddid", mean, step, planes, eb)
    if not eb:
        return pack(shape_bytes(x.shape), head, squeeze(bits.tobytes(), 9), b"", b"")
    back = rebuild(whole, coefficients < 0, step, mean).astype("<f4").ravel()
    flat = x.ravel()
    off = flat - back
    size = np.where(np.abs(off) > eb, np.rint(np.minimum(np.abs(off) / eb, 2.0**40)), 0).astype(np.int64)
    outliers, top = Bits(), int(size.max()).bit_length() if size.size else 0
    set_partition(size, size.shape, top, outliers)
    outliers.put_all((off < 0)[size > 0])
    fixed = corrected(back, size, off < 0, eb)
    wrong = np.flatnonzero(~(np.abs(fixed.astype(float) - flat) <= eb))  # finer than a float's digits
    rest = np.diff(wrong, prepend=0).astype("<u4").tobytes() + flat[wrong].astype("<f4").tobytes()
    return pack(shape_bytes(x.shape), head, squeeze(bits.tobytes(), 9), struct.pack("<i", top) + squeeze(outliers.tobytes(), 9) if top else b"", squeeze(rest, 9) if rest else b"")


def corrected(back: np.ndarray, size: np.ndarray, negative: np.ndarray, eb: float) -> np.ndarray:
    return (back.astype(float) + np.where(negative, -size, size) * eb).astype("<f4")


def rebuild(whole: np.ndarray, negative: np.ndarray, step: float, mean: float) -> np.ndarray:
    size = np.where(whole > 0, (whole + 0.5) * step, 0.0)
    return idwt(np.where(negative, -size, size)) + mean


def signed_set(bits: Bits, shape: tuple[int, ...], planes: int) -> tuple[np.ndarray, np.ndarray]:
    """(magnitudes, whether negative) as set_partition and the signs after it have them."""
    whole = set_partition(None, shape, planes, bits)
    negative = np.zeros(shape, bool)
    negative[whole > 0] = bits.get_all(int((whole > 0).sum()))
    return whole, negative


def decode(data: bytes) -> np.ndarray:
    shape, head, *rest = unpack(data)
    shape = read_shape(shape)
    if not rest:
        return np.full(shape, struct.unpack("<f", head)[0], "<f4")
    mean, step, planes, eb = struct.unpack("<ddid", head)
    whole, negative = signed_set(Bits(unsqueeze(rest[0])), shape, planes)
    out = rebuild(whole, negative, step, mean).astype("<f4").ravel()
    if rest[1]:
        size, negative = signed_set(Bits(unsqueeze(rest[1][4:])), out.shape, struct.unpack_from("<i", rest[1])[0])
        out = corrected(out, size, negative, eb)
    if rest[2]:
        fix = unsqueeze(rest[2])
        n = len(fix) // 8
        out[np.cumsum(np.frombuffer(fix, "<u4", n))] = np.frombuffer(fix, "<f4", n, 4 * n)
    return out.reshape(shape)


class Steps:
    """What steps of one block lead to, each worked out once however many targets ask for it."""

    def __init__(self, values: np.ndarray):
        self.x = np.ascontiguousarray(values, "<f4").astype(float)
        self.spread = float(self.x.max() - self.x.min()) if self.x.size else 0.0
        self.sizes: dict[float, int] = {}
        self.errors: dict[float, float] = {}

    @cached_property
    def transformed(self) -> tuple[float, np.ndarray]:
        return transform(self.x)

    def encode(self, step: float) -> bytes:
        return encode_step(self.x, step, transformed=self.transformed)

    def size(self, step: float) -> int:
        if step not in self.sizes:
            self.sizes[step] = len(self.encode(step))
        return self.sizes[step]

    def error(self, step: float) -> float:
        """The mean square of what decode() of encode() would be off."""
        if step not in self.errors:
            mean, coefficients = self.transformed
            back = rebuild(in_steps(coefficients, step), coefficients < 0, step, mean).astype("<f4")
            self.errors[step] = float(((back.astype(float) - self.x) ** 2).mean())
        return self.errors[step]


def encode_target(values: np.ndarray, bits_per_value: float | None = None, psnr: float | None = None, steps: Steps | None = None) -> bytes:
    """At most so many bits a value, or at least such a ratio of signal to noise (in dB of the values' range); one of the two.

    The step is found by bisection of its logarithm; decode() reads the result like any other.  steps: of the values, for several targets.
    """
    if (bits_per_value is None) == (psnr is None):
        raise ValueError("one target is needed: bits_per_value or psnr")
    steps = steps or Steps(values)
    spread = steps.spread
    if not spread:
        return encode(values, 1.0)

    def holds(step: float) -> bool:
        if psnr is None:
            return 8 * steps.size(step) <= bits_per_value * steps.x.size
        error = steps.error(step)
        return error == 0 or 10 * np.log10(spread * spread / error) >= psnr

    low, high, best = np.log2(spread) - 30, np.log2(spread) + 2, None
    while high - low > 0.05:
        middle = (low + high) / 2
        met = holds(2.0**middle)
        if met:
            best = middle
        if met == (psnr is None):
            high = middle  # fewer bits than allowed: finer steps
        else:
            low = middle
    return steps.encode(2.0 ** (best if best is not None else high if psnr is None else low))
