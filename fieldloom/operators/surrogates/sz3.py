"""Estimates for the interpolation codec: errors of its passes over original values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.bits import interpolation_levels
from fieldloom.operators.predict import RADIUS, after_lossless, code_histogram, entropy, interpolation_pass, quantize
from fieldloom.operators.sampling import sample_blocks
from fieldloom.operators.ssim import mean_ssim
from fieldloom.operators.stats import psnr_of
from fieldloom.sources.fixtures import Field, coords

STRIDE, BLOCK, ENOUGH = 5, 32, 5000


def level_codes(field: Field, eb: float, level: int, sample: int, noise: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(idx, code, err): codes and remaining errors of all passes of a level."""
    cells, out = field.with_coords(), None
    for axis in range(len(field.dims)):
        rows = interpolation_pass(cells, field.dims, level, axis, sample)
        out = rows if out is None else out.unionByName(rows)
    if noise is not None:
        count = noise.count()
        out = out.withColumn("n", F.expr(f"(idx * 7919 + {seed}) % {max(1, count)}")).join(noise, "n").withColumn("pred", F.col("pred") + F.col("noise"))
    q = out.withColumn("q", quantize(F.col("v"), F.col("pred"), eb, RADIUS))
    return q.select("idx", "q.code", (F.col("q.recon").cast("double") - F.col("v").cast("double")).alias("err"))


def points(dims: tuple[int, ...], level: int, sample: int) -> int:
    """How many points a level visits, from the extents alone."""
    s, total = 1 << (level - 1), 0
    for axis, size in enumerate(dims):
        n = (size - 1) // s + 1
        if n <= 1:
            continue
        if n < 5:
            line = len(range(1, n - 1, 2 * sample)) + (n % 2 == 0)
        else:
            line = len({*range(3, n - 3, 2 * sample), 1, n - 3 if n % 2 == 0 else n - 2, *((n - 1,) if n % 2 == 0 else ())})
        others = 1
        for other, d in enumerate(dims):
            if other != axis:
                others *= len(range(0, d, (s if other < axis else 2 * s) * sample))
        total += line * others
    return total


def walk_levels(dims: tuple[int, ...], sample: int, last: int, keep_all: bool) -> list[int]:
    """The levels, from the coarsest, whose errors are used: the walk ends when over 5000 are held."""
    held, used = 0, []
    for level in range(interpolation_levels(dims), last - 1, -1):
        held = held + points(dims, level, sample) if keep_all else points(dims, level, sample)
        used = [*used, level] if keep_all else [level]
        if held > ENOUGH:
            break
    return used


def errors(field: Field, eb: float, sample: int, last: int, keep_all: bool) -> DataFrame:
    out = None
    for level in walk_levels(field.dims, sample, last, keep_all):
        rows = level_codes(field, eb, level, sample).select("idx", "err")
        out = rows if out is None else out.unionByName(rows)
    return out


def codes(field: Field, eb: float, stride: int = STRIDE, noise: str = "none", seed: int = 0) -> DataFrame:
    """(idx, code) of the finest level; noise 'sampled' adds an error of a coarser level, picked by position."""
    drawn = None
    if noise == "sampled":
        from pyspark.sql import Window

        drawn = errors(field, eb, 1, 2, False).select((F.row_number().over(Window.orderBy("idx")) - 1).alias("n"), F.col("err").alias("noise"))
    return level_codes(field, eb, 1, stride, drawn, seed).select("idx", "code")


def cr(field: Field, eb: float, stride: int = STRIDE, noise: str = "none", seed: int = 0) -> DataFrame:
    return after_lossless(entropy(code_histogram(codes(field, eb, stride, noise, seed)))).select(F.col("cr").alias("value"))


def psnr(field: Field, eb: float, stride: int = STRIDE) -> DataFrame:
    e = errors(field, eb, stride, 1, True)
    return e.agg(psnr_of(F.avg(F.col("err") * F.col("err")), F.lit(field.range)).alias("value"))


def ssim(field: Field, eb: float, stride: int = STRIDE, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """A block sample with errors of the walk added, picked by position; at most 5000 and one level of them."""
    from pyspark.sql import Window

    e = errors(field, eb, stride, 1, True).select((F.row_number().over(Window.orderBy("idx")) - 1).alias("n"), "err")
    count = e.count()
    sample, dims = sample_blocks(field.with_coords(), field.dims, block, stride)
    rows = sample.withColumn("n", F.expr(f"(idx * 7919 + {seed}) % {max(1, count)}")).join(e, "n")
    pairs = coords(rows.select("idx", F.col("v").cast("double").alias("x"), (F.col("v").cast("double") + F.col("err")).alias("y")), dims)
    return mean_ssim(pairs, dims).select(F.col("ssim").alias("value"))
