"""Estimates for the fixed-length delta codec."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.bits import bit_width, quantize_half_away, quantize_truncate, sign_bytes
from fieldloom.operators.sampling import sample_blocks
from fieldloom.operators.ssim import mean_ssim
from fieldloom.operators.stats import psnr_of
from fieldloom.operators.surrogates.bounds import of_bounds, one_bound
from fieldloom.sources.fixtures import Field, coords

STRIDE, BLOCK = 5, 32


def sampled(field: Field, stride: int, block: int) -> DataFrame:
    """Every stride-th whole block, and the rest after the last whole block."""
    whole = field.n // block
    b = F.expr(f"idx div {block}")
    return field.cells.where((b >= whole) | (b % stride == 0)).select(b.alias("block_id"), F.expr(f"cast(idx % {block} as int)").alias("pos"), "v")


def block_sizes(rows: DataFrame) -> DataFrame:
    """(at, eb, block_id, cells, bytes): 4 for the first value, 1 for the width, then signs and magnitudes of the differences."""
    coded = rows.withColumn("code", quantize_truncate(F.col("v"), F.col("eb")))
    steps = coded.withColumn("step", F.abs(F.col("code") - F.lag("code").over(Window.partitionBy("at", "block_id").orderBy("pos"))))
    b = steps.groupBy("at", "eb", "block_id").agg(F.count("*").alias("cells"), F.coalesce(F.max("step"), F.lit(0)).alias("most"))
    n = F.col("cells") - 1
    width = bit_width(F.col("most"))
    rest = width % 8
    packed = F.floor(width / 8) * n + F.when(rest == 0, F.lit(0)).otherwise(F.floor((rest * n - 1) / 8) + 1)
    return b.select("at", "eb", "block_id", "cells", (5 + F.when(F.col("most") > 0, F.floor((n + 7) / 8) + packed).otherwise(F.lit(0))).cast("long").alias("bytes"))


def crs(field: Field, bounds: Sequence[float], stride: int = STRIDE, block: int = BLOCK) -> DataFrame:
    """(at, eb, value) of all bounds.  Values counted are the differences, one fewer than the cells of a block."""
    sizes = block_sizes(of_bounds(sampled(field, stride, block), bounds))
    return sizes.groupBy("at", "eb").agg((4 * F.sum(F.col("cells") - 1) / F.sum("bytes")).alias("value"))


def psnrs(field: Field, bounds: Sequence[float], stride: int = STRIDE, block: int = BLOCK) -> DataFrame:
    v = F.col("v").cast("double")
    back = quantize_half_away(F.col("v"), F.col("eb")) * (2 * F.col("eb"))
    rows = of_bounds(sampled(field, stride, block).where("pos > 0"), bounds)
    return rows.groupBy("at", "eb").agg(psnr_of(F.avg((v - back) * (v - back)), (F.max("v") - F.min("v")).cast("double")).alias("value"))


cr, psnr = one_bound(crs), one_bound(psnrs)


def ssim(field: Field, eb: float, stride: int = STRIDE, block: int = BLOCK) -> DataFrame:
    sample, dims = sample_blocks(field.with_coords(), field.dims, block, stride)
    back = F.when(F.expr(f"idx % {block}") == 0, F.lit(0.0)).otherwise((quantize_half_away(F.col("v"), eb) * (2 * eb)).cast("float").cast("double"))
    pairs = coords(sample.select("idx", F.col("v").cast("double").alias("x"), back.alias("y")), dims)
    return mean_ssim(pairs, dims).select(F.col("ssim").alias("value"))


def record_bytes(block: int, width: int) -> int:
    """Bytes of a whole block whose differences need so many bits."""
    n = block - 1
    rest = width % 8
    return 5 + (sign_bytes(n) + width // 8 * n + (0 if not rest else (rest * n - 1) // 8 + 1) if width else 0)

