"""Estimates for the chunked variant of the delta codec."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.bits import bit_width, quantize_half_away
from fieldloom.operators.ssim import mean_ssim
from fieldloom.operators.stats import psnr_of
from fieldloom.operators.surrogates.bounds import of_bounds, one_bound
from fieldloom.sources.fixtures import Field, coords

STRIDE, CHUNK, BLOCK = 5, 8192, 32


def crs(field: Field, bounds: Sequence[float], stride: int = STRIDE, chunk: int = CHUNK) -> DataFrame:
    """(at, eb, value) of all bounds.  Every stride-th chunk; a 32-block of zero codes takes a byte, another (bits + 1) * 4."""
    chunks = field.n // chunk
    rows = field.cells.where((F.expr(f"idx div {chunk}") < chunks) & (F.expr(f"idx div {chunk} % {stride}") == 0))
    coded = of_bounds(rows, bounds).select("at", "eb", F.expr(f"idx div {BLOCK}").alias("block_id"), F.expr(f"idx % {BLOCK}").alias("pos"), quantize_half_away(F.col("v"), F.col("eb")).alias("code"))
    steps = coded.withColumn("step", F.abs(F.col("code") - F.lag("code", 1, 0).over(Window.partitionBy("at", "block_id").orderBy("pos"))))
    b = steps.groupBy("at", "eb", "block_id").agg(F.max("step").alias("most"), F.count("*").alias("cells"))
    size = F.when(F.col("most") == 0, F.lit(1)).otherwise((bit_width(F.col("most")) + 1) * 4)
    return b.groupBy("at", "eb").agg((4 * F.sum("cells") / F.sum(size)).alias("value"))


def kept(field: Field, stride: int, chunk: int) -> DataFrame:
    blocks = chunk // BLOCK
    return field.cells.where((F.expr(f"idx div {chunk}") < field.n // chunk) & (F.expr(f"idx div {BLOCK} % {blocks} % {stride}") == 0))


def psnrs(field: Field, bounds: Sequence[float], stride: int = STRIDE, chunk: int = CHUNK) -> DataFrame:
    v = F.col("v").cast("double")
    back = quantize_half_away(F.col("v"), F.col("eb")) * (2 * F.col("eb"))
    return of_bounds(kept(field, stride, chunk), bounds).groupBy("at", "eb").agg(psnr_of(F.avg((v - back) * (v - back)), (F.max("v") - F.min("v")).cast("double")).alias("value"))


cr, psnr = one_bound(crs), one_bound(psnrs)


def ssim(field: Field, eb: float, stride: int = STRIDE, chunk: int = CHUNK) -> DataFrame:
    """The kept blocks moved together along the order."""
    each = -(-(chunk // BLOCK) // stride)
    at = F.expr(f"(idx div {chunk} * {each} + idx div {BLOCK} % {chunk // BLOCK} div {stride}) * {BLOCK} + idx % {BLOCK}")
    back = (quantize_half_away(F.col("v"), eb) * (2 * eb)).cast("float").cast("double")
    dims = (field.n // chunk * each * BLOCK,)
    pairs = coords(kept(field, stride, chunk).select(at.alias("idx"), F.col("v").cast("double").alias("x"), back.alias("y")), dims)
    return mean_ssim(pairs, dims).select(F.col("ssim").alias("value"))
