"""Estimates for the block-truncation codec."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.bits import exponent, float_bits, leading_bytes, lose_mantissa_bits, required_length, shift_right
from fieldloom.operators.sampling import sample_blocks, sample_szx
from fieldloom.operators.ssim import mean_ssim
from fieldloom.operators.stats import psnr_of
from fieldloom.operators.surrogates.bounds import of_bounds, one_bound
from fieldloom.sources.fixtures import Field, coords

STRIDE, BLOCK = 15, 128


def blocks(sampled: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Radius, middle, required bits and shift of each block under each bound (at, eb)."""
    b = sampled.groupBy("block_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    b = of_bounds(b.withColumn("radius", ((F.col("high") - F.col("low")).cast("double") / 2).cast("float")), bounds)
    b = b.withColumn("median", (F.col("low") + F.col("radius")).cast("float")).withColumn("constant", F.col("radius").cast("double") <= F.col("eb"))
    b = b.withColumn("length", required_length(exponent(float_bits(F.col("radius"))), F.col("eb_exponent")))
    b = b.withColumn("median", F.when((F.col("length") > 32) & ~F.col("constant"), F.lit(0.0).cast("float")).otherwise(F.col("median")))
    b = b.withColumn("length", F.least(F.col("length"), F.lit(32)))
    return b.select("at", "eb", "block_id", "radius", "median", "constant", "length", F.ceil(F.col("length") / 8).cast("int").alias("bytes"), ((8 - F.col("length") % 8) % 8).cast("int").alias("shift"))


def components_of(field: Field, bounds: Sequence[float], stride: int = STRIDE) -> DataFrame:
    """A row of integers for each bound (at, eb): blocks, constant ones, required bytes, and leading bytes that need not be stored."""
    sampled, _ = sample_szx(field.cells, field.n, stride, BLOCK)
    b = blocks(sampled, bounds)
    values = sampled.join(b.where(~F.col("constant")), "block_id")
    moved = values.withColumn("bits", shift_right(float_bits((F.col("v") - F.col("median")).cast("float")), F.col("shift")))
    before = F.lag("bits", 1, 0).over(Window.partitionBy("at", "block_id").orderBy("pos"))
    lead = moved.select("at", F.least(leading_bytes(F.col("bits").bitwiseXOR(before)), F.col("bytes")).alias("lead")).groupBy("at").agg(F.sum("lead").alias("lead_bytes"))
    whole = b.groupBy("at", "eb").agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.col("constant").cast("long")), F.lit(0)).alias("constant_blocks"), F.coalesce(F.sum(F.when(~F.col("constant"), F.col("bytes").cast("long"))), F.lit(0)).alias("req_bytes"))
    return whole.join(lead, "at", "left").withColumn("lead_bytes", F.coalesce("lead_bytes", F.lit(0)))


def components(field: Field, eb: float, stride: int = STRIDE) -> DataFrame:
    return components_of(field, [eb], stride).drop("at", "eb")


def crs(field: Field, bounds: Sequence[float], stride: int = STRIDE) -> DataFrame:
    """(at, eb, value) of all bounds."""
    open_ = F.col("blocks") - F.col("constant_blocks")
    need = F.when(open_ > 0, F.col("req_bytes") / open_).otherwise(F.lit(4.0))
    lead = F.when(open_ > 0, F.col("lead_bytes") / open_).otherwise(F.lit(0.0))
    share = F.col("constant_blocks") / F.col("blocks")
    value = 4 * BLOCK / (13.0 * BLOCK / field.n + 33 / 8 + (1 + (0.25 + need) * BLOCK - lead) * (1 - share))
    return components_of(field, bounds, stride).select("at", "eb", value.alias("value"))


def psnrs(field: Field, bounds: Sequence[float], stride: int = STRIDE, divisor: str = "n") -> DataFrame:
    """Constant blocks err by their distance to the middle, others by the bound; the sum is shared by all n cells."""
    sampled, count = sample_szx(field.cells, field.n, stride, BLOCK)
    away = F.col("v").cast("double") - F.col("median").cast("double")
    err = F.when(F.col("constant"), away * away).otherwise(F.col("eb") * F.col("eb"))
    cells = field.n if divisor == "n" else count * BLOCK
    return sampled.join(blocks(sampled, bounds), "block_id").groupBy("at", "eb").agg(psnr_of(F.sum(err) / cells, F.lit(field.range)).alias("value"))


cr, psnr = one_bound(crs), one_bound(psnrs)


def ssim(field: Field, eb: float, stride: int = STRIDE, block: int = BLOCK) -> DataFrame:
    """Over a moved-together block sample, each block of cells as the codec would give it back."""
    sample, dims = sample_blocks(field.with_coords(), field.dims, block, stride)
    rows = sample.select("idx", F.expr(f"idx div {BLOCK}").alias("block_id"), "v")
    b = blocks(rows, [eb])
    back = F.when(F.col("constant"), F.col("median")).otherwise(lose_mantissa_bits(F.col("v"), F.col("shift")))
    pairs = coords(rows.join(b, "block_id").select("idx", F.col("v").cast("double").alias("x"), back.cast("double").alias("y")), dims)
    return mean_ssim(pairs, dims).select(F.col("ssim").alias("value"))
