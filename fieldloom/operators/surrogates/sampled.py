"""Estimates that run the real transform coders on a sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.codecs import transform, wavelet
from fieldloom.operators.sampling import sample_sperr, sample_zfp
from fieldloom.operators.ssim import mean_ssim, windows
from fieldloom.operators.stats import psnr_of
from fieldloom.sources.fixtures import Field, coords

RATIO, RATE, BLOCK = 0.2, 0.1, 32
SLAB = 1 << 14  # sample cells coded together


def coded(rows: DataFrame, group: str, shape_of, module, eb: float) -> DataFrame:
    """Code and decode groups of (group, pos, v): (group, pos, x, y, bytes), bytes on a group's first row only."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        values = table.column("v").to_numpy().astype("<f4")
        data = module.encode(values.reshape(shape_of(len(values))), eb)
        back = module.decode(data).ravel()
        sizes = np.zeros(len(values), np.int64)
        sizes[:1] = len(data)
        return pa.table({group: table.column(group), "pos": table.column("pos"), "x": pa.array(values.astype(float)), "y": pa.array(back.astype(float)), "bytes": pa.array(sizes)})

    kept = rows.select(F.col(group).cast("long").alias(group), F.col("pos").cast("long").alias("pos"), "v")
    return kept.groupBy(group).applyInArrow(run, f"{group} long, pos long, x double, y double, bytes long")


def zfp_coded(field: Field, eb: float, ratio: float) -> tuple[DataFrame, tuple[int, ...]]:
    """Slabs of whole 4-layers of the sample, each coded by itself."""
    sample, dims = sample_zfp(field.with_coords(), field.dims, ratio)
    inner = int(np.prod(dims[1:]))
    layers = max(4, SLAB // max(1, inner) // 4 * 4)
    slab = layers * inner
    rows = sample.select(F.expr(f"idx div {slab}").alias("slab"), F.expr(f"idx % {slab}").alias("pos"), "v")
    return coded(rows, "slab", lambda n: (n // inner, *dims[1:]), transform, eb).withColumn("idx", F.col("slab") * slab + F.col("pos")), dims


def zfp_cr(field: Field, eb: float, ratio: float = RATIO) -> DataFrame:
    rows, _ = zfp_coded(field, eb, ratio)
    return rows.agg((4 * F.count("*") / F.sum("bytes")).alias("value"))


def zfp_psnr(field: Field, eb: float, ratio: float = RATIO) -> DataFrame:
    rows, _ = zfp_coded(field, eb, ratio)
    return rows.agg(psnr_of(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))), F.max("x") - F.min("x")).alias("value"))


def zfp_ssim(field: Field, eb: float, ratio: float = RATIO) -> DataFrame:
    rows, dims = zfp_coded(field, eb, ratio)
    return mean_ssim(coords(rows.select("idx", "x", "y"), dims), dims).select(F.col("ssim").alias("value"))


def sperr_coded(field: Field, eb: float, rate: float, block: int) -> DataFrame:
    rows = sample_sperr(field.with_coords(), field.dims, block, rate)
    rank = len(field.dims)
    return coded(rows, "block_id", lambda n: (block + 1,) * rank, wavelet, eb)


def sperr_cr(field: Field, eb: float, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """32 bits over the mean of the blocks' bits a value."""
    each = sperr_coded(field, eb, rate, block).groupBy("block_id").agg((8 * F.sum("bytes") / F.count("*")).alias("bits"))
    return each.agg((32 / F.avg("bits")).alias("value"))


def sperr_psnr(field: Field, eb: float, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    rows = sperr_coded(field, eb, rate, block)
    return rows.agg(psnr_of(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))), F.lit(field.range)).alias("value"))


def sperr_ssim(field: Field, eb: float, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """Windows of every block without its overlapping edge; windows that are no number are left out."""
    rank = len(field.dims)
    inner = coords(sperr_coded(field, eb, rate, block).withColumnRenamed("pos", "idx"), (block + 1,) * rank)
    keep = F.lit(True)
    for axis in range(rank):
        keep = keep & (F.col(f"c{axis}") < block)
    # blocks lie one after another along the first axis, which windows cannot straddle as block is whole windows
    step = block // 8 * 8
    moved = inner.where(keep & (F.col("c0") < step)).withColumn("c0", (F.col("block_id") * step + F.col("c0")).cast("long"))
    most = (rows_of(field, block) * step, *[block] * (rank - 1))
    return windows(moved, most).where(~F.isnan("ssim")).agg(F.avg("ssim").alias("value"))


def rows_of(field: Field, block: int) -> int:
    from fieldloom.operators.sampling import sperr_blocks

    return sperr_blocks(field.dims, block)

