"""Windowed structural similarity in one to four dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
K1, K2, WINDOW = 0.01, 0.03, 8


def score(mx: Column, my: Column, vx: Column, vy: Column, cov: Column, range_: Column) -> Column:
    """Luminance, contrast and structure of a window; a window without range counts as of range one."""
    r = F.when(range_ == 0, F.lit(1.0)).otherwise(range_)
    c1, c2 = (K1 * r) * (K1 * r), (K2 * r) * (K2 * r)
    sx, sy = F.sqrt(vx), F.sqrt(vy)
    return (2 * mx * my + c1) / (mx * mx + my * my + c1) * ((2 * sx * sy + c2) / (vx + vy + c2)) * ((cov + c2 / 2) / (sx * sy + c2 / 2))


def compact(mx: Column, my: Column, vx: Column, vy: Column, cov: Column, c1: Column, c2: Column) -> Column:
    return (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))


def windows(pairs: DataFrame, dims: Sequence[int], window: int = WINDOW, shift: int = WINDOW) -> DataFrame:
    """One row for each whole window: its starts w0, w1, ... (in shifts), moments, and ssim.

    pairs: x, y and coordinates c0, c1, ...  Without overlap it's a plain groupBy; with it a cell goes to each window that
    holds it, at most ceil(window / shift) for each axis.
    """
    keys = [f"w{i}" for i in range(len(dims))]
    for i, (key, size) in enumerate(zip(keys, dims, strict=True)):
        last = (size - window) // shift
        if size < window:
            return pairs.sparkSession.createDataFrame([], ", ".join([*(f"{k} int" for k in keys), "ssim double"]))
        if window == shift:
            pairs = pairs.withColumn(key, F.expr(f"cast(c{i} div {shift} as int)")).where(F.col(key) <= last)
        else:
            low = F.greatest(F.lit(0), F.ceil((F.col(f"c{i}") - (window - 1)) / shift).cast("int"))
            high = F.least(F.lit(last), F.expr(f"cast(c{i} div {shift} as int)"))
            pairs = pairs.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn(key, F.explode(F.sequence("low", "high"))).drop("low", "high")
    m = pairs.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cov"), (F.max("x") - F.min("x")).alias("r"))
    return m.withColumn("ssim", score(*(F.col(c) for c in ("mx", "my", "vx", "vy", "cov", "r"))))


def mean_ssim(pairs: DataFrame, dims: Sequence[int], window: int = WINDOW, shift: int = WINDOW) -> DataFrame:
    return windows(pairs, dims, window, shift).agg(F.count("*").alias("windows"), F.round(F.avg("ssim"), 6).alias("ssim"))
