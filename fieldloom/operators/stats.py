"""Statistics and quality metrics over cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.windows import shifted


def r6(c: Column) -> Column:
    return F.round(c, 6)


def value_range(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("v").cast("double").alias("min_v"), F.max("v").cast("double").alias("max_v"), (F.max("v") - F.min("v")).cast("double").alias("value_range"))


def get_range(cells: DataFrame, mode: str = "max") -> DataFrame:
    """'max' gives the largest value, 'range' the difference."""
    return cells.agg((F.max("v") if mode == "max" else F.max("v") - F.min("v")).cast("double").alias("get_range"))


def zipped(orig: DataFrame, dec: DataFrame) -> DataFrame:
    """(idx, x, y) of two fields by position."""
    return orig.select("idx", F.col("v").cast("double").alias("x")).join(dec.select("idx", F.col("v").cast("double").alias("y")), "idx")


def mse(x: str = "x", y: str = "y") -> Column:
    return F.avg((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)))


def psnr_of(mse_: Column, range_: Column) -> Column:
    """With the small constant that keeps equal fields finite."""
    return -20 * F.log10(F.sqrt(mse_) / range_ + F.lit(1e-16))


def psnr(pairs: DataFrame) -> DataFrame:
    return pairs.agg(r6(mse()).alias("mse"), r6(F.sqrt(mse())).alias("rmse"), r6(psnr_of(mse(), F.max("x") - F.min("x"))).alias("psnr"))


def calc_stats(pairs: DataFrame) -> DataFrame:
    """rmse, largest error, psnr (infinite for equal fields), min, max."""
    range_ = F.max("x") - F.min("x")
    found = F.when(mse() == 0, F.lit(float("inf"))).otherwise(10 * F.log10(range_ * range_ / mse()))
    return pairs.agg(r6(F.sqrt(mse())).alias("rmse"), r6(F.max(F.abs(F.col("x") - F.col("y")))).alias("linf"), r6(found).alias("psnr"), F.min("x").alias("min_v"), F.max("x").alias("max_v"))


def verify(pairs: DataFrame) -> DataFrame:
    err, x, y = F.col("x") - F.col("y"), F.col("x"), F.col("y")
    range_ = F.max("x") - F.min("x")
    return pairs.agg(
        r6(F.max(F.abs(err))).alias("max_abs_err"),
        r6(F.max(F.abs(err)) / range_).alias("max_rel_err"),
        r6(F.max(F.when(x != 0, F.abs(err / x)))).alias("max_pw_rel_err"),
        r6(20 * F.log10(range_) - 10 * F.log10(mse())).alias("psnr"),
        r6(F.sqrt(mse()) / range_).alias("nrmse"),
        F.round(F.sqrt(F.sum(err * err)), 4).alias("norm_err"),
        r6(F.sqrt(F.sum(err * err)) / F.sqrt(F.sum(x * x))).alias("normed_norm_err"),
        r6(F.corr("x", "y")).alias("pearson"),
    )


def normed_variance(cells: DataFrame) -> DataFrame:
    """Population variance after scaling to [0, 1]; one pass, as the range only scales the variance."""
    v = F.col("v").cast("double")
    range_ = F.max(v) - F.min(v)
    return cells.agg(r6(F.when(range_ == 0, F.lit(0.0)).otherwise(F.var_pop(v) / (range_ * range_))).alias("normed_variance"))


def lag1(cells: DataFrame, value: str, constant: float) -> DataFrame:
    """Autocorrelation at distance one; constant: what a field without variance gets."""
    near = shifted(cells.select("idx", F.col(value).cast("double").alias("a")), {"b": ("a", 1)})
    moments = near.agg(F.count("*").alias("n"), F.avg("a").alias("m"), F.var_pop("a").alias("var"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.when(F.col("b").isNotNull(), F.col("a"))).alias("sa"), F.sum("b").alias("sb"))
    n = F.col("n") - 1
    cov = (F.col("ab") - F.col("m") * (F.col("sa") + F.col("sb")) + n * F.col("m") * F.col("m")) / n
    return moments.select(r6(F.when(F.col("var") == 0, F.lit(constant)).otherwise(cov / F.col("var"))).alias("autocorrelation"))


def lag1_blocks(pairs: DataFrame, block: int) -> DataFrame:
    """Autocorrelation of the error within blocks along the order."""
    from pyspark.sql import Window

    rows = pairs.select(F.expr(f"idx div {block}").alias("block_id"), "idx", (F.col("x") - F.col("y")).alias("a"))
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("block_id").orderBy("idx")))
    m = rows.groupBy("block_id").agg(F.count("*").alias("n"), F.avg("a").alias("m"), F.var_pop("a").alias("var"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.when(F.col("b").isNotNull(), F.col("a"))).alias("sa"), F.sum("b").alias("sb"))
    n = F.col("n") - 1
    cov = (F.col("ab") - F.col("m") * (F.col("sa") + F.col("sb")) + n * F.col("m") * F.col("m")) / n
    return m.select("block_id", F.round(F.when(F.col("var") == 0, F.lit(1.0)).otherwise(cov / F.col("var")), 4).alias("autocorrelation"))


def block_ids(block: int, rank: int) -> list[Column]:
    return [F.expr(f"c{i} div {block}").cast("int").alias(f"b{i}") for i in range(rank)]


def block_profile(cells: DataFrame, block: int, rank: int) -> DataFrame:
    """Mean, population variance and range of blocks; cells with coordinates."""
    v = F.col("v").cast("double")
    return cells.groupBy(*block_ids(block, rank)).agg(F.count("*").alias("cells"), r6(F.avg(v)).alias("mean"), F.round(F.var_pop(v), 4).alias("variance"), r6(F.max(v) - F.min(v)).alias("value_range"))


def block_covariance(cells: DataFrame, block: int, rank: int, dec: str = "w") -> DataFrame:
    return cells.groupBy(*block_ids(block, rank)).agg(F.round(F.covar_pop(F.col("v").cast("double"), F.col(dec).cast("double")), 4).alias("covariance"))


def mean_rms_strides(cells: DataFrame, n: int, strides: int = 2048) -> DataFrame:
    """Mean of the means of equal strides, and root mean square; strides halve until they divide n."""
    while strides > 1 and n % strides:
        strides //= 2
    v = F.col("v").cast("double")
    each = cells.groupBy(F.expr(f"idx div {max(1, n // strides)}").alias("stride")).agg(F.avg(v).alias("m"), F.avg(v * v).alias("q"), F.count("*").alias("k"))
    return each.agg(F.count("*").alias("strides"), r6(F.avg("m")).alias("mean"), r6(F.sqrt(F.avg("q"))).alias("rms"))


def constant_blocks(cells: DataFrame, block: int) -> DataFrame:
    return cells.groupBy(F.expr(f"idx div {block}").alias("block_id")).agg((F.min("v") == F.max("v")).alias("is_constant"), F.min("v").cast("double").alias("value"))


def stride_variance(cells: DataFrame) -> DataFrame:
    v = F.col("v").cast("double")
    return cells.agg(F.round(F.var_pop(v), 4).alias("variance"), F.round(F.sum(v), 4).alias("total"))


def rmse_at_step(cells: DataFrame, q: float) -> DataFrame:
    """Error of rounding to multiples of q."""
    v = F.col("v").cast("double")
    rest = v - q * F.floor(v / q + 0.5)
    return cells.agg(r6(F.sqrt(F.avg(rest * rest))).alias("rmse"))


def compression_ratio(num: int, width: int, payload: Column) -> Column:
    return F.lit(float(num * width)) / payload


def error_bound(mode: str, range_: float, n: int, *, abs_: float = 0.0, rel: float = 0.0, psnr_: float = 0.0, norm: float = 0.0) -> float:
    """The absolute bound that a mode asks for."""
    by_rel = rel * range_
    by_mode = {
        "abs": abs_,
        "rel": by_rel,
        "psnr": range_ * 10 ** ((psnr_ + 10 * _log10(1 - 2 / 3 * 0.99)) / -20),
        "norm": (3.0 / n) ** 0.5 * norm,
        "abs_and_rel": min(abs_, by_rel),
        "abs_or_rel": max(abs_, by_rel),
    }
    return by_mode[mode]


def _log10(x: float) -> float:
    from math import log10

    return log10(x)


MODES: Sequence[str] = ("abs", "rel", "psnr", "norm", "abs_and_rel", "abs_or_rel")
