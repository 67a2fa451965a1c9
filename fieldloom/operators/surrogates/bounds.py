"""Many bounds in one plan: the field is read once, and the bound is a column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.bits import exponent_of_bound
from fieldloom.sources.fixtures import Field


def of_bounds(rows: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """rows for each bound, with columns at (its number), eb and eb_exponent."""
    listed = F.array(*[F.struct(F.lit(n).alias("at"), F.lit(float(eb)).alias("eb"), F.lit(exponent_of_bound(float(eb))).alias("eb_exponent")) for n, eb in enumerate(bounds)])
    return rows.withColumn("bound", F.explode(listed)).select(*rows.columns, "bound.*")


def one_bound(of_many: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The estimator (value) of a single bound."""

    def estimate(field: Field, eb: float, *args, **options) -> DataFrame:
        return of_many(field, [eb], *args, **options).select("value")

    return estimate
