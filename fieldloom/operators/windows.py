"""Neighbours and running sums along a dense order, without ever putting a whole field into one partition."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


SUM_CHUNK = 1 << 20


def prefix_sum(rows: DataFrame, value: str, out: str, order: str = "idx", chunk: int = SUM_CHUNK) -> DataFrame:
    """rows with the running sum of value in the order of a dense position.

    Sums of chunks are summed first (one row for a million cells, the only rows that meet in one task), then every chunk runs
    on from where the one before ended.
    """
    dealt = rows.withColumn("chunk", F.expr(f"{order} div {chunk}"))
    sums = dealt.groupBy("chunk").agg(F.sum(value).alias("chunk_sum"))
    before = sums.select("chunk", (F.sum("chunk_sum").over(Window.orderBy("chunk")) - F.col("chunk_sum")).alias("chunk_start"))
    inner = F.sum(value).over(Window.partitionBy("chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("inner_sum", inner).join(before, "chunk").withColumn(out, F.col("inner_sum") + F.col("chunk_start")).drop("chunk", "inner_sum", "chunk_start")


def shifted(cells: DataFrame, columns: Mapping[str, tuple[str, int]], chunk: int = CHUNK) -> DataFrame:
    """cells with columns {name: (column, offset)}: the column's value at idx + offset, null outside the field.

    idx must be dense.  A chunk takes along copies of the cells next to it, so that windows stay inside chunks.
    """
    lead = max([0, *(k for _, k in columns.values())])
    lag = max([0, *(-k for _, k in columns.values())])
    own = F.expr(f"idx div {chunk}")
    at = F.expr(f"idx % {chunk}")
    homes = F.array_compact(F.array(own, F.when(at < lead, own - 1), F.when(at >= chunk - lag, own + 1)))
    dealt = cells.withColumn("home", F.explode(homes))
    order = Window.partitionBy("home").orderBy("idx")
    moved = dealt.withColumns({n: F.lead(c, k).over(order) if k >= 0 else F.lag(c, -k).over(order) for n, (c, k) in columns.items()})
    return moved.where(F.col("home") == own).drop("home")


def along(axis: int, rank: int, *extra: str):
    """A window over the lines along an axis of coordinates c0, c1, ..."""
    return Window.partitionBy(*extra, *[f"c{i}" for i in range(rank) if i != axis]).orderBy(f"c{axis}")
