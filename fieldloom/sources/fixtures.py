"""Fields derived from the driver's tables, as cells (idx long, v float) with row-major positions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.windows import prefix_sum


@dataclass(frozen=True)
class Field:
    """A dense array: cells (idx, v), its extents (slowest first), and lazily its range."""

    name: str
    cells: DataFrame
    dims: tuple[int, ...]
    dtype: str = "float"

    @property
    def n(self) -> int:
        return int(np.prod(self.dims))

    @cached_property
    def extremes(self) -> tuple[float, float]:
        low, high = self.cells.agg(F.min("v"), F.max("v")).first()
        return low, high

    @property
    def range(self) -> float:
        if self.dtype != "float":
            return float(self.extremes[1] - self.extremes[0])
        return float(np.float32(self.extremes[1]) - np.float32(self.extremes[0]))

    def bound(self, rel: float) -> float:
        """An absolute error bound relative to the range, as a float."""
        return float(np.float32(rel * self.range))

    def with_coords(self) -> DataFrame:
        return coords(self.cells, self.dims)

    def reshaped(self, dims: tuple[int, ...]) -> Field:
        """The same cells in other extents of the same product."""
        if int(np.prod(dims)) != self.n:
            raise ValueError(f"{dims} hold {int(np.prod(dims))} cells, not {self.n}")
        return replace(self, dims=tuple(dims))

    def keep(self) -> Field:
        return replace(self, cells=self.cells.persist())


def coords(cells: DataFrame, dims: tuple[int, ...]) -> DataFrame:
    """Adds c0, c1, ... (int) from idx."""
    stride, out = 1, {}
    for axis in reversed(range(len(dims))):
        out[f"c{axis}"] = F.expr(f"cast((idx div {stride}) % {dims[axis]} as int)")
        stride *= dims[axis]
    return cells.withColumns(dict(sorted(out.items())))


def idx_of(dims: tuple[int, ...], *axes):
    """idx from coordinates."""
    at = F.lit(0).cast("long")
    for size, axis in zip(dims, axes, strict=True):
        at = at * size + axis.cast("long")
    return at


def cube_dims(n: int) -> tuple[int, int, int]:
    return {1000: (10, 10, 10), 10000: (25, 20, 20)}.get(n, (n // 2000, 50, 40))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> Field:
    if name in ("events", "walk", "cube3d", "walk4"):
        events = _table(spark, sf_dir, "events")
        n = events.count()
        if name == "events":
            return Field(name, events.select(F.col("event_id").alias("idx"), F.col("value").cast("float").alias("v")), (n,))
        steps = events.select(F.col("event_id").alias("idx"), (F.round(F.col("value") * 100).cast("long") - 5000).alias("step"))
        cells = prefix_sum(steps, "step", "total").select("idx", (F.col("total").cast("double") / 100.0).cast("float").alias("v"))
        side = next(k - 1 for k in range(1, n + 2) if k**4 > n)
        dims = {"walk": (n,), "cube3d": cube_dims(n), "walk4": (side,) * 4}[name]  # cells beyond the product of dims are left out
        return Field(name, cells.where(F.col("idx") < int(np.prod(dims))), dims)
    if name == "orders":
        t = _table(spark, sf_dir, "orders")
        return Field(name, t.select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").cast("float").alias("v")), (t.count(),))
    if name == "part":
        t = _table(spark, sf_dir, "part")
        return Field(name, t.select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").cast("float").alias("v")), (t.count(),))
    if name == "emb2d":
        t = _table(spark, sf_dir, "embeddings")
        width = t.select(F.size("embedding")).first()[0]
        cells = t.select("vec_id", F.posexplode("embedding").alias("at", "v")).select((F.col("vec_id") * width + F.col("at")).cast("long").alias("idx"), F.col("v").cast("float").alias("v"))
        return Field(name, cells, (t.count(), width))
    if name == "const":
        return Field(name, spark.range(1024).select(F.col("id").alias("idx"), F.lit(1.0).cast("float").alias("v")), (1024,))
    if name == "ramp":
        return Field(name, spark.range(1024).select(F.col("id").alias("idx"), (F.col("id") * 0.5).cast("float").alias("v")), (1024,))
    raise ValueError(f"no fixture named {name}")


#: The fixtures in DuckDB; each is a view body with the columns idx, v and, above one dimension, c0, c1, ...
SQL = {
    "events": "SELECT event_id AS idx, CAST(value AS FLOAT) AS v FROM events",
    "walk": "SELECT event_id AS idx, CAST(CAST(SUM(CAST(round(value * 100) AS BIGINT) - 5000) OVER (ORDER BY event_id) AS DOUBLE) / 100.0::DOUBLE AS FLOAT) AS v FROM events",
    "orders": "SELECT o_orderkey AS idx, CAST(o_totalprice AS FLOAT) AS v FROM orders",
    "part": "SELECT p_partkey AS idx, CAST(p_retailprice AS FLOAT) AS v FROM part",
    "emb2d": "SELECT vec_id * 64 + c1 AS idx, CAST(v AS FLOAT) AS v, CAST(vec_id AS INTEGER) AS c0, CAST(c1 AS INTEGER) AS c1 FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS c1 FROM embeddings)",
}
SQL["shape3"] = "SELECT CASE count(*) WHEN 1000 THEN 10 WHEN 10000 THEN 20 ELSE 50 END AS d1, CASE count(*) WHEN 1000 THEN 10 WHEN 10000 THEN 20 ELSE 40 END AS d2, CASE count(*) WHEN 1000 THEN 10 WHEN 10000 THEN 25 ELSE count(*) // 2000 END AS d0 FROM events"
SQL["cube3d"] = "SELECT idx, v, CAST(idx // (d1 * d2) AS INTEGER) AS c0, CAST((idx // d2) % d1 AS INTEGER) AS c1, CAST(idx % d2 AS INTEGER) AS c2 FROM walk, shape3 WHERE idx < d0 * d1 * d2"
SQL["side4"] = "SELECT max(k) AS k FROM range(1, 3000) t(k), (SELECT count(*) AS n FROM events) WHERE k * k * k * k <= n"
SQL["walk4"] = "SELECT idx, v, CAST(idx // (k * k * k) AS INTEGER) AS c0, CAST((idx // (k * k)) % k AS INTEGER) AS c1, CAST((idx // k) % k AS INTEGER) AS c2, CAST(idx % k AS INTEGER) AS c3 FROM walk, side4 WHERE idx < k * k * k * k"


def with_sql(*names: str) -> str:
    """A WITH clause that defines the fixtures and what they need."""
    needed: list[str] = []
    for name in names:
        for x in {"cube3d": ("walk", "shape3", "cube3d"), "walk4": ("walk", "side4", "walk4")}.get(name, (name,)):
            if x not in needed:
                needed.append(x)
    # a fixture named like a table reads the table, so it gets a name of its own
    return "WITH " + ", ".join(f"{'f_' + x if x in ('events', 'orders', 'part') else x} AS ({SQL[x]})" for x in needed)
