"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_OF_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which may not have it, once for each application.

    Texts can be long, so where Arrow's batches still have their default of 10,000 rows they get a tenth of it.
    """
    if spark.conf.get(ROWS_OF_BATCH) == "10000":
        spark.conf.set(ROWS_OF_BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parents[2]
    packed = Path(tempfile.mkdtemp(prefix="fieldloom-")) / "fieldloom.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted((top / "fieldloom").rglob("*.py")):
            out.write(file, file.relative_to(top))
    spark.sparkContext.addPyFile(str(packed))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    There is no other choice: a folder of the driver's machine would be another one on each executor.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":  # driver and executor are one process
        own = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", own)
        return own
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


_cuts: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_here(spark: SparkSession) -> Iterator[None]:
    """Executions within give up their shuffle files when they end; only for ones whose result is a written table."""
    was = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, was) if was is not None else spark.conf.unset(CLEAN_UP)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_end_here(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _cuts[back] = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more; df is the very frame that cut() gave."""
    spark, path = df.sparkSession, _cuts.pop(df)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def columns_of(df: DataFrame) -> list:
    """All columns by name, names with dots included."""
    return [F.col(f"`{c}`") for c in df.columns]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving freed memory back to the system at the end of a task: Python workers live on between stages."""

    def tidied(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


def keep_rows(df: DataFrame, keep: Callable[[Iterator], Iterator]) -> DataFrame:
    """df with the batches that keep passes on; keep gets columns by place, as any name may occur."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(tidy(keep), plain.schema).toDF(*df.columns)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable over the undirected edges (src, dst), both long.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder.
    Both rounds are a groupBy-min and an equi-join, so no neighbourhood is ever gathered in one task.
    Self-loops are ignored; an empty edge table gives an empty result.
    """
    def fold(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    cur = cut(edges.select("src", "dst").where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    was = fold(cur)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = cur.unionByName(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = down.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
        new = cut(small.where("src <> dst").distinct(), "cc")
        now = fold(new)
        drop_cut(cur)
        cur = new
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return cur.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(cur.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct())
