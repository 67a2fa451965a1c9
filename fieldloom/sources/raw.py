"""Raw arrays, text, CSV and chunk files."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.metadata import SPARK_TYPES, WIDTHS
from fieldloom.sources.fixtures import Field

#: NumPy's names of the types.
KINDS = {"float": "f4", "double": "f8", "uint8": "u1", "int8": "i1", "uint16": "u2", "int16": "i2", "uint32": "u4", "int32": "i4", "uint64": "u8", "int64": "i8"}
RECORDS, PIECE = 1 << 16, 1 << 22

#: NumPy's names of the column types that hold them.
HELD = {"float": "f4", "double": "f8", "uint8": "i2", "int8": "i1", "uint16": "i4", "int16": "i2", "uint32": "i8", "int32": "i4", "int64": "i8"}


def read_raw(spark: SparkSession, path: str, dtype: str = "float", dims: Sequence[int] | None = None, big_endian: bool = False, name: str = "raw") -> Field:
    """A raw array as a field of its own type; its length must be the product of dims, or a multiple of the width where dims is None.

    Hadoop's input format cuts the file into fixed-length records, so one of any size is read in parallel, from whatever
    store Spark reads; the place of a task's part gives its cells' positions.  path is one file.
    """
    width = WIDTHS[dtype]
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    n = size // width
    if size % width or (dims is not None and math.prod(dims) != n):
        raise ValueError(f"{path} has {size} bytes, not {'a multiple of ' + str(width) if dims is None else f'{dims} of {width}'}")
    record = next(k for k in range(min(n, RECORDS), 0, -1) if n % k == 0) if n else 1
    kind = (">" if big_endian else "<") + KINDS[dtype]
    records = spark.sparkContext.binaryRecords(path, record * width)
    begins = [part.serializableHadoopSplit().value().getStart() for part in records._jrdd.rdd().partitions()]

    def pieces(part: int, own: Iterator[bytes]) -> Iterator[tuple[int, bytearray]]:
        """Records joined, as a length without large divisors makes small ones."""
        at, held = begins[part], bytearray()
        for data in own:
            held += data
            if len(held) >= PIECE:
                yield at // width, held
                at, held = at + len(held), bytearray()
        if held:
            yield at // width, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(data.as_py(), kind)
                values = values.astype(values.dtype.newbyteorder("<"))
                cells = pa.array(values).cast(pa.decimal128(20, 0)) if dtype == "uint64" else pa.array(values.astype("<" + HELD[dtype]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values))), cells], ["idx", "v"])

    cells = spark.createDataFrame(records.mapPartitionsWithIndex(pieces), "at long, data binary").mapInArrow(run, f"idx long, v {SPARK_TYPES[dtype]}")
    return Field(name, cells, tuple(dims) if dims else (n,), dtype)


def write_raw(field: Field, path: str, dtype: str | None = None) -> None:
    """A raw array, little-endian, as one file of the driver's machine; for results that fit one.  Larger ones go to write_chunks()."""
    kind = "<" + KINDS[dtype or field.dtype]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary())], ["data"])

    parts = field.cells.orderBy("idx").select("v").mapInArrow(run, "data binary")
    with open(path, "wb") as out:
        for row in parts.toLocalIterator():
            out.write(row["data"])


def write_text(field: Field, path: str) -> None:
    """One value a line, in order."""
    field.cells.orderBy("idx").select(F.col("v").cast("string")).write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.partitionBy("field").option("compression", "none").parquet(path)


def read_chunks(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if field is None else rows.where(F.col("field") == field)
