"""Compression of fields that arrive piece by piece: a stateless stream of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fieldloom.functions.metadata import chunk_header
from fieldloom.operators.codecs import codec

ARRIVING = "field string, chunk_id long, start long, dims array<long>, vals array<float>"


def compress_stream(pieces: DataFrame, name: str, eb: float, method: int = 3) -> DataFrame:
    """Rows of ARRIVING to chunk rows.  Every row stands alone, so there's no state and no watermark."""
    from fieldloom.operators.selection import CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, chunk, start, dims, values in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                payload = codec(name).encode(np.array(values, "<f4").reshape(dims), eb)
                data = chunk_header(len(payload), method, eb) + payload
                out.append((label, chunk, name, eb, method, "float", dims, start, data, len(data)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64()]
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return pieces.mapInArrow(run, CHUNKS)


def start(pieces: DataFrame, name: str, eb: float, path: str, checkpoint: str) -> StreamingQuery:
    """Write chunks of everything that has arrived, then stop."""
    return compress_stream(pieces, name, eb).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
