"""Compressed texts, for joins that have to move whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows compressed at a time.
ROWS = 2000


def packed_texts(rows: DataFrame) -> DataFrame:
    """id long, text_hash int, packed binary of rows (id, text); null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                blobs = pa.array([press.compress(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), blobs], ["id", "text_hash", "packed"])

    own = rows.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return own.select("id", F.hash("text").alias("text_hash"), "text").mapInArrow(run, "id long, text_hash int, packed binary")


def unpacked(blobs: list[bytes]) -> list[bytes]:
    own = zstandard.ZstdDecompressor()
    return [own.decompress(x) for x in blobs]
