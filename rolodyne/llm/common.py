"""Shared pieces of the training-data operators: session settings, Arrow batch
helpers and hashes. Written intermediate tables are the library's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shared import connected_components, intermediate, materialize, parts, rekey, remove, shared_dir

__all__ = ["connected_components", "intermediate", "materialize", "mix", "parts", "powers", "read_table", "rekey", "remove", "shared_dir", "slices", "tune"]

#: Rows and bytes of an Arrow batch; texts may be very long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: Base of the polynomial hashes modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have about `most` bytes at most."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = np.asarray(pc.binary_length(b.column(column)).fill_null(0)).astype("int64")
        ends = np.cumsum(size)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
