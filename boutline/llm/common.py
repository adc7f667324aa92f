"""What the training-data operators share: the query registry, table access and small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def carried(names: list[str] | None) -> Column:
    """Columns that pass through an operator, as one struct ``row``, so that no name of theirs meets one of the operator's."""
    return F.struct(*[F.col(f"`{n}`") for n in names]).alias("row") if names else F.struct(F.lit(0).alias("none")).alias("row")


def unpacked(names: list[str] | None) -> list[Column]:
    return [F.col(f"row.`{n}`").alias(n) for n in names or []]


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of a text column each (or one row), to bound what a task holds of them as Python objects."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
