"""Pieces that several text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracewell.session import materialize, shared_path

__all__ = ["append_columns", "in_arrow", "keep_rows", "let", "materialize", "numbered", "read_table", "share", "shared_path", "unused"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered(rows: DataFrame, keys: list[str], turn: str, ties: list[str], pos: str, span: int = 1024) -> DataFrame:
    """`rows` with `pos`, the place from 1 among the rows of equal `keys` (not null) by `turn`, nulls first, then by `ties`.

    Rows meet by key and range of `span` turns, so a key with very many turns is many small groups.
    """
    part, first = unused(rows, "__part"), unused(rows, "__first")
    rows = rows.withColumn(part, F.coalesce(F.floor(F.col(turn) / span), F.lit(-(1 << 62)).cast("long")))
    sizes = rows.groupBy(*keys, part).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(first))
    inside = W.partitionBy(*keys, part).orderBy(F.col(turn).asc_nulls_first(), *ties)
    placed = rows.withColumn(pos, F.row_number().over(inside)).join(sizes, [*keys, part])
    return placed.withColumn(pos, F.col(first) + F.col(pos)).drop(part, first)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of `value`, whose classes travel with it; call the result on an executor."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def _give_back() -> None:
    """Memory that this worker has freed goes back to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`df.mapInArrow` in batches of up to 4 MB (a setting of the session), whatever the length of texts, from tasks that return the memory they have used."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        _give_back()

    return df.mapInArrow(whole, schema)


def append_columns(df: DataFrame, fields: list[T.StructField], batches: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]]) -> DataFrame:
    """`df` with columns that Python computes from Arrow batches; no shuffle.

    `batches` maps an iterator of batches to pairs of the rows to keep and the arrays to append to
    them. A column of `df` that has the name of an appended one gives way to it.
    """
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*kept, *fields])
    positions = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, arrays in batches(it):
            columns = [batch.column(i) for i in positions] + list(arrays)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return in_arrow(df, run, schema)


def keep_rows(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of `df` that Python decides to keep, all columns untouched whatever their names; no shuffle.

    `start` is called once per task and returns the decision for a batch.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = start()
        for batch in it:
            yield batch.filter(pa.array(decide(batch), pa.bool_()))

    return in_arrow(df, run, df.schema)
