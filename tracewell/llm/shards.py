"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash. Pass 2
takes each bucket into one task, shuffles it by Fisher-Yates and writes it. The buckets one after
the other are a random order of all records; shards are equal ranges of that order, and a shard's
records lie in a few consecutive bucket files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import materialize, read_table, shared_path


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0 .. n-1."""
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def bucket_size(spark: SparkSession) -> int:
    """Bytes of rows that a task can hold and shuffle: a twelfth of a core's share of executor memory, 16 MB to 1 GB.

    Larger executors get larger and fewer buckets, which is what keeps the number of partitions of a
    very large shuffle in hand.
    """
    conf = spark.sparkContext.getConf()
    local = conf.get("spark.master", "").startswith("local[")
    memory = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower()
    number = int("".join(c for c in memory if c.isdigit()) or 1) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(memory.rstrip("b")[-1:], 0)
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "2"))
    return min(1 << 30, max(16 << 20, number // max(1, cores) // 12))


def _plain(field: T.StructField):
    """A column as something that has a length and a hash."""
    return F.to_json(f"`{field.name}`") if isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(f"`{field.name}`")


def _row_size(docs: DataFrame):
    """Bytes of a row, about: those of its strings, binaries and nested values, and 8 for each column."""
    long = [f for f in docs.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.MapType, T.ArrayType, T.StructType))]
    return sum((F.coalesce(F.octet_length(_plain(f)), F.lit(0)).cast("long") for f in long), F.lit(8 * len(docs.columns)).cast("long"))


def _drawn(docs: DataFrame, seed: int) -> DataFrame:
    """`docs` with `__draw`, a seeded hash of the whole row.

    A task that runs again draws the same numbers, whatever the order in which its rows come. Rows that
    repeat as a whole would all draw the same: those are numbered in a table of their own, which is
    written once, and draw by their number too.
    """
    fields = docs.schema.fields
    # a null is hashed by its place, which xxhash64 alone would skip
    whole = F.xxhash64(F.lit(seed), *[x for f in fields for x in (_plain(f), F.col(f"`{f.name}`").isNull())])
    drawn = docs.withColumn("__draw", whole)
    repeated = materialize(drawn.groupBy("__draw").count().where(F.col("count") > 1).select("__draw"), "repeated-rows")
    n = repeated.count()
    if not n:
        return drawn
    few = F.broadcast(repeated) if n <= 100_000 else repeated  # 8 bytes each
    own = materialize(drawn.join(few, "__draw", "left_semi").withColumn("__number", F.monotonically_increasing_id()), "numbered-rows")
    own = own.withColumn("__draw", F.xxhash64(F.lit(seed), "__draw", "__number")).drop("__number")
    return drawn.join(few, "__draw", "left_anti").select(*drawn.columns).unionByName(own.select(*drawn.columns))


def shuffle_to(docs: DataFrame, path: str, seed: int = 17, bucket_bytes: int | None = None) -> None:
    """Write `docs` in shuffled order to Parquet at `path`, with `__bucket` and `__at` (place in the bucket).

    Each row is scattered by a hash of the whole row, so copies of a text that differ in anything else
    spread over all buckets like any other rows, as do rows that repeat as a whole. In a bucket rows
    are put in the order of that hash before the shuffle; so the same rows, none repeated as a whole,
    give the same order, whatever the order, files or splits in which they come.
    """
    names = [c for c in docs.columns if c not in ("__draw", "__number", "__bucket", "__at")]
    docs = docs.select(*[f"`{c}`" for c in names])
    bucket_bytes = bucket_bytes or bucket_size(docs.sparkSession)
    total = docs.agg(F.sum(_row_size(docs))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    dealt = _drawn(docs, seed).repartition(buckets, "__draw")
    schema = T.StructType([*docs.schema.fields, T.StructField("__bucket", T.IntegerType()), T.StructField("__at", T.LongType())])

    def shuffled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)
        if not batches:
            return
        bucket = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches)
        at_draw = table.schema.names.index("__draw")
        first = np.argsort(table.column(at_draw).to_numpy(), kind="stable")
        key = hashlib.sha256(f"{seed} {bucket}".encode()).digest()
        order = first[fisher_yates(len(first), np.random.default_rng(np.frombuffer(key, np.uint32)))]
        table = table.drop_columns(["__draw"])
        for lo in range(0, len(order), 4096):  # rows leave in the new order, some at a time
            part = table.take(pa.array(order[lo : lo + 4096])).combine_chunks().to_batches()
            for b in part:
                extra = [pa.array(np.full(b.num_rows, bucket, np.int32)), pa.array(np.arange(lo, lo + b.num_rows))]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=schema.names)

    dealt.mapInArrow(shuffled, schema).write.parquet(path)


def assign_shards(written: DataFrame, shards: int) -> DataFrame:
    """`written` (see shuffle_to) with `shard` and `slot`; counts of shards differ by one at most.

    One count per bucket reaches the driver and is broadcast: at most one for each `bucket_bytes` of
    input, which is 40 MB for 100 TB.
    """
    spark = written.sparkSession
    counts = sorted(tuple(r) for r in written.groupBy("__bucket").count().collect())
    starts, total = [], 0
    for bucket, n in counts:
        starts.append((bucket, total))
        total += n
    offsets = spark.createDataFrame(starts, "__bucket int, __start long")
    place = F.col("__start") + F.col("__at")
    shard = F.expr(f"CAST((({shards} * (__start + __at + 1)) - 1) DIV {max(total, 1)} AS INT)")
    placed = written.join(F.broadcast(offsets), "__bucket").withColumn("shard", shard)
    return placed.withColumn("slot", place - F.expr(f"(shard * {total}L) DIV {shards}")).drop("__start")


def shard_documents(docs: DataFrame, path: str, shards: int = 24, seed: int = 17, bucket_bytes: int | None = None) -> DataFrame:
    """All rows of `docs`, shuffled and written at `path`, with `shard` (from 0) and `slot` (from 0 in its shard).

    Law: the counts of any two shards differ by one at most. Nulls, empty texts and repeated rows are
    rows like any other. With fewer rows than shards some shards are empty; an empty table gives no
    rows. Columns named shard, slot or starting with two underscores as above give way.
    """
    docs = docs.drop("shard", "slot")
    shuffle_to(docs, path, seed, bucket_bytes)
    return assign_shards(docs.sparkSession.read.parquet(path), shards).drop("__bucket", "__at")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = shard_documents(docs, shared_path(spark, "shards"), 24)
    text = F.coalesce("text", F.lit(""))
    return made.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
