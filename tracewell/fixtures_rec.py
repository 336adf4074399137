"""A small recording made of the `embeddings` table, with stimuli from `events`.

20 channels in two shanks, 1000 samples a second: depth pairs, a gap inside a shank, a boundary
between shanks, rows with and without neighbours at the distance of the local median.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 1000.0


def channels(spark: SparkSession) -> DataFrame:
    slot = F.col("id").cast("int")
    shank, k = F.floor(slot / 10).cast("int"), slot % 10
    y = 20.0 * F.floor(k / 2) + F.when((shank == 0) & (k >= 6), 100.0).otherwise(0.0)
    return spark.range(20).select((slot * 19).alias("ch"), (32.0 * (k % 2) + 250.0 * shank).alias("x_um"), y.alias("y_um"), shank.alias("shank"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, t, uv)"""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    each = table.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return each.select(((F.col("vec_id") % 20) * 19).cast("int").alias("ch"), (F.expr("vec_id DIV 20") * 64 + F.col("pos")).alias("t"), (F.col("v").cast("double") * 200).alias("uv"))


def n_samples(spark: SparkSession, sf_dir: str) -> int:
    return (spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max(F.expr("vec_id DIV 20"))).first()[0] + 1) * 64


def ends(spark: SparkSession, sf_dir: str) -> list[int]:
    """The number of samples of each of the 20 channels: the last vectors may leave some shorter."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = table.groupBy((F.col("vec_id") % 20).alias("k")).agg(F.max(F.expr("vec_id DIV 20")).alias("last")).collect()
    last = {r["k"]: r["last"] for r in found}
    return [(last.get(k, -1) + 1) * 64 for k in range(20)]


def stims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stim_idx, onset_s) for every signup event; ids beyond the recording wrap around, so onsets repeat."""
    n = n_samples(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == "signup")
    return events.select(F.col("event_id").alias("stim_idx"), (F.col("event_id") % n / 1000.0).alias("onset_s"))
