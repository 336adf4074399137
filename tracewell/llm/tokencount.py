"""Token counts with a digest cache.

A text is keyed by the digest of its normalised content, a tokenizer by the digest of its file, its
options and its library's version. Counts that the cache holds are joined; each distinct content
that it lacks is encoded once and its count appended.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import materialize, read_table, shared_path

_SCHEMA = "tokenizer string, content binary, n_tokens long"


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer file: .json for the tokenizers library, .model for sentencepiece.

    The file has to lie at the same path on the driver and the executors, as an installed package's
    data does.
    """

    path: str
    batch: int = 256  # texts encoded at a time

    def version(self) -> str:
        kind = "sentencepiece" if self.path.endswith(".model") else "tokenizers"
        library = __import__(kind)
        with open(self.path, "rb") as f:
            return hashlib.sha256(f"{kind} {library.__version__} plain\n".encode() + f.read()).hexdigest()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without begin, end or added special tokens, nothing cut off."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        loaded = sys.__dict__.setdefault("_tracewell_tokenizers", {})  # outlives the task
        if self.path not in loaded:
            if self.path.endswith(".model"):
                from sentencepiece import SentencePieceProcessor

                loaded[self.path] = SentencePieceProcessor(model_file=self.path)
            else:
                from tokenizers import Tokenizer

                loaded[self.path] = made = Tokenizer.from_file(self.path)
                made.no_truncation()
                made.no_padding()
        encoder = loaded[self.path]
        if self.path.endswith(".model"):
            return [len(x) for x in encoder.encode(texts, num_threads=1)]
        return [len(x) for x in encoder.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(it: Iterator[pa.RecordBatch], tokenizer: TokenizerFile, version: str) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, tokenizer.batch):
            part = batch.slice(at, tokenizer.batch)
            counts = tokenizer.counts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts)), part.column(0), pa.array(counts, pa.int64())], names=["tokenizer", "content", "n_tokens"])


def count_tokens(docs: DataFrame, cache: str, tokenizer: TokenizerFile, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row; appends to the Parquet table at `cache`.

    Normalised content: a null text counts as empty, else the text as it is, since the tokenizers
    tell any two texts apart. Ids may be null and rows repeat; each row comes out once. An empty
    table adds nothing. Columns other than the two are ignored. Two runs that append the same content
    at once leave it twice in the cache with the same count, which does no harm: it is read grouped.
    The append is committed as a whole or not at all.
    """
    spark = docs.sparkSession
    version = tokenizer.version()
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), content.alias("text"), F.unhex(F.sha2(content, 256)).alias("content"))

    def stored() -> DataFrame:
        return spark.read.schema(_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)

    spark.createDataFrame([], _SCHEMA).write.mode("append").parquet(cache)  # the table exists from here on
    missing = rows.select("content", "text").join(stored().select("content"), "content", "left_anti").dropDuplicates(["content"])
    missing.mapInArrow(lambda it: _encode(it, tokenizer, version), _SCHEMA).write.mode("append").parquet(cache)
    # written, so that the join below reads both sides from exchanges and a hot text's rows are split
    known = materialize(stored().groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    small = rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return small.join(known, "content", "left").select("doc_id", "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = TokenizerFile(str(public_tokenizers.path("byte_bpe_50k.json")))
    counted = count_tokens(read_table(spark, sf_dir, "documents"), shared_path(spark, "token-cache"), tokenizer)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
