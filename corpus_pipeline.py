"""A corpus pipeline from the operators of tracewell.llm: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the rows of one stage are written as
Parquet and read again as the next one's docs. All stages but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import materialize, read_table
from tracewell.llm.decontaminate import drop_contaminated
from tracewell.llm.langid import drop_unknown_language, train_language_model
from tracewell.llm.nearcopies import drop_near_copies
from tracewell.llm.pieces import model_path, with_pieces
from tracewell.llm.toxicity import drop_toxic, train_severity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no recognised language go: null, without a letter, or far from every learned language.

    The model is fitted to labelled rows of this stage's input that are not held out; without any, all
    texts are of no recognised language. Repeated rows go or stay together; an empty table gives no rows.
    """
    return drop_unknown_language(docs, train_language_model(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts judged toxic go. The model is fitted to labelled documents of this stage's input.

    Without labels of both kinds nothing is judged toxic. Null and empty texts stay, repeated rows go
    or stay together; an empty table gives no rows.
    """
    return drop_toxic(docs, train_severity(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, the one with the smallest id.

    Null and empty texts are copies of each other. A repeated id loses no text that differs; a null id is
    the last choice; of rows equal in id and text one stays. An empty table gives no rows.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null texts, of documents or items, hold nothing; an empty benchmark drops nothing. Repeated rows go
    or stay together; an empty table gives no rows.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole text of each document: (doc_id, n_ids, ids, round_trip).

    Null and empty texts have no ids; each row comes out once, repeated ones as often as they came.
    """
    return with_pieces(docs, model_path()).select("doc_id", "n_ids", "ids", "round_trip")


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Models, fingerprints and merges are nothing that SQL can express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
