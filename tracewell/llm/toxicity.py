"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w . x - theta_k) with one weight vector for all ordered thresholds theta. The
features are words and word beginnings that the labels single out, each as its share of the words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import append_columns, keep_rows, read_table, share

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6, 7, 8)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _rate(count: float, words: int, prior: float, power: float) -> float:
    """What `count` words weigh in a text: per hundred words, `prior` words added lest a single one decide, and
    the length to a power under 1, lest many words hide a few. One formula for texts of every length."""
    return count * 100.0 ** power / (words + prior) ** power


def features_of(word: str) -> list[str]:
    return [word] + [word[:k] + "*" for k in _PREFIXES if len(word) > k]


@dataclass
class SeverityModel:
    weights: dict[str, float]
    thresholds: list[float]  # ascending; one fewer than grades
    prior: float = 40.0
    power: float = 0.5

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def judge(self, text: str | None, cache: dict[str, float]) -> tuple[float, list[float]]:
        """Expected severity and P(grade > k) for each k."""
        words = words_of(text)
        total = 0.0
        for w, n in Counter(words).items():
            s = cache.get(w)
            if s is None:
                s = self.word_weight(w)
                if len(cache) < 100_000:
                    cache[w] = s
            total += n * s
        eta = _rate(total, len(words), self.prior, self.power)
        over = [1 / (1 + np.exp(min(60.0, t - eta))) for t in self.thresholds] if words else [0.0] * len(self.thresholds)
        return float(sum(over)), over


def select_features(samples: list[tuple[list[str], int]], most: int = 2048, least_docs: int = 5, least_z: float = 4.0) -> list[str]:
    """Features that occur in toxic texts far more often than in others, by the z score of the two shares."""
    seen, n = (Counter(), Counter()), [0, 0]
    for words, toxic in samples:
        n[toxic] += 1
        seen[toxic].update({f for w in set(words) for f in features_of(w)})
    out = []
    for f, a in seen[1].items():
        b = seen[0][f]
        if a >= least_docs and a / n[1] >= 3 * (b + 0.25) / max(1, n[0]):
            p = (a + b) / (n[0] + n[1])
            z = (a / n[1] - b / max(1, n[0])) / np.sqrt(p * (1 - p) * (1 / n[1] + 1 / max(1, n[0])) + 1e-12)
            if z >= least_z:
                out.append((z, f))
    return [f for _, f in sorted(out, reverse=True)[:most]]


def loss(p: np.ndarray, x: np.ndarray, y: np.ndarray, balance: np.ndarray, grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """The penalised mean negative log-likelihood of ordered grades, and its gradient.

    `p` holds the weights, the first threshold and the logarithms of the gaps above it, which keeps the
    thresholds in order; `balance` weighs the rows.
    """
    n, d = x.shape
    w, base, gaps = p[:d], p[d], np.exp(p[d + 1 :])
    theta = base + np.concatenate(([0.0], np.cumsum(gaps)))
    eta = x @ w
    s = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -40, 40)))  # P(y > k)
    full = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), 1)
    rows = np.arange(n)
    prob = np.maximum(full[rows, y] - full[rows, y + 1], 1e-12)
    slope = np.concatenate((np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))), 1)
    scale = -balance / prob / n
    d_eta = scale * (slope[rows, y] - slope[rows, y + 1])
    d_theta = np.array([(scale * slope[:, k + 1])[y == k].sum() - (scale * slope[:, k + 1])[y == k + 1].sum() for k in range(grades - 1)])
    gradient = np.concatenate((x.T @ d_eta + ridge * w, [d_theta.sum()], [gaps[k] * d_theta[k + 1 :].sum() for k in range(grades - 2)]))
    return float(-(balance * np.log(prob)).mean() + ridge * (w @ w) / 2), gradient


def fit_cumulative(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = 1e-3, steps: int = 250, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that minimise `loss`, both classes weighted alike; Adam on the whole sample."""
    n, d = x.shape
    balance = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y == 0).sum()))
    p = np.concatenate((np.zeros(d), [1.0], np.full(grades - 2, 0.5)))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        _, g = loss(p, x, y, balance, grades, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / np.sqrt(1 + step / 100)
    return p[:d], p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))


def fit(samples: list[tuple[str | None, int]], grades: int = 4, prior: float = 40.0, power: float = 0.5) -> SeverityModel:
    """A model from (text, toxic 0 or 1). A text that repeats another one exactly, with the same label, counts once.

    The labels have two values; the grades above 0 split the toxic texts by the share of their words
    that the selected features cover, into equal parts. Without both classes nothing is learned, and
    every severity is 0.
    """
    split = [(words_of(t), y) for t, y in dict.fromkeys((t, int(y)) for t, y in samples)]
    chosen = select_features(split) if len({y for _, y in split}) == 2 else []
    if not chosen:
        return SeverityModel({}, [50.0] * (grades - 1), prior, power)
    at = {f: i for i, f in enumerate(chosen)}
    rows, share_of = [], []
    for words, _ in split:
        counts, hit = Counter(), 0
        for w, n in Counter(words).items():
            fs = [at[f] for f in features_of(w) if f in at]
            for f in fs:
                counts[f] += n
            hit += n * bool(fs)
        rows.append(counts)
        share_of.append(_rate(hit, len(words), prior, power))
    toxic = np.array([y for _, y in split])
    share_of = np.array(share_of)
    cuts = np.quantile(share_of[toxic == 1], np.arange(1, grades - 1) / (grades - 1))
    y = np.where(toxic == 1, 1 + np.searchsorted(cuts, share_of, side="right"), 0)
    x = np.zeros((len(split), len(chosen)), np.float64)
    for i, counts in enumerate(rows):
        for f, n in counts.items():
            x[i, f] = _rate(n, len(split[i][0]), prior, power)
    w, theta = fit_cumulative(x, y, grades)
    return SeverityModel({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-6}, theta.tolist(), prior, power)


def train_severity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = 1500) -> SeverityModel:
    """Fit on a bounded sample of labelled rows: at most `per_class` texts of either label, drawn by a hash of the id.

    Labels that are null are ignored, as are labels without a document. A document with several labels
    is toxic if one of them says so; of rows that repeat an id the least text counts. At most twice `per_class` texts reach the driver.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("severity sample"), F.col("__id")), F.lit(1 << 30))
    bound = F.when(F.col("toxic") == 1, min(1 << 30, int((1 << 30) * 1.3 * per_class / max(1, sizes.get(1, 0))))).otherwise(min(1 << 30, int((1 << 30) * 1.3 * per_class / max(1, sizes.get(0, 0)))))
    drawn = known.withColumn("draw", draw).where(F.col("draw") < bound)  # about 1.3 times per_class rows of each label, whatever the input
    rows = drawn.orderBy("draw").limit(8 * per_class).collect()
    chosen: dict[int, list] = {0: [], 1: []}
    for r in rows:
        if len(chosen[r["toxic"]]) < per_class:
            chosen[r["toxic"]].append(r["__id"])
    if not (chosen[0] and chosen[1]):
        return fit([])
    kinds = T.StructType([T.StructField("__id", known.schema["__id"].dataType), T.StructField("toxic", T.IntegerType())])
    picked = docs.sparkSession.createDataFrame([(i, y) for y, ids in chosen.items() for i in ids], kinds)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(picked), "__id").groupBy("__id", "toxic").agg(F.min("text").alias("text")).orderBy("__id").collect()
    return fit([(r["text"], r["toxic"]) for r in texts])


def with_severity(docs: DataFrame, model: SeverityModel, text: str = "text") -> DataFrame:
    """`docs` with `severity` (expected grade), `grade` (the most likely one) and `toxic` (P(grade > 0) at least one half).

    The whole text is judged; null texts and texts without words have severity 0. No shuffle. Repeated
    rows are judged alike; columns of the same names give way; an empty table gives no rows.
    """
    sent, at = share(docs.sparkSession, model), docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]):
        known, cache = sent(), {}
        for batch in it:
            found = [known.judge(x.as_py(), cache) for x in batch.column(at)]
            grade = [int(np.argmax(np.subtract([1.0, *over], [*over, 0.0]))) for _, over in found]
            yield batch, [pa.array([s for s, _ in found], pa.float64()), pa.array(grade, pa.int32()), pa.array([bool(over[0] >= 0.5) for _, over in found], pa.bool_())]

    fields = [T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    return append_columns(docs, fields, batches)


def drop_toxic(docs: DataFrame, model: SeverityModel, text: str = "text") -> DataFrame:
    """`docs` without the rows judged toxic; all columns stay as they came, whatever their names. No shuffle.

    Null texts and texts without words are not toxic. Repeated rows are judged alike, texts of any
    length whole; an empty table gives no rows.
    """
    sent, at = share(docs.sparkSession, model), docs.columns.index(text)

    def start():
        known, cache = sent(), {}
        return lambda batch: [known.judge(x.as_py(), cache)[1][0] < 0.5 for x in batch.column(at)]

    return keep_rows(docs, start)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_severity(docs, read_table(spark, sf_dir, "labels"))
    return with_severity(docs, model).select("doc_id", "severity", "grade", "toxic")
