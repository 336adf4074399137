"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed byte 2-grams and 3-grams of the whole text: one against
the rest for each language family, then one against one between the languages of the chosen family.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import append_columns, keep_rows, read_table, share

UNKNOWN = "und"

#: Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur", "si"),
    "semitic": ("ar", "he", "mt", "am"),
}


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), lang)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


#: ASCII other than letters becomes a space, so that marks and digits don't tell languages apart.
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str, bits: int) -> np.ndarray:
    """Square roots of the shares of hashed byte 2- and 3-grams: a vector of length 1."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    grams = np.concatenate((two, three | 1 << 24))
    counts = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)
    return np.sqrt(counts / max(1, len(grams)), dtype=np.float32)


Row = tuple[np.ndarray, np.ndarray]  # places and values of a text's features that are not zero


def sparse(text: str, bits: int) -> Row:
    x = features(text, bits)
    at = np.flatnonzero(x)
    return at.astype(np.uint32), x[at]


def train_svm(rows: list[Row], y: np.ndarray, width: int, c: float = 10.0, epochs: int = 60, seed: int = 5) -> np.ndarray:
    """Weights of a linear SVM (hinge loss) by dual coordinate descent; y is +1 or -1, classes weighted to balance.

    The rows have length 1. Each step changes one row's coefficient and the weights at its places, so
    that nothing but the rows and one weight vector is held. Rows at a bound of their coefficient that
    stay there are left out until the others have settled, then looked at once more.
    """
    n = len(y)
    cap = np.where(y > 0, c * n / max(1, 2 * (y > 0).sum()), c * n / max(1, 2 * (y < 0).sum()))
    a, w = np.zeros(n), np.zeros(width)
    rng = np.random.default_rng(seed)
    active, whole = np.arange(n), True
    for _ in range(epochs):
        moved, kept = 0.0, []
        for i in rng.permutation(active):
            at, x = rows[i]
            slope = y[i] * (w[at] @ x) - 1
            if not (a[i] == 0.0 and slope > 0.1 or a[i] == cap[i] and slope < -0.1):
                kept.append(i)
            new = min(max(a[i] - slope, 0.0), cap[i])
            if new != a[i]:
                w[at] += (new - a[i]) * y[i] * x
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            if whole:
                break
            active, whole = np.arange(n), True
        else:
            active, whole = np.array(kept, np.int64), len(kept) == n
    return w


@dataclass
class LanguageModel:
    """Columns of `weights`: one per family, then one per pair of languages within a family."""

    langs: list[str]
    bits: int
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        m = 3.0 * (features(text, self.bits).astype(np.float64) @ self.weights)
        sure = 1 / (1 + np.exp(-m))
        k = len(self.families)
        best = int(np.argmax(m[:k])) if k > 1 else 0
        score = float(sure[best]) if k > 1 else 1.0
        own = [x for x in self.langs if family(x) == self.families[best]]
        if len(own) == 1:
            return own[0], score
        votes = dict.fromkeys(own, 0.0)
        for j, (a, b) in enumerate(self.pairs):
            if a in votes:
                votes[a] += sure[k + j]
                votes[b] += 1 - sure[k + j]
        lang = max(own, key=lambda x: (votes[x], x))
        return lang, score * votes[lang] / (len(own) - 1)


def fit(samples: list[tuple[str | None, str]], bits: int = 14) -> LanguageModel:
    """A model from (text, lang); texts without a letter are left out."""
    return fit_rows([(sparse(t, bits), g) for t, g in samples if t and has_letter(t)], bits)


def fit_rows(samples: list[tuple[Row, str]], bits: int) -> LanguageModel:
    langs = sorted({g for _, g in samples})
    model = LanguageModel(langs, bits, sorted({family(g) for g in langs}))
    if not langs:
        return model
    rows, lang, width = [r for r, _ in samples], np.array([g for _, g in samples]), 1 << bits
    of = np.array([family(g) for g in lang])
    columns = [train_svm(rows, np.where(of == f, 1.0, -1.0), width) if len(model.families) > 1 else np.zeros(width) for f in model.families]
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            if family(a) == family(b):
                both = np.flatnonzero((lang == a) | (lang == b))
                model.pairs.append((a, b))
                columns.append(train_svm([rows[k] for k in both], np.where(lang[both] == a, 1.0, -1.0), width))
    model.weights = np.stack(columns, 1)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train_language_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 300, most_langs: int = 100, bits: int = 14) -> LanguageModel:
    """Fit on a bounded sample of the rows that are not held out: `per_lang` texts or fewer of each language.

    The sample of a language is drawn by a hash of the id, so it is the same in every run. At most
    `most_langs` languages are learned, the most frequent ones. What reaches the driver is one row of
    features for each text of the sample, some ten kilobytes whatever the text's length, and per
    language a count.
    """
    usable = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = usable.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not sizes:
        return fit([], bits)
    draw = F.pmod(F.xxhash64(F.lit("language sample"), F.col(doc_id)), F.lit(1 << 30))
    share_of = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1 << 30, int((1 << 30) * 1.3 * per_lang / r["count"])))])
    drawn = usable.select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("draw")).where(F.col("draw") < F.element_at(share_of, F.col("lang")))
    once = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text"))  # an id that many rows repeat is drawn once

    def featured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [(r["lang"], r["draw"], *sparse(r["text"], bits)) for r in batch.to_pylist() if has_letter(r["text"])]
            columns = [[f[0] for f in found], [f[1] for f in found], [f[2].tobytes() for f in found], [f[3].tobytes() for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["lang", "draw", "at", "x"])

    taken: dict[str, list] = {}
    for r in once.mapInArrow(featured, "lang string, draw long, at binary, x binary").toLocalIterator():
        taken.setdefault(r["lang"], []).append((r["draw"], bytes(r["at"]), bytes(r["x"])))
    samples = []
    for g, rows in sorted(taken.items()):
        samples += [((np.frombuffer(at, np.uint32), np.frombuffer(x, np.float32)), g) for _, at, x in sorted(rows)[:per_lang]]
    return fit_rows(samples, bits)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (0 to 1), from the whole text and nothing else; no shuffle.

    A text that is null or has no letter is 'und' with score 0, as is every text under a model that
    learned nothing. Rows are judged one by one, repeated ones alike. Columns of the same names give way.
    """
    sent, at = share(docs.sparkSession, model), docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]):
        known = sent()
        for batch in it:
            found = [known.predict(x.as_py()) for x in batch.column(at)]
            yield batch, [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    return append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], batches)


def drop_unknown_language(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.3) -> DataFrame:
    """`docs` without texts of no recognised language: 'und', or a score under `least`; all columns stay as they came.

    Null texts and texts without a letter go, as do all texts under a model that learned nothing.
    Repeated rows are judged alike, texts of any length whole; an empty table gives no rows. No shuffle.
    """
    sent, at = share(docs.sparkSession, model), docs.columns.index(text)

    def start():
        known = sent()

        def keep(value: str | None) -> bool:
            lang, score = known.predict(value)
            return lang != UNKNOWN and score >= least

        return lambda batch: [keep(x.as_py()) for x in batch.column(at)]

    return keep_rows(docs, start)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs)
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
