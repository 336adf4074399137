"""Line-first quality rules in built-in SQL expressions only.

Each line of a document is judged by itself; failing lines are removed; a document that loses too
much of its text that way is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import let, read_table, unused

_SPACE = r"[ \t-\r]+"


BOILERPLATE = (
    r"(?i)^\s*(?:all rights reserved\b|(?:released|licensed) under\b|this work is licensed under\b|copyright (?:\(c\)|©|\d{4})|"
    r"(?:we|this (?:site|website)) uses? cookies\b|(?:accept|manage) cookies\b|privacy policy\b|terms of (?:use|service)\b|"
    r"subscribe to our newsletter\b|click here\b|read more\b|share on (?:facebook|twitter)\b|lorem ipsum\b|javascript\b.{0,40}\bdisabled\b)"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document rule."""

    nav_separators: int = 3  # a line with so many separators between words is navigation ...
    nav_share: float = 0.25  # ... if they are so large a share of its tokens
    mark_share: float = 0.3  # share of tokens that end in doubled marks: decoration or shouting
    min_unpunctuated: int = 8  # words of a line without any sentence end that make it fail
    max_lost: float = 0.5  # share of a document's word characters that may go


def line_verdict(line: Column, rules: LineRules) -> Column:
    """Why a line fails: 'navigation', 'punctuation', 'boilerplate'; null if it passes."""
    tokens = F.regexp_count(line, F.lit(r"[^ \t-\r]+"))
    bars = F.regexp_count(line, F.lit(r"(?:^|[ \t-\r])(?:\||»|›|>|•|·)(?=[ \t-\r]|\z)"))
    marks = F.regexp_count(line, F.lit(r"(?:[#*$%&|<>]{2}|!!)(?=[ \t-\r]|\z)"))
    boiler = line.rlike(BOILERPLATE)
    ends = line.rlike(r"[.!?…:;。！？]")
    marked = line.rlike(r"[#*$%&|<>]{2}|!!|[|»›>•·]")  # cheap: most lines end here
    return (
        F.when(marked & (bars >= rules.nav_separators) & (bars >= rules.nav_share * tokens), "navigation")
        .when(marked & (marks > 0) & (marks >= rules.mark_share * tokens), "punctuation")
        .when(~ends & (tokens >= rules.min_unpunctuated), "punctuation")
        .when(boiler, "boilerplate")
    )


def _letters(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(text, _SPACE, ""))


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words in windows of `width` that occur twice or more in the array, first occurrences included.

    Windows are compared by their 64-bit hashes. A text without a repeated window ends at the size
    of its set of hashes; otherwise windows are sorted with their positions, those beside an equal
    one are kept, and the lengths of their union are added up. No step is quadratic.
    """
    at = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            return F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | (F.get(p, k + 1)["h"] == x["h"]))

        places = let(pairs, lambda p: F.sort_array(F.transform(twice(p), lambda x: x["i"])))
        spans = lambda s: F.transform(s, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1) - i, F.lit(width))))
        return let(places, lambda s: F.aggregate(spans(s), F.lit(0), lambda a, x: a + x))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))).cast("long")


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """`docs` with `clean_text`, `removed` (struct of lines removed by rule) and `lost_share`.

    `lost_share` is the share of word characters in removed lines, 0 for a text without words. A null
    text has a null clean text and loses nothing; lines without words pass. A text of any length is
    judged whole. Columns of the same names give way; other columns are carried along.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = unused(docs, "__lines")
    judged = docs.withColumn(lines, F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), line_verdict(x, rules).alias("why"))))
    count = lambda why: F.size(F.filter(lines, lambda x: x["why"] == why)).alias(why)
    kept = F.array_join(F.transform(F.filter(lines, lambda x: x["why"].isNull()), lambda x: x["line"]), "\n")
    judged = judged.withColumn("clean_text", F.when(F.col(text).isNotNull(), kept)).withColumn("removed", F.struct(count("navigation"), count("punctuation"), count("boilerplate")))
    all_chars = _letters(t)
    lost = F.when(F.col("removed.navigation") + F.col("removed.punctuation") + F.col("removed.boilerplate") == 0, 0.0).otherwise(
        let(all_chars, lambda n: F.when(n == 0, 0.0).otherwise(1 - _letters(F.coalesce(F.col("clean_text"), F.lit(""))) / n))
    )
    return judged.withColumn("lost_share", lost).drop(lines)


def quality_rules(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """`clean_lines` with the base counts of a text and the verdict `kept`.

    Nulls and texts without words have no words and fail the base rule. Rows are judged one by one:
    ties, repeated rows and an empty table need nothing special.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    base = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    own = unused(docs, "__base")
    found = (
        clean_lines(docs, text, rules)
        .withColumn(own, base)
        .withColumn("n_words", F.col(f"{own}.n_words"))
        .withColumn("word_chars", F.col(f"{own}.word_chars"))
        .withColumn("n_symbols", sum(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in "#*$%&|<>").cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", F.col(f"{own}.n_repeat_words"))
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_share") <= rules.max_lost)).drop(own)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_R = LineRules()
OP5_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM t
), grams AS (
  SELECT rid, i, array_to_string(words[i : i + 7], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM twice, (SELECT unnest(range(0, 8)) AS k)) GROUP BY rid
), lines AS (
  SELECT rid, line, list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> '') AS tokens
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)
), counted AS (
  SELECT *, len(tokens) AS n, len(list_filter(tokens, lambda x: x IN ('|', '»', '›', '>', '•', '·'))) AS bars,
    len(list_filter(tokens, lambda x: regexp_matches(x, '(?:[#*$%&|<>][#*$%&|<>]|!!)$'))) AS marks
  FROM lines
), lost AS (
  SELECT rid, sum(len(regexp_replace(line, '[ \t-\r]+', '', 'g'))) FILTER (
    (bars >= {_R.nav_separators} AND bars >= {_R.nav_share} * n) OR (marks > 0 AND marks >= {_R.mark_share} * n)
    OR (n >= {_R.min_unpunctuated} AND NOT regexp_matches(line, '[.!?…:;。！？]'))
    OR regexp_matches(line, '{BOILERPLATE}')) AS n
  FROM counted GROUP BY rid
), base AS (
  SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS lost
  FROM w LEFT JOIN covered c USING (rid) LEFT JOIN lost l USING (rid)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost <= {_R.max_lost} * word_chars AS kept
FROM judged
"""
