"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of words of the benchmark items; a symbol is a word. For each pattern length m
a shift table maps a block of B words to the distance that the window may move when the text shows
that block at the window's end; a block that no pattern holds moves it by m - B + 1 words. At
distance 0 the bucket of that suffix block, keyed once more by the window's first block, yields the
patterns to compare word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import append_columns, keep_rows, materialize, read_table, share

#: A-Z to lower case; ASCII characters other than letters and digits to a space; the rest as it is.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class _Length:
    """Shift table and buckets for the patterns of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]], block: int):
        m = len(patterns[0])
        self.m, self.block = m, min(block, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], tuple[tuple[bytes, ...], ...]] = {}  # by suffix block and first block
        b = self.block
        for p in patterns:
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            key = p[m - b :] + p[:b]
            self.buckets[key] = (*self.buckets.get(key, ()), p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of each occurrence."""
        m, b, shift, default = self.m, self.block, self.shift.get, self.default
        end, n = m, len(words)
        while end <= n:
            suffix = tuple(words[end - b : end])
            step = shift(suffix, default)
            if step:
                end += step
                continue
            start = end - m
            candidates = self.buckets.get(suffix + tuple(words[start : start + b]))
            if candidates:
                window = tuple(words[start:end])
                if window in candidates:
                    yield start, window
            end += 1


class PatternSet:
    """Windows of benchmark items, ready to search after `build`."""

    def __init__(self, items: Iterable[tuple[object, str | None]] = (), width: int = 10, block: int = 3):
        self.width, self.block = width, block
        self.owners: dict[tuple[bytes, ...], tuple | set] = {}
        self.lengths: list[_Length] = []
        for item, text in items:
            for window in self.windows(text):
                self.add(item, window)
        self.build()

    def windows(self, text: str | None) -> Iterator[tuple[bytes, ...]]:
        words = words_of(text)
        for i in range(max(1, len(words) - self.width + 1) if words else 0):
            yield tuple(words[i : i + self.width])

    def add(self, item: object, window: tuple[bytes, ...]) -> None:
        """A window of an item; None for an item without an id, whose windows are found but not named."""
        own = self.owners.setdefault(window, ())
        if item is not None and item not in own:
            if isinstance(own, set):
                own.add(item)
            else:  # few items share a window; many are held as a set
                self.owners[window] = (*own, item) if len(own) < 8 else {*own, item}

    def build(self) -> PatternSet:
        by: dict[int, list[tuple[bytes, ...]]] = {}
        for p in self.owners:
            by.setdefault(len(p), []).append(p)
        self.lengths = [_Length(ps, self.block) for ps in by.values()]
        return self

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [start, end) of document words inside occurrences, and the items found."""
        spans, items = [], set()
        for x in self.lengths:
            for start, window in x.find(words):
                spans.append((start, start + x.m))
                items.update(self.owners[window])
        return spans, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


_HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hits", _HITS), T.StructField("items", T.ArrayType(T.StringType()))]


def _pass(docs: DataFrame, patterns: PatternSet, text: str, later: bool) -> DataFrame:
    """One search over all rows; `later`: adds to what an earlier pass found."""
    shared = share(docs.sparkSession, patterns)
    at = docs.columns.index(text)
    old = [docs.columns.index(x) for x in ("hits", "items")] if later else None
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def batches(it: Iterator[pa.RecordBatch]):
        found = shared()
        for batch in it:
            n, hits, items = [], [], []
            for i, x in enumerate(batch.column(at)):
                words = words_of(x.as_py())
                spans, names = found.search(words)
                names = {str(k) for k in names}
                if old:
                    spans += [(s["start"], s["end"]) for s in batch.column(old[0])[i].as_py()]
                    names |= set(batch.column(old[1])[i].as_py())
                n.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in merge_spans(spans)])
                items.append(sorted(names))
            yield batch, [pa.array(n, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))]

    return append_columns(docs, _FIELDS, batches)


def pattern_blocks(benchmark: DataFrame, width: int = 10, item: str = "item_id", item_text: str = "text", block_windows: int = 150_000) -> Iterator[PatternSet]:
    """The windows of all items, in blocks of `block_windows` distinct ones at most; one empty block without items.

    The benchmark comes to the driver a partition at a time. A block takes some 900 bytes a window there
    and in each Python worker; an item with more windows than a block has goes on in the next.
    """
    made = PatternSet(width=width)
    for row in benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        for window in made.windows(row["t"]):
            if len(made.owners) >= block_windows and window not in made.owners:
                yield made.build()
                made = PatternSet(width=width)
            made.add(row["i"], window)
    yield made.build()


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 10, item: str = "item_id", item_text: str = "text", block_windows: int = 150_000) -> DataFrame:
    """`docs` with `n_words`, `hits` (merged spans of hit words) and `items` (ids, sorted as strings).

    The benchmark is the query set. Its windows reach the executors in blocks of at most `block_windows`,
    so a broadcast is bounded; each block is a pass over the rows, in place and without a shuffle. Between
    passes the rows are written to the shared folder, so that a worker holds one block at a time.

    Nulls: a null text, of a document or an item, has no words; windows of items with a null id are hit
    like any other but name no item. Repeated items count once, repeated rows each. An empty benchmark
    finds nothing, an empty table gives no rows. Columns of the same names give way.
    """
    out, later = docs, False
    for patterns in pattern_blocks(benchmark, width, item, item_text, block_windows):
        out, later = _pass(materialize(out, "decontamination") if later else out, patterns, text, later), True
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_windows: int = 150_000) -> DataFrame:
    """`docs` without the rows that hold a window of a benchmark item; all columns stay as they came, whatever their names.

    Blocks, nulls and repeats are as in `find_benchmark`: a null text holds nothing and stays, repeated
    rows stay or go together, texts of any length are searched whole. An empty benchmark drops nothing.
    """
    at, later = docs.columns.index(text), False
    for patterns in pattern_blocks(benchmark, block_windows=block_windows):
        docs, later = keep_rows(materialize(docs, "decontamination") if later else docs, _clean(share(docs.sparkSession, patterns), at)), True
    return docs


def _clean(sent, at: int):
    def start():
        found = sent()
        return lambda batch: [not found.search(words_of(x.as_py()))[0] for x in batch.column(at)]

    return start


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS m, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), g AS (
  SELECT rid, m, i, array_to_string(words[i : i + m - 1], ' ') AS gram
  FROM (SELECT rid, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(words) >= m)
), found AS (
  SELECT rid, i, p.m, item_id FROM g JOIN p ON g.m = p.m AND g.gram = p.gram
), hit AS (
  SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT rid, i, m FROM found)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
