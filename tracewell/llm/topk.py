"""Exact top-k search by inner product, block at a time.

1. Vectors of integers are put into an order in which neighbours are alike, and cut into parts of document
   ranges, and parts into blocks. A block is a forward index (the components of its vectors) with the largest
   and the smallest value of every component. A component with its sign is a term, so these are term maxima.
2. The sum of a query's components times the term maxima bounds its scores in a block. A query goes through the
   blocks of its own part in descending order of that bound and stops when it falls below its kth best score.
3. The kth best score of a query so far is where the other parts start. A part whose bound is below it is not
   visited by that query; the others are searched in the same way, each by a task that holds one part and a
   bounded number of queries. The best of all parts meet per query.

The order of the vectors and the size of blocks change the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import append_columns, materialize, read_table, share

LONG = np.iinfo(np.int64).max
_NONE = -LONG - 1  # the threshold of a query that has fewer than k scores
_NUMBERS = 1 << 22  # components that a part holds at most, if it has more than one vector

BUILT = "kind int, part long, no int, dims int, vec_id long, ids array<long>, numbers binary, high binary, low binary, least long, scores array<long>"
CELL = "part long, batch long, kind int, no int, dims int, ids array<long>, q array<long>, least array<long>, numbers binary, high binary, low binary"


def _packed(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes each that hold them all."""
    most = int(np.abs(x.astype(np.float64)).max(initial=0))
    return x.astype("<i1" if most < 127 else "<i2" if most < 32767 else "<i4" if most < 2**31 - 1 else "<i8").tobytes()


def _unpacked(b: bytes, count: int) -> np.ndarray:
    return np.frombuffer(b, f"<i{len(b) // count}").astype(np.int64) if count else np.zeros(0, np.int64)


def _matrix(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    values, starts = column.flatten().to_numpy(), column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, values[starts[at][:, None] + np.arange(n)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of `a` and `b` in exact integers, cut to 64 bits; the shorter rows count as filled with zeros."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * n
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LONG - 1, LONG).astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block the largest score that the block's term maxima allow."""
    n = min(queries.shape[1], high.shape[1])
    q = queries[:, :n].astype(np.float64)
    found = np.maximum(q, 0) @ high[:, :n].T.astype(np.float64) + np.minimum(q, 0) @ low[:, :n].T.astype(np.float64)
    sure = np.abs(q) @ np.maximum(np.abs(high[:, :n].astype(np.float64)), np.abs(low[:, :n].astype(np.float64))).T
    return np.where(sure < 2**53, found, found + sure * 1e-12)  # beyond, rounding must not lower a bound


class Best:
    """The k best (score, id) of each query; ties go to the smaller id, a null id last."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least, self.held = k, least.copy(), [np.zeros((4, 0), np.int64)]
        self.waiting = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.least[query]
        self.held.append(np.stack([query[good], score[good], ids[good], none[good].astype(np.int64)]))
        self.waiting += int(good.sum())
        if self.waiting > 2 * self.k * len(self.least):
            self.settle()

    def settle(self) -> np.ndarray:
        """Columns (query, score, id, id is null) of the k best of each query, in order."""
        x = np.concatenate(self.held, axis=1)
        x = x[:, np.lexsort((x[2], x[3], ~x[1], x[0]))]
        first = np.searchsorted(x[0], np.arange(len(self.least) + 1))
        rank = np.arange(x.shape[1]) - first[x[0]]
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = np.maximum(self.least[full], x[1, first[full] + self.k - 1])
        x = x[:, rank < self.k]
        self.held, self.waiting = [x], 0
        return x


def search(queries: np.ndarray, own: np.ndarray, least: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], high: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """The k best of the blocks' vectors for each query, as `Best.settle` returns them.

    A block is (matrix, ids, whether an id is null). `own` has the place, over all blocks, of the query's
    own vector, or -1. A query leaves when the bound of its next block is below its kth best score.
    """
    best = Best(least, k)
    bound = bounds(queries, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    start = np.concatenate(([0], np.cumsum([len(b[1]) for b in blocks])))
    active = np.arange(len(queries))
    for step in range(len(blocks)):
        block = order[active, step]
        stays = bound[active, block] >= best.least[active]
        active, block = active[stays], block[stays]
        if not len(active):
            break
        for b in np.unique(block):
            at = active[block == b]
            x, ids, none = blocks[b]
            score = products(queries[at], x)
            keep = score >= best.least[at][:, None]
            inside = (own[at] >= start[b]) & (own[at] < start[b + 1])
            keep[np.flatnonzero(inside), own[at][inside] - start[b]] = False
            r, c = np.nonzero(keep)
            best.add(at[r], score[r, c], ids[c], none[c])
        best.settle()
    return best.settle()


def _ranges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.max(0, initial=-LONG), x.min(0, initial=LONG)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _id_list(ids: np.ndarray, none: np.ndarray) -> list:
    return [None if n else i for i, n in zip(ids.tolist(), none.tolist(), strict=True)]


def _built(it: Iterator[pa.RecordBatch], every: int, k: int, block: int, part_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, x) in order: parts with their blocks, and the queries among them with the best of their own part."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("no", pa.int32()), ("dims", pa.int32()), ("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("numbers", pa.binary()), ("high", pa.binary()), ("low", pa.binary()), ("least", pa.int64()), ("scores", pa.list_(pa.int64()))])
    part = TaskContext.get().partitionId() << 32

    def made(pieces: list) -> pa.RecordBatch:
        nonlocal part
        x, ids, none = (np.concatenate(p) for p in zip(*pieces, strict=True))
        cuts = range(0, len(x), block)
        blocks = [(x[i : i + block], ids[i : i + block], none[i : i + block]) for i in cuts]
        high, low = (np.stack(v) for v in zip(*(_ranges(b[0]) for b in blocks), strict=True))
        dims = x.shape[1]
        rows = [(0, part, i, dims, None, _id_list(b[1], b[2]), _packed(b[0]), _packed(high[i]), _packed(low[i]), None, None) for i, b in enumerate(blocks)]
        rows.append((2, part, 0, dims, None, None, None, _packed(high.max(0)), _packed(low.min(0)), None, None))
        asks = np.flatnonzero((ids % every == 0) & ~none)
        for lo in range(0, len(asks), 1024):
            at = asks[lo : lo + 1024]
            found = search(x[at], at, np.full(len(at), _NONE), blocks, high, low, k)
            first = np.searchsorted(found[0], np.arange(len(at) + 1))
            for i, place in enumerate(at.tolist()):
                own = found[:, first[i] : first[i + 1]]
                least = int(own[1, -1]) if own.shape[1] == k else _NONE
                rows.append((1, part, place, dims, int(ids[place]), _id_list(own[2], own[3]), _packed(x[place]), None, None, least, own[1].tolist()))
        part += 1
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    held, rows, dims = [], 0, None
    for batch in it:
        ids, none = _ids(batch.column(0))
        for at, x in _matrix(batch.column(1)):  # in order of length, like the rows
            for lo in range(0, len(at), block):
                piece = x[lo : lo + block], ids[at[lo : lo + block]], none[at[lo : lo + block]]
                if held and (dims != x.shape[1] or rows + len(piece[0]) > part_rows or (rows + len(piece[0])) * dims > _NUMBERS):
                    yield made(held)
                    held, rows = [], 0
                held.append(piece)
                rows, dims = rows + len(piece[0]), x.shape[1]
    if held:
        yield made(held)


def _cells(it: Iterator[pa.RecordBatch], parts: list, at_once: int) -> Iterator[pa.RecordBatch]:
    """Query rows (part, no, dims, vec_id, numbers, least): a row for each part that queries of a batch have to visit."""
    task, seen = TaskContext.get().partitionId() << 32, 0
    by_dims: dict[int, tuple] = {}
    for d in {p[1] for p in parts}:
        same = [p for p in parts if p[1] == d]
        by_dims[d] = np.array([p[0] for p in same]), *(np.stack([_unpacked(p[i], d) for p in same]) for i in (2, 3))

    def made(rows: list) -> Iterator[pa.RecordBatch]:
        nonlocal seen
        batch, seen = task + seen, seen + 1
        own, no, dims, least = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 5))
        x = np.stack([_unpacked(r[4], dims[0]) for r in rows])
        for names, high, low in by_dims.values():
            bound = bounds(x, high, low)
            for lo in range(len(names)):
                at = np.flatnonzero((bound[:, lo] >= least) & (own != names[lo]))
                if len(at):
                    columns = [[int(names[lo])], [batch], [0], [0], [int(dims[0])], [own[at].tolist()], [no[at].tolist()], [least[at].tolist()], [_packed(x[at])], [None], [None]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CELL_TYPES, strict=True)], names=_CELL_NAMES)

    held: list = []
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (held[0][2] != row[2] or len(held) == at_once):
                yield from made(held)
                held = []
            held.append(row)
    if held:
        yield from made(held)


_CELL_NAMES = [c.split()[0] for c in CELL.split(", ")]
_CELL_TYPES = [{"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[c.split()[1]] for c in CELL.split(", ")]


def _visits(it: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of cells, each a batch of queries (kind 0) and then the blocks of one part (kind 1): (part, no, vec_id, score) of the best."""

    def made(queries: tuple, blocks: list) -> pa.RecordBatch:
        own, no, least, x = queries
        high, low = (np.stack([b[i] for b in blocks]) for i in (3, 4))
        found = search(x, np.full(len(x), -1), least, [b[:3] for b in blocks], high, low, k)
        ids = pa.array(found[2], mask=found[3].astype(bool))
        return pa.RecordBatch.from_arrays([pa.array(own[found[0]]), pa.array(no[found[0]], pa.int32()), ids, pa.array(found[1])], names=["part", "no", "vec_id", "score"])

    queries, blocks = None, []
    for batch in it:
        for i in range(batch.num_rows):
            kind, dims, ids, q, least, numbers, high, low = (batch.column(c)[i].as_py() for c in range(2, 11) if c != 3)
            if kind == 0:
                if queries:
                    yield made(queries, blocks)
                queries, blocks = (np.array(ids), np.array(q), np.array(least), _unpacked(numbers, len(ids) * dims).reshape(len(ids), dims)), []
            else:
                names = pa.array(ids, pa.int64())
                blocks.append((_unpacked(numbers, len(ids) * dims).reshape(len(ids), dims), *_ids(names), _unpacked(high, dims), _unpacked(low, dims)))
    if queries:
        yield made(queries, blocks)


def _centres(x: np.ndarray, most: int = 64, rounds: int = 6) -> np.ndarray:
    """Centres of groups of like vectors; they only order the vectors."""
    c = x[:: max(1, len(x) // most)][:most].astype(np.float64)
    for _ in range(rounds):
        near = (np.einsum("ij,ij->i", c, c) - 2 * x @ c.T).argmin(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def ordered(vectors: DataFrame, sample: int = 2048) -> DataFrame:
    """`vectors` (vec_id, x) with `near`, the number of the centre that is nearest; the centres come from at most `sample` vectors."""
    few = [r.x for r in vectors.where(F.size("x") > 0).orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(sample).select("x").collect()]
    dims = max((len(x) for x in few), default=1)
    wide = np.zeros((max(1, len(few)), dims))
    for i, x in enumerate(few):
        wide[i, : len(x)] = x
    sent = share(vectors.sparkSession, _centres(wide))

    def batches(it: Iterator[pa.RecordBatch]):
        c = sent()
        norms = np.einsum("ij,ij->i", c, c)
        for batch in it:
            near = np.zeros(batch.num_rows, np.int32)
            for at, x in _matrix(batch.column(1)):
                n = min(x.shape[1], c.shape[1])
                near[at] = (norms - 2 * x[:, :n].astype(np.float64) @ c[:, :n].T).argmin(1)
            yield batch, [pa.array(near)]

    return append_columns(vectors, [T.StructField("near", T.IntegerType())], batches)


def as_integers(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as a long; null for a vector that is null or holds null, NaN or infinite components.

    A product beyond 64 bits counts as the largest or smallest long.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(F.forall(vector, finite), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", block: int = 128, part_rows: int = 8192, queries_at_once: int = 1024, parts_at_once: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of the largest inner product with each query, exactly.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own.
    Ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite component take no
    part; of vectors of unequal length the shorter counts as filled with zeros, an empty one scores 0. A
    null id is never a query, as a candidate it is the last of a tie. A repeated row is a row of its own: it
    is a candidate for its copies, and a repeated query has its ranks once for each row. An empty table
    gives no rows; other columns are ignored.

    A task holds one part (`part_rows` vectors or some million components) and `queries_at_once` queries. The
    term maxima of parts go to executors in blocks of `parts_at_once`, some hundred bytes each.
    """
    spark = vectors.sparkSession
    ints = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), as_integers(F.col(vector)).alias("x")).where("x IS NOT NULL")
    n = ints.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = ordered(ints).withColumn("dims", F.size("x"))
    keys = [F.col("dims"), F.col("near"), F.xxhash64("x"), F.col("vec_id")]
    rows = rows.repartitionByRange(max(1, -(-n // part_rows)), *keys).sortWithinPartitions(*keys).select("vec_id", "x")
    built = materialize(rows.mapInArrow(lambda it: _built(it, every, k, block, part_rows), BUILT), "vector-parts")

    asks = built.where("kind = 1")
    parts = built.where("kind = 2").select("part", "dims", "high", "low")
    groups = max(1, -(-parts.count() // parts_at_once))
    cells = None
    for g in range(groups):  # one group unless there are very many parts
        some = [tuple(r) for r in parts.where(F.pmod(F.xxhash64("part"), F.lit(groups)) == g).collect()]
        sent = share(spark, some)
        found = asks.select("part", "no", "dims", "vec_id", "numbers", "least").mapInArrow(lambda it, sent=sent: _cells(it, sent(), queries_at_once), CELL)
        found = materialize(found, "cells")
        cells = found if cells is None else cells.unionByName(found)

    blocks = built.where("kind = 0").select("part", F.lit(1).alias("kind"), "no", "dims", "ids", *(F.lit(None).cast("array<long>").alias(c) for c in ("q", "least")), "numbers", "high", "low")
    wanted = blocks.join(cells.select("part", "batch"), "part").select(*_CELL_NAMES)
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(cells.count(), 20_000))
    dealt = cells.unionByName(wanted).repartition(many, "part", "batch").sortWithinPartitions("part", "batch", "kind", "no")
    visits = dealt.mapInArrow(lambda it: _visits(it, k), "part long, no int, vec_id long, score long")

    own = asks.select("part", "no", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("part", "no", F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))
    ranked = own.unionByName(visits).withColumn("rank", F.expr("row_number() OVER (PARTITION BY part, no ORDER BY score DESC, vec_id ASC NULLS LAST)")).where(F.col("rank") <= k)
    names = asks.select("part", "no", F.col("vec_id").alias("query_id"))
    return ranked.join(names, ["part", "no"]).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
