"""SimHash near-duplicates by a self-join of a binary trie.

1. Every document gets a 64-bit fingerprint; equal fingerprints become one trie leaf.
2. Two fingerprints that differ in at most `max_bits` bits agree on one of `max_bits + 1` blocks of
   bits. Each block roots a forest of tries, one for each value of the block, and a task takes whole
   tries. A trie that is still large is split by the same rule inside the other bits, until none is.
3. In a trie, node pairs descend together: bit by bit their children are paired, the differing bits
   add up, and a pair over `max_bits` is cut off with all that stands below it. So is a pair whose
   leaves belong to one class already. A trie yields one edge from each leaf to its class, never
   all pairs.
4. The edges of all tries meet in connected components, found by alternating large-star and
   small-star steps over DataFrames, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tracewell.llm.common import append_columns, in_arrow, materialize, read_table

SEED = 42
_BLOCK = 1 << 14  # shingles hashed at a time


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    width = min(width, len(words))
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    for done in range(0, total, _BLOCK):
        n = min(_BLOCK, total - done)
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8", n) if n == total else np.fromiter((xxh64_intdigest(next(shingles), SEED) for _ in range(n)), "<u8", n)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(n, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """`docs` with `fp`, the fingerprint as a signed 64-bit integer; no shuffle. Null text: 0."""
    at = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]):
        for batch in it:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(at)), "<u8", batch.num_rows)
            yield batch, [pa.array(fps.view("<i8"))]

    return append_columns(docs, [T.StructField("fp", T.LongType())], batches)


# --- the trie join inside a task ---


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


class Classes:
    """Leaves in classes: a forest of parents, each class named by its first leaf."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.change = np.arange(n)  # how often neighbouring leaves differ in class, up to here
        self.stale = False

    @staticmethod
    def of(tree: np.ndarray, label: np.ndarray) -> Classes:
        """Leaves of one tree and label in one class."""
        made = Classes(len(tree))
        order = np.lexsort((np.arange(len(tree)), label, tree))
        first = np.ones(len(order), bool)
        first[1:] = (tree[order][1:] != tree[order][:-1]) | (label[order][1:] != label[order][:-1])
        made.parent[order] = order[first][np.cumsum(first) - 1]
        made.settle()
        return made

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Put leaves a[i] and b[i] into one class; the places i that joined two."""
        parent, made = self.parent, []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                made.append(i)
        self.stale |= bool(made)
        return made

    def settle(self) -> np.ndarray:
        self.parent[:] = _roots(self.parent)
        self.change[1:] = np.cumsum(self.parent[1:] != self.parent[:-1])
        self.stale = False
        return self.parent

    def one(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Which node pairs hold leaves of a single class."""
        if self.stale:
            self.settle()
        c = self.change
        return (c[alo] == c[ahi - 1]) & (c[blo] == c[bhi - 1]) & (self.parent[alo] == self.parent[blo])


def walk(tree: np.ndarray, fps: np.ndarray, max_bits: int, classes: Classes, near: Callable[[np.ndarray, np.ndarray], None], frontier: int = 1 << 17, every: bool = False) -> None:
    """Call `near` with the leaf pairs that differ in at most `max_bits` bits and are not in one class yet.

    `tree` and `fps` (unsigned) are sorted by (tree, fp); leaves of different trees are never paired.
    A node is an interval of leaves. Node pairs descend together and are cut off beyond the budget of
    differing bits or when all their leaves are of one class. They wait on a stack in blocks of at most
    `frontier`, so that memory stays bounded, and the pairs with the fewest differing bits go first, so
    that dense groups become one class early. Of equal fingerprints of a tree each is paired with the
    first one only, unless `every` pair is asked for.
    """
    edge = np.flatnonzero(np.diff(tree)) + 1
    lo, hi = np.concatenate(([0], edge)), np.concatenate((edge, [len(fps)]))
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))] if len(lo) else []
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        one = classes.one(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, err = (x[~one] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if len(alo) > frontier:
            order = np.argsort(-err, kind="stable")
            for part in np.array_split(order, -(-len(order) // frontier)):
                stack.append((depth, *(x[part] for x in (alo, ahi, blo, bhi, err))))
            continue
        # pairs of two leaves: what is left of their paths is compared at once
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            x, y = alo[leaf], blo[leaf]
            found = np.bitwise_count(fps[x] ^ fps[y]) <= max_bits
            found &= x != y
            near(x[found], y[found])
            alo, ahi, blo, bhi, err = (v[~leaf] for v in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
        if depth == 64:  # equal fingerprints
            for a0, a1, b0, b1 in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist(), strict=True):
                for x in range(a0, a1 if every else a0 + 1):
                    rest = np.arange(x + 1, a1) if a0 == b0 else np.arange(b0, b1 if every else b0 + 1)
                    near(np.full(len(rest), x), rest)
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1)))).astype(np.int32)
        c = ones[depth]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        cross = alo != blo
        more = err + 1
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, more),
            (amid[cross], ahi[cross], blo[cross], bmid[cross], more[cross]),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        good = (ahi > alo) & (bhi > blo) & (err <= max_bits) & ~((alo == blo) & (ahi - alo == 1))
        if good.any():
            stack.append((depth + 1, *(x[good] for x in (alo, ahi, blo, bhi, err))))


def trie_links(tree: np.ndarray, fps: np.ndarray, max_bits: int = 3, frontier: int = 1 << 17) -> np.ndarray:
    """For each leaf, sorted by (tree, fp) and without repeats, the position of its class's first leaf."""
    classes = Classes(len(fps))
    walk(tree, fps, max_bits, classes, classes.join, frontier)
    return classes.settle()


def whole_trees(it: Iterator[pa.RecordBatch], keys: int, at_once: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """The columns of complete trees, about `at_once` rows at a time; rows are sorted by their first `keys` columns, which name a tree.

    Batches are held in a list until one begins another tree, so a long tree is put together once.
    """
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in it:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not batch.num_rows:
            continue
        if rows >= at_once:
            same = np.ones(batch.num_rows, bool)
            for k in range(keys):
                same &= columns[k] == held[-1][k][-1]
            cut = batch.num_rows if same.all() else int(np.argmin(same))
            if cut < batch.num_rows:
                held.append([c[:cut] for c in columns])
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, rows, columns = [], 0, [c[cut:] for c in columns]
        held.append(columns)
        rows += len(columns[0])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _links(it: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, fp) sorted by both: complete trees are joined some at a time."""
    for a, f in whole_trees(it, 1):
        first = np.ones(len(f), bool)
        first[1:] = (a[1:] != a[:-1]) | (f[1:] != f[:-1])
        a, f = a[first], f[first].view("<u8")
        tree = np.concatenate(([0], np.cumsum(a[1:] != a[:-1])))
        order = np.lexsort((f, tree))  # unsigned order inside a tree
        f, tree = f[order], tree[order]
        root = trie_links(tree, f, max_bits)
        away = root != np.arange(len(root))
        yield pa.RecordBatch.from_arrays([pa.array(f[away].view("<i8")), pa.array(f[root[away]].view("<i8"))], names=["u", "v"])


def _split(it: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, used, fp) of large trees: `parts` rows each, for the trees inside the tree in which the bits that are
    not `used` are cut into as many blocks, one of which agrees. A name is a digest of the names and values on the way."""
    for batch in it:
        tree, used, fp = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
        for mask in np.unique(used):
            at = used == mask
            free = [b for b in range(63, -1, -1) if not int(mask) >> b & 1]
            for s, bits in enumerate(np.array_split(np.array(free, np.uint64), parts)):
                block = np.bitwise_or.reduce(np.uint64(1) << bits)
                value = np.stack([tree[at], np.full(at.sum(), s, np.uint64), fp[at] & block], 1)
                names = np.fromiter((xxh64_intdigest(v.tobytes(), SEED) for v in value), np.uint64, len(value))
                columns = [names, np.full(len(names), mask | block), fp[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["tree", "used", "fp"])


def planted(fps: DataFrame, max_bits: int, large: int, least_free: int = 8) -> DataFrame:
    """(tree, fp): the trees that each fingerprint is a leaf of, such that two within `max_bits` share one.

    A tree of more than `large` leaves is replaced by the trees inside it, again and again; with `least_free`
    bits left it cannot be large.
    """
    k = max_bits + 1
    names = T.StructType([T.StructField(c, T.LongType()) for c in ("tree", "used", "fp")])
    level, free, done = fps.select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("used"), "fp"), 64, None
    while True:
        level = in_arrow(level, lambda it: _split(it, k), names)
        free -= free // k
        hot = level.groupBy("tree").count().where(F.col("count") > large).select("tree") if free > least_free else None
        hot = materialize(hot, "hot-trees") if hot is not None else None
        if hot is None or hot.isEmpty():
            return level.select("tree", "fp") if done is None else done.unionByName(level.select("tree", "fp"))
        cold = level.join(hot, "tree", "left_anti").select("tree", "fp")
        done = cold if done is None else done.unionByName(cold)
        level = materialize(level.join(hot, "tree", "left_semi"), "hot-leaves")


def fingerprint_links(fps: DataFrame, max_bits: int = 3, large: int = 50_000) -> DataFrame:
    """Edges (u, v) between fingerprints that connect exactly those within `max_bits` of each other. `fps` has one row per fingerprint."""
    dealt = planted(fps.select("fp"), max_bits, large).repartition("tree").sortWithinPartitions("tree", "fp")
    return in_arrow(dealt, lambda it: _links(it, max_bits), "u long, v long")


# --- connected components over all tries ---


def _united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node of the edges, root the smallest node that the edges connect it with."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, parent = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        top, other = parent[a], parent[b]
        low = np.minimum(top, other)
        np.minimum.at(parent, top, low)
        np.minimum.at(parent, other, low)
        parent = _roots(parent)
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[parent]


def _contracted(it: Iterator[pa.RecordBatch], at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Edges as stars (node, root) with the same components, each `at_once` edges by themselves; no row for a root."""

    def made(held: list) -> pa.RecordBatch:
        node, root = _united(*(np.concatenate(x) for x in zip(*held, strict=True)))
        away = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(root[away])], names=["node", "root"])

    held, n = [], 0
    for batch in it:
        held.append([batch.column(i).to_numpy() for i in (0, 1)])
        n += batch.num_rows
        if n >= at_once:
            yield made(held)
            held, n = [], 0
    if held:
        yield made(held)


def connected_components(edges: DataFrame, label: str = "components", most_rounds: int = 60, small: int = 1 << 18) -> DataFrame:
    """(node, root) for each node of an edge but the smallest of its component, which is the root.

    Every task first replaces its edges by stars with the same components. Up to `small` rows of these, some
    megabytes, are put together in one task in the same way. More of them alternate large-star and small-star
    steps until they no longer change; each step is an aggregation to one minimum per node and a join, so no
    neighbourhood is gathered. A node with very many edges is a skewed join key, which adaptive execution splits.
    """
    edges = edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = materialize(in_arrow(edges, _contracted, "node long, root long"), label).toDF("u", "v")
    if edges.count() <= small:
        return materialize(in_arrow(edges.coalesce(1), lambda it: _contracted(it, small + 1), "node long, root long"), label)
    edges = materialize(edges.where("u <> v").distinct(), label)
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small_star.select("e.u", "e.v").where("u <> v").distinct(), label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id of its component.

    Nulls: a null text has the fingerprint 0 and is linked like any other; a null doc_id never is a
    component_id unless its component has no other. Repeated rows come out as often as they went in.
    An empty table gives no rows; columns other than the two are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(with_fingerprint(rows, "text", width).drop("text"), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "leaves")
    roots = connected_components(fingerprint_links(fps, max_bits)).withColumnRenamed("node", "fp")
    linked = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = linked.join(lowest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
