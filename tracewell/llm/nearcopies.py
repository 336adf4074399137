"""Near copies by the trie self-join: texts whose sets of five-word shingles have a similarity of 0.8 or more.

At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in ten bits on average and in twenty
at the far end. Blocks of bits that have to agree are too short then to root tries that stay small, so
here other values root them:

1. A text's shingles are hashed; equal sets are one node, with a SimHash fingerprint of the set. The
   smallest values of 144 permutations of the set, six to a band, name 24 trees that the node is a leaf
   of. Two sets of similarity s share no tree with probability (1 - s^6)^24: 0.07 % at 0.8, 0.001 % at 0.85.
2. In each tree, node pairs descend together as in `simhash`, with a budget of 20 bits that is opened in
   steps, so that the closest leaves are joined first. A tree yields a forest over its leaves.
3. What the forests of all trees connect is a family. The sets of a family meet in one task, or in several
   for each two parts of a large one, and all pairs within the budget are compared there by the sets
   themselves, but for those that links connect already. Only links leave a task, at most one for each leaf
   that comes in, so no table of pairs grows with the square of a family's size.
4. Links meet in connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tracewell.llm.common import append_columns, in_arrow, materialize, unused
from tracewell.llm.simhash import SEED, Classes, connected_components, walk, whole_trees

WIDTH, SIMILARITY, TREES, PER_TREE = 5, 0.8, 24, 6
BUDGETS = (1, 3, 6, 10, 14, 20)  # bits of 64; at a similarity of 0.8 all but 0.03 % of the pairs differ in 20 or fewer
#: Leaves, and bytes of their sets, in a part of a family: a task holds two parts at a time.
PART_LEAVES, PART_BYTES = 4096, 8 << 20
_PAIRS = 4096  # pairs that a task compares before it looks again at what is linked
_RNG = np.random.default_rng(SEED)
_TIMES = (_RNG.integers(0, 1 << 31, TREES * PER_TREE).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_PLUS = _RNG.integers(0, 1 << 32, TREES * PER_TREE, np.uint64).astype(np.uint32)[:, None]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MOST_WORDS = 100_000  # hashes of words that a task keeps at hand
_ROWS = 512  # rows whose sets a task holds at a time


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lo in range(0, batch.num_rows, _ROWS):
            yield batch.slice(lo, _ROWS)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, one without words none.

    A shingle's hash mixes a polynomial in the hashes of its words. `known` keeps the words' hashes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    width = min(width, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    for w in set(words):
        if w not in known:
            known[w] = xxh64_intdigest(w, SEED)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > _MOST_WORDS:
        known.clear()
    n = len(words) - width + 1
    total = h[:n].copy()
    for k in range(1, width):
        total = total * _BASE + h[k : n + k]
    return np.unique(_mixed(total + np.uint64(width)))


def fingerprint_of(hashes: np.ndarray, block: int = 1 << 14) -> int:
    """The 64-bit SimHash of a set of hashes, as a signed integer: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def lowest(hashes: np.ndarray, block: int = 1024) -> np.ndarray:
    """The smallest value of each permutation of a set."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(TREES * PER_TREE, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), block):
        x = short[i : i + block] * _TIMES
        x += _PLUS
        np.minimum(low, x.min(1), out=low)
    return low


def trees_of(hashes: np.ndarray) -> list[int]:
    """The trees of a set; none for a set of up to 3, which no other set is similar enough to."""
    if len(hashes) < 4:
        return []
    low = lowest(hashes)
    keys = [xxh64_intdigest(low[b * PER_TREE : (b + 1) * PER_TREE].tobytes(), b) for b in range(TREES)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `node` (a digest of the set of shingles), `fp` and `trees`; no shuffle."""
    at = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]):
        known: dict[bytes, int] = {}
        for batch in _slices(it):
            sets = [shingles(x.as_py(), known=known) for x in batch.column(at)]
            yield batch, [pa.array([f(s) for s in sets], t) for f, t in ((_node, pa.int64()), (fingerprint_of, pa.int64()), (trees_of, pa.list_(pa.int64())))]

    return append_columns(docs, [T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("trees", T.ArrayType(T.LongType()))], batches)


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in _slices(it):
        sets = [shingles(x.as_py(), known=known) for x in batch.column(0)]
        columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "hashes"])


# --- candidate pairs from tries ---


def _ordered(tree: np.ndarray, fp: np.ndarray, node: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Leaves in the order that `walk` needs, one for each node of a tree: place of the tree, unsigned fp, tree, node, ..."""
    at = np.concatenate(([0], np.cumsum(tree[1:] != tree[:-1])))
    order = np.lexsort((node, fp.view("<u8"), at))
    first = np.ones(len(order), bool)
    first[1:] = (at[order][1:] != at[order][:-1]) | (node[order][1:] != node[order][:-1])
    order = order[first]
    return [at[order], fp[order].view("<u8"), tree[order], node[order], *(m[order] for m in more)]


def _forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, fp, node) in order of trees: the pairs (u, v) of each tree's forest over the leaves that the budget joins."""
    for tree, fp, node in whole_trees(it, 1, 1 << 16):
        same = tree[1:] == tree[:-1]
        several = np.append(same, False) | np.insert(same, 0, False)  # most trees have one leaf
        if not several.any():
            continue
        at, f, tree, node = _ordered(tree[several], fp[several], node[several])
        classes, pairs = Classes(len(f)), []

        def near(x: np.ndarray, y: np.ndarray, classes=classes, pairs=pairs) -> None:
            made = classes.join(x, y)
            pairs.append((x[made], y[made]))

        for bits in BUDGETS:
            walk(at, f, bits, classes, near)
        if not pairs:
            continue
        x, y = (node[np.concatenate(p)] for p in zip(*pairs, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])


def _planted(nodes: DataFrame, large: int) -> DataFrame:
    """(tree, fp, node) for each leaf. A tree of more than `large` leaves is split by the other trees of its leaves,
    one of which similar sets share as surely as the first."""
    leaves = nodes.select(F.explode("trees").alias("tree"), "fp", "node")
    hot = leaves.groupBy("tree").count().where(F.col("count") > large).select("tree")
    hot = materialize(hot, "hot-trees")
    if hot.isEmpty():
        return leaves
    cold = leaves.join(hot, "tree", "left_anti").select("tree", "fp", "node")
    again = leaves.join(hot, "tree", "left_semi").select("tree", "node").join(nodes, "node")
    split = again.select("tree", "fp", "node", F.explode("trees").alias("own")).where("own <> tree")
    return cold.unionByName(split.select(F.xxhash64("tree", "own").alias("tree"), "fp", "node"))


# --- comparison of sets ---


class _Sets:
    """The sets of leaves as numbers from 0, one after the other."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        self.start = np.cumsum(self.size) - self.size
        values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of leaves have similar sets."""
        both = np.zeros(len(x), np.int64)
        order = np.argsort(x, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
            own = self.ids[self.start[x[at[0]]] :][: self.size[x[at[0]]]]
            self.mark[own] = True
            size = self.size[y[at]]
            first = np.cumsum(size) - size
            places = np.arange(size.sum()) + np.repeat(self.start[y[at]] - first, size)
            both[at] = np.add.reduceat(self.mark[self.ids[places]], first, dtype=np.int64)
            self.mark[own] = False
        return both * 5 >= 4 * (self.size[x] + self.size[y] - both)


def _linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, node, part, hashes) in order of cells: links (u, v) that connect what all similar pairs within the budget connect.

    A cell has one part of a family, all of whose pairs are compared, or two parts, of which those across are.
    """
    for cell, fp, node, part, hashes in whole_trees(it, 1, 1):
        at, f, cell, node, part, hashes = _ordered(cell, fp, node, part, hashes)
        sets, classes = _Sets([np.frombuffer(h, np.uint64) for h in hashes]), Classes(len(f))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        two = (np.maximum.reduceat(part, first) != np.minimum.reduceat(part, first))[at]
        links: list[tuple[np.ndarray, np.ndarray]] = []

        def near(x: np.ndarray, y: np.ndarray, sets=sets, classes=classes, part=part, two=two, links=links) -> None:
            low, high = np.minimum(sets.size[x], sets.size[y]), np.maximum(sets.size[x], sets.size[y])
            tried = (5 * low >= 4 * high) & (~two[x] | (part[x] != part[y]))
            x, y = x[tried], y[tried]
            for lo in range(0, len(x), _PAIRS):
                root = classes.settle() if classes.stale else classes.parent
                a, b = x[lo : lo + _PAIRS], y[lo : lo + _PAIRS]
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
                if len(a):
                    good = sets.similar(a, b)
                    a, b = a[good], b[good]
                    made = classes.join(a, b)
                    links.append((a[made], b[made]))

        walk(at, f, BUDGETS[-1], classes, near, every=True)
        if links:
            x, y = (node[np.concatenate(p)] for p in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["u", "v"])


def _cells(leaves: DataFrame, leaves_of: int, bytes_of: int) -> DataFrame:
    """(cell, fp, node, part, hashes) from (family, fp, node, hashes): a family of several parts comes out once for each two of them."""
    parts = F.greatest(F.ceil(F.count("*") / leaves_of), F.ceil(F.sum(F.octet_length("hashes")) / bytes_of)).cast("int")
    sizes = leaves.groupBy("family").agg(parts.alias("parts"))
    dealt = leaves.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select(F.xxhash64("family", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "fp", "node", "part", "hashes")


def _classes(nodes: DataFrame, sets_of, large: int, leaves_of: int = PART_LEAVES, bytes_of: int = PART_BYTES) -> DataFrame:
    """(node, root): the components of all similar pairs of nodes (node, fp, trees); a node without a link may be left out."""
    dealt = _planted(nodes, large).repartition("tree").sortWithinPartitions("tree")
    pairs = materialize(in_arrow(dealt.select("tree", "fp", "node"), _forest, "u long, v long").distinct(), "pairs")
    found = connected_components(pairs, "families")
    members = found.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node")).unionByName(found.select("node", "root"))
    members = materialize(members.withColumnRenamed("root", "family").join(nodes.select("node", "fp"), "node"), "members")
    leaves = members.join(sets_of(members.select("node")).select("node", "hashes"), "node")
    cells = _cells(leaves, leaves_of, bytes_of).repartition("cell").sortWithinPartitions("cell")
    return connected_components(in_arrow(cells, _linked, "u long, v long"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", large: int = 50_000) -> DataFrame:
    """(doc_id, th, root) for each row: rows of one root are near copies of each other, over any number of steps.

    `th` is a checksum of the text. A null text is like an empty one, and one without words like any
    other of that kind; texts of fewer than eight words are near copies of those with the same words
    only. Ids may be null or repeated; repeated rows come out as often as they went in. An empty table
    gives no rows; columns other than the two are ignored.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    rows = materialize(_nodes(docs).drop("text"), "shingled")
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("trees").alias("trees"), F.min("th").alias("th")).where(F.size("trees") > 0)
    nodes = materialize(nodes, "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        marks = nodes.join(wanted, "node", "left_semi").select("th")
        texts = docs.select("text", "th").dropDuplicates(["th"]).join(marks, "th", "left_semi").select("text")
        return materialize(in_arrow(texts, _sets, "node long, hashes binary"), "sets").dropDuplicates(["node"])

    roots = _classes(nodes.drop("th"), sets_of, large)
    return rows.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of near copies: the smallest id, and of those the smallest checksum of the text.

    The row is chosen by group, id and text, so that a repeated id loses no text that differs: a group
    keeps one of its own rows whatever the ids are. A null id is the last choice; a null text is like
    an empty one. Of rows equal in id and text one stays. Columns keep their names, whatever they are;
    an empty table gives no rows.
    """
    names = [unused(docs, n) for n in ("__id", "__none", "__th")]
    of = lambda i, t: (F.coalesce(i.cast("string"), F.lit("")), i.isNull(), t)
    near = near_copies(docs, doc_id, text)
    best = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k")).select("k.doc_id", "k.th")
    kept = best.select(*(c.alias(n) for c, n in zip(of(F.col("doc_id"), F.col("th")), names, strict=True)))
    marked = docs.select("*", *(c.alias(n) for c, n in zip(of(F.col(doc_id), F.xxhash64(text)), names, strict=True)))
    return marked.join(kept, names, "left_semi").dropDuplicates(names).drop(*names)
