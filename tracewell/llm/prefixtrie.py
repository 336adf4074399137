"""The trie of conversation prefixes, without a walk from node to node.

1. A prefix has a digest: the exclusive or of the digests of its (place, turn) pairs. It is associative, so
   prefixes come from running values inside units of at most `unit` turns and over the units.
2. The conversations that begin with a prefix are those with its digest; the smallest of them owns the node.
   A longer prefix has fewer members, so what a conversation owns is one chain from some depth to its end.
   That first owned depth is found by binary search: each round looks up one depth of every unit that is not
   decided, all in one join with the minima of the digests that several conversations share.
3. A chain hangs on the node before its head, so owned chains form a tree of chains. Sums over subtrees go up
   that tree: first per chain, adding to each chain the sums of the chains 1, 2, 4, ... levels below; then along
   a chain from its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewell.llm.common import materialize, numbered, read_table

GROUP, MOST_SHARED = 5, 8


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, depth, th, bytes) for each turn of the rebuilt conversations, and (c, n) for each of them, even without turns.

    A conversation begins with the first h turns of the one whose id is its own less the remainder by 5,
    h being its crc32 modulo 9, and goes on with its own turns after the first h. `th` is a digest of role
    and text. Turns of one number are in order of that digest.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    th = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", th.alias("th"), F.octet_length(text).cast("long").alias("bytes"))
    turns = materialize(numbered(turns, ["c"], "turn", ["th"], "pos").select("c", "pos", "th", "bytes"), "turns")
    sizes = turns.groupBy("c").agg(F.count("*").alias("own"))
    convs = sizes.select("c", "own", (F.col("c") - F.col("c") % GROUP).alias("b"), (F.crc32(F.col("c").cast("string")) % (MOST_SHARED + 1)).alias("h"))
    bases = sizes.where(F.col("c") % GROUP == 0).select(F.col("c").alias("b"), F.col("own").alias("there"))
    convs = convs.join(bases, "b", "left").withColumn("shared", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("c", "b", "h", "shared", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    base = turns.where((F.col("c") % GROUP == 0) & (F.col("pos") <= MOST_SHARED)).select(F.col("c").alias("b"), F.col("pos").alias("depth"), "th", "bytes")
    first = convs.where("shared > 0").select("c", "b", "shared").join(base, "b").where("depth <= shared").select("c", "depth", "th", "bytes")
    after = turns.join(convs.select("c", "h", "shared"), "c").where("pos > h").select("c", (F.col("shared") + F.col("pos") - F.col("h")).alias("depth"), "th", "bytes")
    return first.unionByName(after), convs.select("c", "n")


def _units(turns: DataFrame, convs: DataFrame, unit: int) -> DataFrame:
    """(c, u, n, at, bytes): `at` has the digests of the prefixes of depth u * unit to the unit's end, `bytes` those of the turns between."""
    turns = turns.select("c", F.floor((F.col("depth") - 1) / unit).alias("u"), "depth", "bytes", F.xxhash64("depth", "th").alias("x"), F.xxhash64(F.lit("second"), "th", "depth").alias("y"))
    along = W.partitionBy("c", "u").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    steps = turns.select("c", "u", "depth", "bytes", *(F.expr(f"bit_xor({k})").over(along).alias(k) for k in "xy"))
    rows = steps.groupBy("c", "u").agg(F.array_sort(F.collect_list(F.struct("depth", "x", "y", "bytes"))).alias("e"))
    before = W.partitionBy("c").orderBy("u").rowsBetween(W.unboundedPreceding, -1)
    totals = turns.groupBy("c", "u").agg(*(F.expr(f"bit_xor({k})").alias(k) for k in "xy"))
    totals = totals.select("c", "u", *(F.coalesce(F.expr(f"bit_xor({k})").over(before), F.lit(0).cast("long")).alias(f"{k}0") for k in "xy"))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    at = F.concat(F.array(pair(F.col("x0"), F.col("y0"))), F.transform("e", lambda e: pair(e.x.bitwiseXOR(F.col("x0")), e.y.bitwiseXOR(F.col("y0")))))
    filled = rows.join(totals, ["c", "u"]).join(convs, "c").select("c", "u", "n", at.alias("at"), F.transform("e", lambda e: e.bytes).alias("bytes"))
    none = F.lit(0).cast("long")
    empty = convs.where("n = 0").select("c", none.alias("u"), "n", F.array(pair(none, none)).alias("at"), F.array().cast("array<long>").alias("bytes"))
    return materialize(filled.unionByName(empty), "units")


def _searched(units: DataFrame, shared: DataFrame, least: int, unit: int) -> DataFrame:
    """`units` with `f`, the first place in `at` that the conversation owns (its size: none), and `m`, the owner of the place before."""
    size, first = F.size("at"), F.col("u") == 0
    root = first & (F.col("c") == least)  # the smallest id owns the root and all of its own prefixes
    state = units.select("*", F.when(first & ~root, 1).otherwise(0).alias("lo"), F.when(root, 0).otherwise(size).alias("hi"), F.when(first & ~root, F.lit(least)).cast("long").alias("m"))
    done, rounds = state.where("lo >= hi"), (unit + 1).bit_length()
    active = state.where("lo < hi")
    for _ in range(rounds):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        asked = active.withColumn("mid", mid).withColumn("depth", F.col("u") * unit + F.col("mid")).withColumn("x", F.expr("at[mid].x")).withColumn("y", F.expr("at[mid].y"))
        found = asked.join(shared.select("depth", "x", "y", "owner"), ["depth", "x", "y"], "left")
        owned = F.coalesce(F.col("owner") == F.col("c"), F.lit(True))
        lo, hi, m = F.when(owned, F.col("lo")).otherwise(F.col("mid") + 1), F.when(owned, F.col("mid")).otherwise(F.col("hi")), F.when(owned, F.col("m")).otherwise(F.col("owner"))
        state = materialize(found.select("c", "u", "n", "at", "bytes", lo.alias("lo"), hi.alias("hi"), m.alias("m")), "search")
        done, active = done.unionByName(state.where("lo >= hi")), state.where("lo < hi")
        if active.isEmpty():
            return done.select("c", "u", "n", "at", "bytes", F.col("lo").alias("f"), "m")
    raise RuntimeError("the search did not end")


def _runs(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (owner, depth, c) in order: a digest for each group that begins and ends here, the text of the others in pieces."""
    names = ["owner", "depth", "first", "piece", "sha"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    key, ids, opening = None, [], True  # the group at hand; whether it may have begun in an earlier partition
    for batch in it:
        owner, depth, c = (batch.column(i).to_numpy() for i in range(3))
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1
        out = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(c)], strict=True):
            if lo == hi:
                continue
            here = int(owner[lo]), int(depth[lo])
            if key is not None and here != key:
                text = ",".join(map(str, ids))
                out.append((*key, ids[0], text, None) if opening else (*key, None, None, hashlib.sha256(text.encode()).hexdigest()))
                ids, opening = [], False
            key = here
            ids += c[lo:hi].tolist()
            while len(ids) > most:  # a long group goes on in pieces
                out.append((*key, ids[0], ",".join(map(str, ids[:most])), None))
                ids, opening = ids[most:], True
        if out:
            yield made(out)
    if ids:
        yield made([(*key, ids[0], ",".join(map(str, ids)), None)])


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (owner, depth, first, piece) in order: the digest of each group's pieces, joined by commas."""
    key, state = None, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["owner", "depth", "sha"])

    for batch in it:
        out = []
        for owner, depth, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if key != (owner, depth):
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (owner, depth), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield made(out)
    if key is not None:
        yield made([(*key, state.hexdigest())])


def end_digests(ends: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """(owner, depth, sha) from (owner, depth, c): the SHA-256 of the ids c in ascending order, joined by commas.

    Rows are dealt by range, so a hot node's ids are sorted and put into text by many tasks; only the hash
    itself, which has to be sequential, reads a node's text in one task, piece by piece.
    """
    dealt = ends.select("owner", "depth", "c").repartitionByRange("owner", "depth", "c").sortWithinPartitions("owner", "depth", "c")
    runs = materialize(dealt.mapInArrow(lambda it: _runs(it, piece), "owner long, depth long, first long, piece string, sha string"), "ends")
    pieces = runs.where("sha IS NULL").drop("sha").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first")
    return runs.where("sha IS NOT NULL").select("owner", "depth", "sha").unionByName(pieces.mapInArrow(_hashed, "owner long, depth long, sha string"))


def _chain_sums(chains: DataFrame, most_rounds: int = 62) -> DataFrame:
    """(c, leaves, saved): the sums over each chain and all chains below it. `chains` is (c, parent, leaves, saved).

    After round k a chain has the sums of what is fewer than 2^k levels below, and `jump` is the chain 2^k levels above.
    """
    state = materialize(chains.withColumnRenamed("parent", "jump"), "chains")
    for _ in range(most_rounds):
        going = state.where("jump IS NOT NULL")
        if going.isEmpty():
            return state.drop("jump")
        below = going.groupBy(F.col("jump").alias("c")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = going.select("c", "jump").join(state.where("jump IS NOT NULL").select(F.col("c").alias("jump"), F.col("jump").alias("next")), "jump").select("c", "next")
        added = state.join(below, "c", "left").join(above, "c", "left")
        state = materialize(added.select("c", F.col("next").alias("jump"), *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s")))), "chains")
    raise RuntimeError("the tree of chains is too deep")


def prefix_trie(conversations: DataFrame, unit: int = 256) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see `rebuilt`), one row each.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest
    member; the number of turns; the smallest member of the parent, null for the root; members; children;
    childless nodes of the subtree; the bytes that members after the first repeat, over the subtree; the
    digest of the members that end here.

    Null roles and texts are empty; a null turn comes first; turns of one number are in order of a digest of
    role and text, a repeated row is two turns; rows without a conv_id belong to no conversation. A
    conversation whose rebuilt form has no turns ends at the root. An empty table has no nodes, not even a
    root. Other columns are ignored.
    """
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    least = convs.agg(F.min("c")).first()[0]
    if least is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    units = _units(turns, convs, unit)
    places = units.select("c", "u", F.posexplode("at").alias("i", "p")).where("i > 0 OR u = 0")
    minima = places.groupBy((F.col("u") * unit + F.col("i")).alias("depth"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.min("c").alias("owner"), F.count("*").alias("convs"))
    shared = materialize(minima.where("convs > 1"), "minima")
    found = materialize(_searched(units, shared, least, unit).withColumn("len", F.size("bytes")), "owned")

    depth = lambda i: (F.col("u") * unit + i).cast("long")
    ends = found.where(depth(F.col("len")) == F.col("n")).select(F.when(F.col("f") <= F.col("len"), F.col("c")).otherwise(F.col("m")).alias("owner"), F.col("n").alias("depth"), "c")
    heads = found.where("f <= len AND (f > 0 OR u = 0)").select("c", "n", F.col("m").alias("parent"), depth(F.col("f")).alias("head"))
    hung = heads.where("parent IS NOT NULL").select("c", "parent", (F.col("head") - 1).alias("depth"))
    taken = hung.select(F.col("parent").alias("c"), F.col("depth").alias("n")).distinct().withColumn("inner", F.lit(True))
    tails = heads.join(taken, ["c", "n"], "left").select("c", "n", F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("leaf"))

    own = found.where("f <= len").select("c", "u", "n", F.explode(F.expr("transform(sequence(IF(u > 0, greatest(f, 1), f), len), i -> struct(i, IF(i > 0, bytes[i - 1], 0L) AS b))")).alias("e"))
    own = own.select("c", "u", "n", depth(F.col("e.i")).alias("depth"), F.col("e.b").alias("b"))
    own = own.join(shared.select(F.col("owner").alias("c"), "depth", "convs"), ["c", "depth"], "left").withColumn("convs", F.coalesce("convs", F.lit(1).cast("long")))
    own = materialize(own.select("c", "u", "n", "depth", "convs", ((F.col("convs") - 1) * F.col("b")).alias("saved")), "nodes")

    chains = own.groupBy("c").agg(F.sum("saved").alias("saved")).join(tails, "c").join(heads.select("c", "parent"), "c").select("c", "parent", F.col("leaf").alias("leaves"), "saved")
    sums = _chain_sums(chains)
    below = hung.join(sums, "c").groupBy(F.col("parent").alias("c"), "depth").agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))

    zero = lambda c: F.coalesce(c, F.lit(0))
    nodes = own.join(below, ["c", "depth"], "left").join(tails.select("c", "leaf"), "c")
    nodes = nodes.select("c", "u", "n", "depth", "convs", zero("kids").alias("kids"), (zero("leaves") + F.when(F.col("depth") == F.col("n"), F.col("leaf")).otherwise(0)).alias("leaves"), (F.col("saved") + zero("more")).alias("saved"))
    nodes = materialize(nodes, "nodes")
    after = W.partitionBy("c").orderBy(F.desc("u")).rowsBetween(W.unboundedPreceding, -1)
    later = nodes.groupBy("c", "u").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).select("c", "u", zero(F.sum("l").over(after)).alias("l"), zero(F.sum("s").over(after)).alias("s"))
    upward = W.partitionBy("c", "u").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    nodes = nodes.select("c", "u", "n", "depth", "convs", "kids", F.sum("leaves").over(upward).alias("leaves"), F.sum("saved").over(upward).alias("saved")).join(later, ["c", "u"])

    digests = end_digests(ends).select(F.col("owner").alias("c"), "depth", "sha")
    nodes = nodes.join(digests, ["c", "depth"], "left").join(heads.select("c", F.col("head").alias("depth"), F.coalesce("parent", F.lit(-1)).alias("up"), F.col("parent").alias("p")), ["c", "depth"], "left")
    return nodes.select(
        F.col("c").alias("conv_id"),
        "depth",
        F.when(F.col("up").isNull(), F.col("c")).otherwise(F.col("p")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        (F.col("kids") + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"),
        (F.col("leaves") + F.col("l")).alias("n_leaves"),
        (F.col("saved") + F.col("s")).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


#: crc32 of a decimal string, bit by bit.
_CRC = "xor(list_reduce([unicode(x)::BIGINT for x in string_split({0}::VARCHAR, '')], lambda a, b: list_reduce([0,1,2,3,4,5,6,7], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"

OP12_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT c, c - c % 5 AS b, {_CRC.format("c")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT convs.c, 0 AS part, t.pos, role, text FROM convs JOIN t ON t.c = convs.b AND pos <= h
  UNION ALL SELECT t.c, 1, t.pos, role, text FROM convs JOIN t ON t.c = convs.c AND pos > h
), d AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM r),
p AS (
  SELECT c, depth, octet_length(encode(text)) AS bytes, list(struct_pack(r := role, t := text)) OVER (PARTITION BY c ORDER BY depth) AS k FROM d
  UNION ALL SELECT c, 0, 0, [] FROM convs
), own AS (SELECT k, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY k),
last AS (SELECT c, max(depth) AS n FROM p GROUP BY c),
up AS (SELECT p.c, p.depth, own.conv_id FROM p JOIN own USING (k)),
kids AS (SELECT up.conv_id, up.depth, count(*) AS n_children FROM own JOIN up ON up.c = own.conv_id AND up.depth = own.depth - 1 GROUP BY ALL),
leaf AS (SELECT own.conv_id, own.depth, (own.n_convs - 1) * own.bytes AS saved, (n_children IS NULL)::BIGINT AS leaf FROM own LEFT JOIN kids ON kids.conv_id = own.conv_id AND kids.depth = own.depth),
sums AS (SELECT up.conv_id, up.depth, sum(leaf) AS leaves, sum(saved) AS saved FROM leaf JOIN up ON up.c = leaf.conv_id AND up.depth <= leaf.depth GROUP BY ALL),
ends AS (SELECT up.conv_id, up.depth, string_agg(up.c::VARCHAR, ',' ORDER BY up.c) AS ids FROM last JOIN up ON up.c = last.c AND up.depth = last.n GROUP BY ALL)
SELECT own.conv_id, own.depth::BIGINT AS depth, par.conv_id AS parent_conv_id, own.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN sums ON sums.conv_id = own.conv_id AND sums.depth = own.depth
LEFT JOIN kids ON kids.conv_id = own.conv_id AND kids.depth = own.depth
LEFT JOIN ends ON ends.conv_id = own.conv_id AND ends.depth = own.depth
LEFT JOIN up par ON par.c = own.conv_id AND par.depth = own.depth - 1
"""
