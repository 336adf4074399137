"""Repair of the structure of conversations by the cheapest edits.

1. A conversation's turns are put in order and each gets a sign: the initial of its role and its first fault.
   Everything about structure is in the string of signs, one short string for every `CHUNK` turns.
2. The lattice of (turn index, grammar state) is not built: Dijkstra's algorithm makes the neighbours of a node
   when it is popped. Keys are (cost, audit), audit being the edits' initials so far, and the first accepting
   end node that is popped ends the search. Two equal costs at one node never have audits of which one begins
   the other (both have one letter for each turn, an insertion more costs 2), so extending keeps their order.
3. A conversation of `CHUNK` turns or more is searched chunk by chunk, from each state to each state, the chunks
   by themselves wherever they lie. The ways through them are put together in order of the chunks.
4. The edits go back to the turns, whose texts stream through the digest in order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import materialize, numbered, read_table

CHUNK = 1024  # turns; a conversation of fewer is one search
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = r"\x20\x09-\x0D"
LEGAL = {"su", "ua", "au"}

#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. What a produced initial leads to.
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {(EMPTY, "s"): AFTER_S, (EMPTY, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ACCEPTING = {EMPTY, AFTER_A}
NAMES = {"u": "user", "a": "assistant"}
GONE = "0123"  # signs of turns that have to go, for s, u, a and others


def dijkstra(start: tuple, neighbours: Callable[[tuple], Iterable[tuple[int, str, tuple]]], ends: Callable[[tuple], bool]) -> Iterator[tuple[int, str, tuple]]:
    """End nodes (cost, audit, node) in the order in which they are popped, each once."""
    heap, done = [(0, "", start)], set()
    while heap:
        cost, audit, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if ends(node):
            yield cost, audit, node
        for more, letters, other in neighbours(node):
            if other not in done:
                heapq.heappush(heap, (cost + more, audit + letters, other))


def edits(signs: str, last: bool = True) -> Callable[[tuple], Iterator[tuple[int, str, tuple]]]:
    """The neighbours of (turn index, state) for a string of signs (see `_sign`); behind signs that are not the `last` ones nothing is inserted."""

    def neighbours(node: tuple) -> Iterator[tuple[int, str, tuple]]:
        i, state = node
        if i < len(signs) or last:
            for made in "ua":
                if (state, made) in STEPS:
                    yield INSERT, "I", (i, STEPS[state, made])
        if i == len(signs):
            return
        yield DELETE, "D", (i + 1, state)
        if signs[i] in GONE:
            return
        initial, cost = signs[i].lower(), TRUNCATED * signs[i].isupper()
        if (state, initial) in STEPS:
            yield cost, "K", (i + 1, STEPS[state, initial])
        for made in "ua":
            if (state, made) in STEPS:
                yield cost + REROLE, "R", (i + 1, STEPS[state, made])

    return neighbours


def repair(signs: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a whole conversation."""
    found = dijkstra((0, EMPTY), edits(signs), lambda n: n[0] == len(signs) and n[1] in ACCEPTING)
    return next(found)[:2]


def crossings(signs: str, last: bool) -> list[tuple[int, int, str, int]]:
    """(state before, cost, audit, state after): the cheapest ways through a chunk, from each state to each."""
    return [(s, c, a, n[1]) for s in range(4) for c, a, n in dijkstra((0, s), edits(signs, last), lambda n: n[0] == len(signs))]


def joined(chunks: Iterable[list[tuple[int, int, str, int]]]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of the cheapest repair over all chunks, and for each chunk the state before it and its audit.

    An audit up to a chunk's end counts by its rank among those of the states, so that no long one is built. All
    of them end with an edit of the same turn: none begins another one, and the order of two stays what follows.
    """
    best: dict[int, tuple[int, int]] = {EMPTY: (0, 0)}  # by state: cost and rank
    back: list[dict[int, tuple[int, str]]] = []
    for ways in chunks:
        step: dict[int, tuple[int, int, str, int]] = {}
        for state, more, audit, after in ways:
            if state in best:
                cost, rank = best[state]
                step[after] = min(step.get(after, (cost + more, rank, audit, state)), (cost + more, rank, audit, state))
        audits = sorted({(rank, audit) for _, rank, audit, _ in step.values()})
        back.append({after: (state, audit) for after, (_, _, audit, state) in step.items()})
        best = {after: (cost, audits.index((rank, audit))) for after, (cost, rank, audit, _) in step.items()}
    cost, _, state = min((*best[s], s) for s in ACCEPTING if s in best)
    path = []
    for step in reversed(back):
        state, audit = step[state]
        path.append((state, audit))
    return cost, path[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """(none, c, turn, role, text, copy): every turn as the remainder by 20 of crc32(`conv_id:turn`) damages it; nulls are one space."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = conversations.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), how.alias("how"))
    rows = rows.where("how <> 0").withColumn("copy", F.explode(F.expr("IF(how = 3, array(0, 1), array(0))")))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("none", "c", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "copy")


def _sign(goes: Column, truncated: Column) -> Column:
    """The initial of a role (s, u, a, else x), a capital for a truncated turn, a digit for one that has to go."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(goes, F.translate(initial, "suax", GONE)).when(truncated, F.upper(initial)).otherwise(initial)


def _ways(it: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Chunks (none, c, chunk, n, signs, rest...): `cost` and `audit` for a whole conversation, `ways` through a chunk of a longer one.

    Each chunk by itself. `end` is the signs' last initial; a chunk is taken for the last one if it is not full,
    and a full one has the ways of both cases.
    """
    for batch in it:
        costs, audits, ways = [], [], []
        for no, n, signs in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            whole = no == 0 and n < chunk
            cost, audit = repair(signs) if whole else (None, None)
            costs.append(cost)
            audits.append(audit)
            ways.append(None if whole else json.dumps([crossings(signs, last) for last in (True, False)]))
        arrays = [pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(ways, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "cost", "audit", "ways"])


def _illegal(initials: str) -> int:
    """Neighbouring initials that may not follow each other."""
    return sum(a + b not in LEGAL for a, b in pairwise(initials))


_PLAIN = str.maketrans("SUAX0123", "suaxsuax")
REPAIRED = "none boolean, c long, chunk long, state int, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, whole string"


def _folded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of `_ways` in order: a row for each with its edits, and the figures of the conversation with the first."""
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    kinds = [{"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in REPAIRED.split(", ")]
    out: list[tuple] = []
    key, chunks = None, []

    def finish() -> None:
        if key is None:
            return
        if chunks[0]["audit"] is not None:
            cost, path = chunks[0]["cost"], [(EMPTY, chunks[0]["audit"])]
        else:
            cost, path = joined(json.loads(x["ways"])[i < len(chunks) - 1] for i, x in enumerate(chunks))
        figures = [sum(x[k] for x in chunks) for k in ("blank", "duplicate", "truncated")]
        known = [x for x in chunks if x["low"] is not None]
        distinct = sum(x["turns"] for x in known) - sum(a["high"] == b["low"] for a, b in pairwise(known))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        signs = [x["signs"].translate(_PLAIN) for x in chunks]
        illegal = sum(map(_illegal, signs)) + sum(_illegal(a[-1] + b[0]) for a, b in pairwise(signs))
        none = (None,) * 7
        for i, (state, audit) in enumerate(path):
            out.append((*key, i, state, audit, *((gaps, *figures, illegal, cost, "".join(a for _, a in path)) if i == 0 else none)))

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        out.clear()
        return made

    for batch in it:
        for row in batch.to_pylist():
            if key != (row["none"], row["c"]):
                finish()
                key, chunks = (row["none"], row["c"]), []
            chunks.append(row)
        if out:
            yield batch_of()
    finish()
    if out:
        yield batch_of()


def apply_audit(state: int, audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that the edits of a chunk make of `rows`, which has the chunk's turns in order."""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        made = role[:1] if letter == "K" else "a" if state == AFTER_U else "u"
        state = STEPS[state, made]
        yield (role if letter == "K" else NAMES[made]), text


def _digested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (none, c, chunk, pos, role, text, state, audit) in order, a chunk's edits (pos 0) before its turns: the digest of each repaired conversation.

    A conversation streams: the turns of one chunk at most are held.
    """
    names, kinds = ["none", "c", "sha"], [pa.bool_(), pa.int64(), pa.string()]
    key = sha = edit = None
    turns: list[tuple[str, str]] = []
    begun = False
    out: list[tuple] = []

    def flush() -> None:
        nonlocal begun
        if edit is None:
            return
        for role, text in apply_audit(*edit, iter(turns)):
            sha.update(("\n" * begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            begun = True
        turns.clear()

    for batch in it:
        for none, c, pos, role, text, state, audit in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7)), strict=True):
            if pos == 0:
                flush()
                if key != (none, c):
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha, begun = (none, c), hashlib.sha256(), False
                edit = (state, audit)
            else:
                turns.append((role, text))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
    flush()
    if key is not None:
        out.append((*key, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def structure_repair(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged, chunk: int = CHUNK) -> DataFrame:
    """One row for each conv_id: its faults, the cheapest repair and the digest of the repaired conversation.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). `damage` maps the table
    to the turns (none, c, turn, role, text, copy) that are judged and repaired; a conversation of which it leaves
    none has zeros, an empty audit and the digest of the empty string.

    Null roles and texts are one space. Turns come by number, a null one first, then by role, text and copy. A
    null conv_id is a conversation of its own. A repeated row is a duplicate, so at most one of its copies stays.
    Only the first fault of a turn counts: blank, duplicate, truncated. An empty table gives no rows; other
    columns are ignored.
    """
    ids = ["none", "c"]
    every = conversations.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c")).distinct()
    rows = numbered(damage(conversations), ids, "turn", ["role", "text", "copy"], "pos").withColumn("chunk", F.floor((F.col("pos") - 1) / chunk))
    rows = rows.select(*ids, "chunk", "pos", "turn", "role", "text", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("key"))
    rows = materialize(rows.withColumns({"blank": ~F.col("text").rlike(f"[^{SPACES}]"), "open": ~F.col("text").rlike(rf"[.!?][{SPACES}]*\z")}), "turns")

    first = rows.groupBy(*ids, "key").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    slim = rows.select(*ids, "chunk", "pos", "turn", "role", "key", "blank", "open").join(first, [*ids, "key"], "left")
    again = F.col("pos") > F.coalesce("first", "pos")
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("open"), "truncated")
    slim = slim.withColumn("fault", fault).withColumn("sign", _sign(F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)), F.coalesce(F.col("fault") == "truncated", F.lit(False))))
    signs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sign"))), lambda x: x.sign), "")
    counts = [F.count_if(F.coalesce(F.col("fault") == k, F.lit(False))).alias(k) for k in ("blank", "duplicate", "truncated")]
    chunks = slim.groupBy(*ids, "chunk").agg(F.count("*").alias("n"), signs.alias("signs"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"), *counts)
    schema = T.StructType([*chunks.schema.fields, T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("ways", T.StringType())])
    ways = chunks.mapInArrow(lambda it: _ways(it, chunk), schema)
    edited = materialize(ways.repartition(*ids).sortWithinPartitions(*ids, "chunk").mapInArrow(_folded, REPAIRED), "repairs")

    heads = edited.select(*ids, "chunk", F.lit(0).cast("long").alias("pos"), *(F.lit(None).cast("string").alias(k) for k in ("role", "text")), "state", "audit")
    texts = rows.select(*ids, "chunk", "pos", "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("audit"))
    dealt = heads.unionByName(texts).repartition(*ids).sortWithinPartitions(*ids, "chunk", "pos")
    digests = dealt.mapInArrow(_digested, "none boolean, c long, sha string")

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = every.join(edited.where("chunk = 0").drop("chunk", "state", "audit"), ids, "left").join(digests, ids, "left")
    figures = [zero(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.when(~F.col("none"), F.col("c")).alias("conv_id"), *figures, F.coalesce("whole", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair(read_table(spark, sf_dir, "conversations"))


def _sql() -> str:
    """The same by a table of the best edits after each turn, a row of four states; cost and audit are one string."""
    crc = "xor(list_reduce([unicode(x)::BIGINT for x in string_split({0}, '')], lambda a, b: list_reduce([0,1,2,3,4,5,6,7], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"
    b = lambda x, cost, letter: f"(lpad(({x}[1:9]::INT + {cost})::VARCHAR, 9, '0') || {x}[10:] || '{letter}')"
    inserted = f"""SELECT *, least(v2, i2, {b("i3", 2, "I")}) AS c2, least(v3, i3, {b("i2", 2, "I")}) AS c3 FROM (
      SELECT *, least({b("v0", 2, "I")}, {b("v1", 2, "I")}, {b("v3", 2, "I")}) AS i2, {b("v2", 2, "I")} AS i3 FROM {{0}})"""
    to_u = lambda cost, letter: ", ".join(b(x, cost, letter) for x in ("v0", "v1", "c3"))
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS w FROM conversations
), h AS (SELECT *, {crc.format("w")} % 20 AS how FROM src),
d AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM (SELECT *, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE how <> 0)
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
f AS (
  SELECT conv_id, turn, role, text, pos, role[1:1] AS ini,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1:1] AS pair
  FROM n
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id
), best AS (
  SELECT conv_id, 0::BIGINT AS pos, '000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM figures
  UNION ALL
  SELECT conv_id, pos, {b("v0", 3, "D")}, least({b("v1", 3, "D")}, CASE WHEN stays AND ini = 's' THEN {b("v0", "t", "K")} END),
    least({b("c2", 3, "D")}, CASE WHEN stays AND ini = 'u' THEN least({to_u("t", "K")}) END, CASE WHEN stays THEN least({to_u("t + 2", "R")}) END),
    least({b("c3", 3, "D")}, CASE WHEN stays AND ini = 'a' THEN {b("c2", "t", "K")} END, CASE WHEN stays THEN {b("c2", "t + 2", "R")} END)
  FROM ({inserted.format("(SELECT best.conv_id, f.pos, ini, fault NOT IN ('blank', 'duplicate') AS stays, (fault = 'truncated')::INT AS t, v0, v1, v2, v3 FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.pos = best.pos + 1)")})
), ended AS (SELECT conv_id, least(v0, c3) AS e FROM ({inserted.format("(SELECT best.* FROM best JOIN figures ON figures.conv_id IS NOT DISTINCT FROM best.conv_id AND pos = n)")})),
made AS (
  SELECT conv_id, e[10:] AS left_over, 0::BIGINT AS pos, 'z' AS last, NULL::VARCHAR AS out FROM ended
  UNION ALL
  SELECT m.conv_id, left_over[2:], coalesce(f.pos, m.pos), CASE letter WHEN 'D' THEN last WHEN 'K' THEN ini ELSE other[1:1] END,
    CASE letter WHEN 'D' THEN out ELSE coalesce(out || chr(10), '') || CASE letter WHEN 'K' THEN role ELSE other END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END END
  FROM (SELECT *, left_over[1:1] AS letter, CASE WHEN last = 'u' THEN 'assistant' ELSE 'user' END AS other FROM made WHERE left_over <> '') m
  LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.pos = m.pos + 1 AND letter <> 'I'
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e[1:9]::BIGINT, 0) AS cost, coalesce(e[10:], '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN figures ON figures.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM i.conv_id AND left_over = ''
"""


OP13_SQL = _sql()
