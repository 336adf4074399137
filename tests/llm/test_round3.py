"""Top-k search, prefix trie and structure repair against their SQL and plain versions."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest

from tracewell.llm import prefixtrie, repair, topk

SF = "/root/testdata/sf0.001"


def duck(sql, **tables):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        if t in tables:
            con.register(t, tables[t])
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def same(frame, sql, **tables):
    names, want = duck(sql, **tables)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in frame.collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("query, sql", [(topk.op11_topk, topk.OP11_SQL), (prefixtrie.op12_prefix_trie, prefixtrie.OP12_SQL), (repair.op13_structure_repair, repair.OP13_SQL)])
def test_queries_equal_their_sql(spark, query, sql):
    same(query(spark, SF), sql)


# --- top-k ---


def brute_top(rows, k, every):
    """rows: (id, vector) with the row's place as its identity."""
    good = [(i, v, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, _, x) in enumerate(good):
        if q is None or q % every:
            continue
        scores = [(-max(-(2**63), min(2**63 - 1, sum(s * t for s, t in zip(x, y, strict=False)))), i is None, i or 0) for b, (i, _, y) in enumerate(good) if a != b]
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("block, part_rows, at_once", [(128, 8192, 1024), (3, 7, 2), (1, 1, 1)])
def test_topk_equals_brute_force_whatever_the_cuts(spark, block, part_rows, at_once):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(4)]) for i in range(40)]
    rows += [(100 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(20)]  # one vector very often: ties
    rows += [(5, None), (10, [1.0, None]), (15, [float("nan")]), (20, [float("inf"), 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (200, []), (205, [1.0]), (210, [1.0] * 7), (100, [1.0, 1.0, 1.0, 1.0]), (0, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = topk.top_k(frame, 5, 5, block=block, part_rows=part_rows, queries_at_once=at_once, parts_at_once=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_top(rows, 5, 5)


def test_topk_with_fewer_rows_than_k_large_values_and_no_rows(spark):
    kinds = "vec_id long, embedding array<double>"
    rows = [(0, [3e15, -2.0]), (1, [2e15, 1.0]), (2, [1e300, 0.0]), (3, [1e12, 5e7])]
    got = topk.top_k(spark.createDataFrame(rows, kinds))
    want = {1: 2**63 - 1, 2: 2**63 - 1, 3: 2**63 - 1}
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == sorted(want.items())
    one = topk.top_k(spark.createDataFrame([(0, [1e7, 3.0]), (1, [1e7, -1.0]), (2, [1e7 + 1, 0.0])], kinds))
    assert [(r.vec_id, r.score) for r in one.orderBy("rank").collect()] == [(2, 640000000 * 640000064), (1, 640000000**2 - 192 * 64)]
    assert topk.top_k(spark.createDataFrame([], kinds)).count() == 0
    assert topk.top_k(spark.createDataFrame([(20, [1.0])], kinds)).count() == 0
    assert topk.top_k(spark.createDataFrame([(20, None), (40, None)], kinds)).count() == 0


def test_bounds_prune(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (16, 8))
    blocks = [(c + rng.integers(-2, 3, (32, 8)), np.arange(i * 32, i * 32 + 32), np.zeros(32, bool)) for i, c in enumerate(centres)]
    high, low = np.stack([b[0].max(0) for b in blocks]), np.stack([b[0].min(0) for b in blocks])
    seen, plain = [], topk.products
    monkeypatch.setattr(topk, "products", lambda a, b: seen.append(len(a)) or plain(a, b))
    queries = np.concatenate([b[0][:4] for b in blocks])
    found = topk.search(queries, np.full(len(queries), -1), np.full(len(queries), topk._NONE), blocks, high, low, 10)
    whole = queries @ np.concatenate([b[0] for b in blocks]).T
    assert [found[1][found[0] == i].tolist() for i in range(len(queries))] == (-np.sort(-whole, axis=1)[:, :10]).tolist()
    assert sum(seen) < 0.5 * len(queries) * len(blocks)


# --- prefix trie ---

ODD_TURNS = [
    (0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, None, None, "null turn"), (1, 0, "user", "a"), (1, 1, None, None), (1, 1, None, None),
    (2, 5, "user", ""), (3, 0, "user", "Ä\n"), (4, -3, "user", "a"), (None, 0, "user", "nobody"), (7, 0, "user", "x"), (8, 0, "user", "x"), (8, 1, "user", "x"),
    (-3, 0, "user", "a"), (-5, 0, "user", "base"), (-5, 1, "user", "base"), (10, 0, "x", "y" * 50_000), (11, 0, "user", "a"),
]
TURN = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    turns = {c: [v[3:] for v in sorted(t)] for c, t in turns.items()}
    made = {}
    for c, own in turns.items():
        h, b = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        made[c] = turns.get(b, [])[:h] + own[h:]
    nodes = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    ids, out = {k: min(v) for k, v in nodes.items()}, []
    for k, members in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        parents = {x[:-1] for x in under if x}
        children = [x for x in under if len(x) == len(k) + 1]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = sorted(c for c in members if len(made[c]) == len(k))
        out.append((ids[k], len(k), ids[k[:-1]] if k else None, len(members), len(children), len([x for x in under if x not in parents]), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(repr, out))


def trie_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 80), 40):
        rows += [(c, t, "user", rng.choice("ab")) for t in range(rng.choice([0, 1, 3, 12]))]
        rows += [(c, 20 + t, "a", "same") for t in range(rng.choice([0, 6]))]
    return rows


@pytest.mark.parametrize("unit", [1, 3, 256])
@pytest.mark.parametrize("rows", [ODD_TURNS, trie_rows(1), trie_rows(2)], ids=["odd", "one", "two"])
def test_trie_equals_brute_force(spark, rows, unit):
    frame = spark.createDataFrame([(*r, 1, "b") for r in rows], TURN + ", depth int, c string")
    got = prefixtrie.prefix_trie(frame, unit)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert got.columns == names
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_trie(rows)


def test_a_staircase_of_chains_and_a_hot_node(spark):
    stairs = [(5 * i, t, "user", "s" if t < i else f"end {i}") for i in range(12) for t in range(i + 1)]
    copies = [(1000 + c, t, "user", "copy") for c in range(700) for t in range(12)]
    got = prefixtrie.prefix_trie(spark.createDataFrame(stairs + copies, TURN), 4)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_trie(stairs + copies)


def test_digests_of_ends_in_pieces(spark):
    rows = [(1, 2, c) for c in range(500)] + [(1, 3, 7), (4, 0, 9), (4, 0, -10)]
    got = prefixtrie.end_digests(spark.createDataFrame(rows, "owner long, depth long, c long"), piece=16)
    want = {(1, 2): ",".join(map(str, range(500))), (1, 3): "7", (4, 0): "-10,9"}
    assert {(r.owner, r.depth): r.sha for r in got.collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_an_empty_table_has_no_nodes(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURN)).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TURN)).count() == 0


# --- structure repair ---


def brute_repair(signs):
    """All edits up to two insertions before each turn and at the end, by recursion over (turn, state)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "")] if i == len(signs) and state in (0, 3) else []
        for x in "ua":
            if inserts < 2 and (state, x) in step:
                c, a = best(i, step[state, x], inserts + 1)
                ways.append((c + 2, "I" + a))
        if i < len(signs):
            c, a = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a))
            if signs[i] not in "0123":
                extra = signs[i].isupper()
                for x, cost, letter in [(signs[i].lower(), 0, "K"), ("u", 2, "R"), ("a", 2, "R")]:
                    if (state, x) in step:
                        c, a = best(i + 1, step[state, x], 0)
                        ways.append((c + cost + extra, letter + a))
        return min(ways, default=(10**9, ""))

    return best(0, 0, 0)


def test_repairs_equal_brute_force_and_chunks_change_nothing():
    rng = random.Random(5)
    every = ["".join(s) for n in range(4) for s in itertools.product("suaxSUA123", repeat=n)]
    for signs in every + ["".join(rng.choices("suauauaxSUA0123", k=rng.randrange(4, 30))) for _ in range(1500)]:
        cost, audit = repair.repair(signs)
        assert (cost, audit) == brute_repair(signs)
        if signs:
            size = rng.randrange(1, 9)
            parts = [signs[i : i + size] for i in range(0, len(signs), size)]
            total, path = repair.joined(repair.crossings(p, i == len(parts) - 1) for i, p in enumerate(parts))
            assert (total, "".join(a for _, a in path)) == (cost, audit)


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_repair_equals_its_sql_on_odd_rows(spark, chunk):
    rng = random.Random(9)
    texts = ["Hi.", "What?", " \t", None, "no end", "end. \n", "x" * 70_000 + "!", "", "\u0085", " ."]
    rows = [(rng.randrange(40), rng.choice([None, *range(-3, 12)]), rng.choice(["user", "assistant", "system", None, "", "tool", "u"]), rng.choice(texts)) for _ in range(400)]
    rows += rows[:30] + [(None, t, "user", "a.") for t in range(3)]
    frame = spark.createDataFrame([(*r, 1, "c", "f") for r in rows], TURN + ", pos int, chunk string, fault string")
    same(repair.structure_repair(frame, chunk=chunk), repair.OP13_SQL, conversations=frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))


def test_repair_of_no_rows_and_of_rows_that_damage_drops(spark):
    assert repair.structure_repair(spark.createDataFrame([], TURN)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair.structure_repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURN)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
