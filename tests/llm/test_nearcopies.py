"""Near copies of the pipeline's stage against brute force."""

import itertools
import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from tracewell.llm import nearcopies, simhash

SF = "/root/testdata/sf0.001"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_stage_finds_edited_copies_of_similarity_08(spark):
    rng, rows = random.Random(5), []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 300, 1500)))]
        rows += [(10 * base + k, " ".join(edited(rng, words, share))) for k, share in enumerate((0, 0.01, 0.015, 0.02, 0.03, 0.1))]
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b")]
    sets, label = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = 0
    for i, j in itertools.combinations(sets, 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * both >= 4 * either:
            pairs += 1
            a, b = sorted((find(i), find(j)))
            label[b] = a
    want = sorted(i for i in sets if find(i) == i)
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert pairs > 100 and sorted(r.doc_id for r in got.collect()) == want


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def components(sets):
    label = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        if similar(sets[i], sets[j]):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("large", [50_000, 4])
def test_pairs_that_a_forest_leaves_out_are_compared(spark, large):
    """Families of copies of copies: neighbours in a forest fail where other pairs of the group are similar."""
    rng, sets = random.Random(11), {}
    for family in range(12):
        base = [(family, i) for i in range(400)]
        for k in range(14):
            kept = [w if rng.random() > rng.choice((0.02, 0.05, 0.08, 0.12)) else (family, k, i) for i, w in enumerate(base)]
            sets[family * 100 + k] = set(kept)
            if rng.random() < 0.3:
                base = kept
    hashed = {i: np.unique(np.array([xxh64_intdigest(repr(w).encode()) for w in x], np.uint64)) for i, x in sets.items()}
    nodes = spark.createDataFrame([(i, nearcopies.fingerprint_of(h), nearcopies.trees_of(h)) for i, h in hashed.items()], "node long, fp long, trees array<long>")
    whole = spark.createDataFrame([(i, bytearray(h.tobytes()), bytearray(nearcopies.lowest(h).tobytes())) for i, h in hashed.items()], "node long, hashes binary, low binary")
    got = {r.node: r.root for r in nearcopies._classes(nodes, lambda wanted: whole.join(wanted, "node", "left_semi"), large).collect()}
    want = components(sets)
    assert len(set(want.values())) > 12 and {i: got.get(i, i) for i in sets} == want


@pytest.mark.parametrize("every", [False, True])
def test_walk_finds_all_pairs_with_equal_fingerprints(every):
    rng = random.Random(3)
    f = np.sort(np.array([rng.choice((0, 1, 3, 255, 1 << 63, (1 << 63) + 7)) for _ in range(60)], np.uint64))
    tree = np.zeros(60, np.int64)
    seen, classes = set(), simhash.Classes(60)
    simhash.walk(tree, f, 3, classes, lambda x, y: seen.update(zip(x.tolist(), y.tolist())) if every else classes.join(x, y), every=every)
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if (int(f[i]) ^ int(f[j])).bit_count() <= 3}
    if every:
        assert {tuple(sorted(p)) for p in seen} == want
    else:
        label = list(range(60))
        for i, j in want:
            label = [label[i] if v == label[j] else v for v in label]
        root = classes.settle().tolist()
        assert all((root[i] == root[j]) == (label[i] == label[j]) for i, j in itertools.combinations(range(60), 2))


def test_the_row_that_stays_is_chosen_by_group_and_text(spark):
    one, two = "alpha beta gamma delta epsilon zeta eta theta iota", "completely different words stand in this other text here"
    rows = [(1, one, 7), (1, two, 8), (2, one, 9), (None, one, 1), (None, "no id at all", 2), (None, "no id at all", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __id long")
    kept = sorted((r.doc_id or 0, r.text) for r in nearcopies.drop_near_copies(table).collect())
    assert kept == sorted([(1, one), (1, two), (0, "no id at all")]) and nearcopies.drop_near_copies(table).columns == table.columns


def test_odd_tables(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (4, "a"), (4, "a"), (None, "no id")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in nearcopies.drop_near_copies(odd).collect()) == [0, 1, 4]
    assert nearcopies.drop_near_copies(odd.limit(0)).count() == 0


def test_large_families_in_parts_are_linked_as_in_one(spark):
    """Families cut into parts of a few leaves, or of few bytes: every two parts of a family meet."""
    rng, sets = random.Random(3), {}
    for family in range(3):
        base = [(family, i) for i in range(200)]
        for k in range(25):
            sets[family * 100 + k] = {w if rng.random() > rng.choice((0.02, 0.06, 0.1, 0.13)) else (family, k, i) for i, w in enumerate(base)}
    hashed = {i: np.unique(np.array([xxh64_intdigest(repr(w).encode()) for w in x], np.uint64)) for i, x in sets.items()}
    nodes = spark.createDataFrame([(i, nearcopies.fingerprint_of(h), nearcopies.trees_of(h)) for i, h in hashed.items()], "node long, fp long, trees array<long>")
    whole = spark.createDataFrame([(i, bytearray(h.tobytes())) for i, h in hashed.items()], "node long, hashes binary")
    of = lambda **parts: {r.node: r.root for r in nearcopies._classes(nodes, lambda wanted: whole.join(wanted, "node", "left_semi"), 50_000, **parts).collect()}
    want = components(sets)
    for parts in ({}, {"leaves_of": 4}, {"bytes_of": 10_000}):
        got = of(**parts)
        assert {i: got.get(i, i) for i in sets} == want


def test_a_similar_pair_behind_many_closer_ones_is_linked(spark):
    """A pair of similarity 0.8 that shares few of its smallest values; seven others of its tree share more with either, none is similar to any."""
    r, sets = np.random.default_rng(99), []
    new = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    core = new(360)
    pair = [np.unique(np.concatenate((core, new(45)))) for _ in range(2)]
    alike = lambda x, y: 5 * (both := len(np.intersect1d(x, y))) >= 4 * (len(x) + len(y) - both)
    for x in pair:
        got = []
        while len(got) < 7:
            d = np.unique(np.concatenate((r.permutation(x)[: int(len(x) * 0.888)], new(int(len(x) * 0.118)))))
            if not any(alike(d, z) for z in (*pair, *sets, *got)) and (nearcopies.lowest(d) == nearcopies.lowest(x)).sum() >= 108:
                got.append(d)
        sets += got
    sets = pair + sets
    nodes = spark.createDataFrame([(i, nearcopies.fingerprint_of(h), [7]) for i, h in enumerate(sets)], "node long, fp long, trees array<long>")
    whole = spark.createDataFrame([(i, bytearray(h.tobytes()), bytearray(nearcopies.lowest(h).tobytes())) for i, h in enumerate(sets)], "node long, hashes binary, low binary")
    got = {x.node: x.root for x in nearcopies._classes(nodes, lambda wanted: whole.join(wanted, "node", "left_semi"), 50_000).collect()}
    assert alike(*pair) and [got.get(i, i) for i in range(len(sets))] == [0, 0, *range(2, len(sets))]
