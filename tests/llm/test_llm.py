"""Operators of tracewell.llm against brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tracewell.llm import chat, decontaminate, langid, pieces, quality, shards, simhash, tokencount, toxicity, urls
from tracewell.session import shared_path

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels conversations pages".split()

#: Nulls, empty and odd texts, repeated rows, ties.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (5, "Ä b C"), (None, "no id"), (6, "w " * 30_000), (7, "x" * 70_000),
    (8, "\u0085 \u2028 end"), (9, "the same eight words come once more here and the same eight words come once more here"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def duck(sql, tables=None):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, frame in (tables or {}).items():
        con.execute(f"DROP VIEW IF EXISTS {name}")
        con.register(name, frame)
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", ["op1_chat_format", "op5_quality_rules", "op7_decontaminate", "op9_url_filter"])
def test_queries_equal_their_sql(spark, name):
    names, want = duck(entry.oracle_sql()[name])
    got = [tuple(r[c] for c in names) for r in entry.queries()[name](spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- chat ---

CONTROL = ["### ", "</turn>", "</turn>\n", "\\", "\\/", "\\#", "#", "<", "/", ": ", ":", " ", "\n", "user", "é", "\\\\", ""]


def test_chat_round_trip_of_control_strings(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "a: b", "### x", "c:\\# d", "</turn>\n"]), "".join(rng.choices(CONTROL, k=rng.randrange(7)))) for c in range(150) for t in range(3)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = made.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_mask")))
    for r in back.collect():
        source = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == source
        assert r.loss == "".join(t for role, t in source if role == "assistant")


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (None, None, None, "x"), (2, 1, "assistant", "y" * 50_000)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert got[1].n_turns == 3 and got[1].formatted.count("</turn>\n") == 3
    assert got[None].formatted == "### : x</turn>\n" and len(got[2].formatted) == 50_000 + 23
    assert chat.format_conversations(table.limit(0)).count() == 0


# --- quality ---


def repeated(words, width=8):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(width)})


def test_quality_counts(spark, odd):
    rng = random.Random(2)
    extra = [(100 + i, " ".join(rng.choices("ab", k=rng.randrange(60))), "en", "") for i in range(60)]
    table = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_repeat_words, r.base_failed, r.kept) for r in quality.quality_rules(table).collect())
    want = []
    for i, text in [*ODD, *((r[0], r[1]) for r in extra)]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = repeated(words)
        failed = len(words) < 20 or 100 * n > 30 * len(words)
        want.append((i or 0, len(words), sum(map(len, words)), n, failed))
    assert [g[:5] for g in got] == sorted(want)
    assert not any(g[4] and g[5] for g in got)


def test_quality_removes_lines(spark):
    good = "A sentence with quite some words in it, and it ends. Then another one follows that says something else, so that no window of words comes twice. "
    nav = "Home | News | Sport | Contact"
    rows = [(1, good + "\n" + nav + "\nAll rights reserved."), (2, nav * 1 + "\n" + "\n".join(["WOW!! SO!! MUCH!! NOISE!!"] * 9)), (3, good)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].clean_text == good and got[1].kept and got[1].removed.navigation == 1 and got[1].removed.boilerplate == 1
    assert not got[2].kept and got[2].lost_share == 1.0
    assert got[3].kept and got[3].lost_share == 0.0


# --- simhash ---


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("frontier", [1 << 17, 5])
def test_trie_join_finds_all_links(frontier):
    rng = random.Random(3)
    for _ in range(10):
        fps = set()
        for base in (rng.getrandbits(64) for _ in range(15)):
            for _ in range(rng.randrange(1, 12)):
                fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
        fps = sorted(fps)
        got = simhash.trie_links(np.zeros(len(fps), int), np.array(fps, np.uint64), 3, frontier)
        assert got.tolist() == components(fps)


@pytest.mark.parametrize("large", [50_000, 10])
def test_simhash_query_equals_brute_force(spark, docs, monkeypatch, large):
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (3, large))
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    label, low = components(fps), {}
    for r, c in zip(rows, label, strict=True):
        low[c] = min(low.get(c, r.doc_id), r.doc_id)
    want = sorted((r.doc_id, f"{f:016x}", low[c]) for r, f, c in zip(rows, fps, label, strict=True))
    assert sorted(map(tuple, simhash.op6_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_simhash_edges(odd):
    got = sorted((r.doc_id or 0, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert [(g[0], g[1]) for g in got] == sorted((i or 0, slow_fingerprint(t)) for i, t in ODD)
    assert {g[2] for g in got if g[0] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_components_of_a_long_chain_and_of_random_edges(spark, small):
    n = 300
    edges = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = simhash.connected_components(edges.repartition(3, "u"), small=small).collect()
    assert len(got) == n and {r.root for r in got} == {0}
    rng = random.Random(8)
    pairs = [(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(260)]
    label = {x: x for p in pairs for x in p}
    for u, v in pairs:
        a, b = label[u], label[v]
        label = {k: min(a, b) if x in (a, b) else x for k, x in label.items()}
    got = simhash.connected_components(spark.createDataFrame(pairs, "u long, v long").repartition(4), small=small)
    assert {r.node: r.root for r in got.collect()} == {k: v for k, v in label.items() if k != v}


def test_a_hot_tree_is_split_until_it_is_small(spark):
    """All fingerprints agree on 30 bits, so two levels of trees are hot; no link is lost."""
    rng = random.Random(6)
    fps = sorted({rng.getrandbits(34) for _ in range(300)} | {(1 << 33) + sum(1 << b for b in rng.sample(range(34), 2)) for _ in range(200)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    trees = simhash.planted(frame, 3, 40)
    assert trees.groupBy("tree").count().agg(F.max("count")).first()[0] <= 40
    roots = {r.node: r.root for r in simhash.connected_components(simhash.fingerprint_links(frame, 3, 40)).collect()}
    got = [roots.get(f, f) for f in fps]
    assert got == [fps[c] for c in components(fps)]


# --- decontamination ---


def test_wu_manber_equals_plain_search(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abc")
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 12])))) for i in range(12)] + [(3, None), (None, "a b")]
    texts = [(i, "! ".join(word() for _ in range(rng.randrange(60)))) for i in range(150)] + [(900, None), (901, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (150_000, 7):
        got = {r.doc_id: r for r in decontaminate.find_benchmark(table, bench, block_windows=block).collect()}
        clean = {r.doc_id for r in decontaminate.drop_contaminated(table, bench, block_windows=block).collect()}
        assert clean == {i for i, r in got.items() if not r.hits}
        for i, text in texts:
            words = re.findall("[a-z0-9]+", text or "")
            hit, found = set(), set()
            for k, item in items:
                own = re.findall("[a-z0-9]+", item or "")
                m = min(10, len(own))
                for at in range(len(own) - m + 1 if own else 0):
                    for p in range(len(words) - m + 1):
                        if words[p : p + m] == own[at : at + m]:
                            hit |= set(range(p, p + m))
                            found |= set() if k is None else {str(k)}
            assert sum(s.end - s.start for s in got[i].hits) == len(hit) and got[i]["items"] == sorted(found)


def test_decontamination_edges(spark, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(odd, empty).count() == len(ODD)
    assert decontaminate.find_benchmark(odd.limit(0), empty).count() == 0


# --- token counts ---


def test_token_counts_and_cache(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    cache = shared_path(spark, "cache")
    rows = odd.unionByName(spark.createDataFrame([(50, "a <|endoftext|> b", "en", "")], odd.schema))
    library = Tokenizer.from_file(path)
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect())
    for _ in range(2):
        got = tokencount.count_tokens(rows, cache, tokencount.TokenizerFile(path))
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == rows.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert tokencount.count_tokens(rows.limit(0), cache, tokencount.TokenizerFile(path)).count() == 0


class Unable(tokencount.TokenizerFile):
    def counts(self, texts):
        raise AssertionError("a text was encoded")


def test_a_second_run_encodes_nothing(spark, docs):
    import public_tokenizers

    path, cache = str(public_tokenizers.path("byte_bpe_50k.json")), shared_path(spark, "cache")
    first = tokencount.count_tokens(docs, cache, tokencount.TokenizerFile(path)).collect()
    again = tokencount.count_tokens(docs.unionByName(docs), cache, Unable(path)).collect()
    assert sorted(first * 2) == sorted(again)
    with pytest.raises(Exception, match="a text was encoded"):
        tokencount.count_tokens(spark.createDataFrame([(1, "a text that is new")], "doc_id long, text string"), cache, Unable(path)).collect()


def test_token_counts_of_a_piece_model(spark, docs):
    from sentencepiece import SentencePieceProcessor

    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, shared_path(spark, "cache"), tokencount.TokenizerFile(pieces.model_path())).collect()}
    library = SentencePieceProcessor(model_file=pieces.model_path())
    assert got == {r.doc_id: len(library.encode(r.text or "")) for r in docs.collect()}


# --- pieces ---


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.model_path())


def test_pieces_equal_the_library(model, docs):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(5)
    parts = ["a", "e", "th", "ing", " ", "  ", "▁", "\n", "é", "日本", "😀", "1", "==", "    ", "\t", "\\", "𝔘", "the "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(1500)] + [r.text or "" for r in docs.collect()] + ["x" * 5000, "ab" * 3000, "abc. de\n" * 2000, "word " * 900 + "y" * 9000 + " end. " * 900]
    for text in texts:
        ids = model.encode(text)
        assert ids == library.encode(text)
        assert model.decode(ids) == text.replace("▁", " ")


def test_streaming_search_commits_early_and_agrees(model):
    text = "".join(random.Random(6).choices("abcdetinghosé", k=2000))
    fed = 0

    def characters():
        nonlocal fed
        for c in text:
            fed += 1
            yield c

    out, first = [], None
    for p in itertools.chain.from_iterable(model.viterbi(characters())):
        first = first or fed
        out.append(p)
    assert first < 200  # ids leave while the text still comes in
    assert [i for p in out for i in model.ids_of(p)] == list(itertools.chain.from_iterable(map(model.ids_of, model.merged(text))))


def test_window_of_a_text_of_millions_of_characters(model):
    rng, alphabet = random.Random(8), "abcdetinghosé"
    text = "".join(rng.choices(alphabet, k=50_000))
    fed = (text[k : k + 1000] for _ in range(60) for k in range(0, len(text), 1000))  # three million characters without a boundary
    model.widest, n = 0, 0
    tail: list[str] = []
    for p in itertools.chain.from_iterable(model.viterbi(fed)):
        n += len(p)
        tail = [*tail[-50:], p]
    assert n == 60 * len(text) and text.endswith("".join(tail[1:]))
    assert model.longest == 16 and model.widest <= 1000 + 8 * model.longest  # one block and a few pieces


def test_user_defined_pieces_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.pieces[-1].type = pb.ModelProto.SentencePiece.USER_DEFINED
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="user-defined"):
        pieces.PieceModel(str(tmp_path / "m.model"))


def test_pieces_edges(odd):
    got = {r.doc_id: r for r in pieces.decode_pieces(pieces.with_pieces(odd, pieces.model_path()), pieces.model_path()).collect()}
    assert all(r.round_trip and r.decoded == (r.text or "") for r in got.values())
    assert got[1].ids == [] and got[2].n_ids == 0


# --- language ---


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = langid.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    test = [r for r in found if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in found)


def test_svm_equals_a_plain_solver():
    """The dual by coordinate descent over sparse rows against projected gradient steps over dense ones."""
    rng = np.random.default_rng(4)
    n, width, c = 60, 40, 10.0
    x = np.abs(rng.normal(size=(n, width))) * (rng.random((n, width)) < 0.3)
    x[:, 0] += 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.where(x[:, 1:6].sum(1) + 0.2 * rng.normal(size=n) > x[:, 6:12].sum(1), 1.0, -1.0)
    cap = np.where(y > 0, c * n / (2 * (y > 0).sum()), c * n / (2 * (y < 0).sum()))
    q = (y[:, None] * x) @ (y[:, None] * x).T
    a, step = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        a = np.clip(a + step * (1 - q @ a), 0, cap)
    best = (a * y) @ x
    primal = lambda w: w @ w / 2 + (cap * np.maximum(0, 1 - y * (x @ w))).sum()
    got = langid.train_svm([(np.flatnonzero(r).astype(np.uint32), r[r > 0]) for r in x], y, width, c, epochs=3000)
    assert primal(got) <= 1.005 * primal(best) and np.linalg.norm(got - best) <= 0.05 * np.linalg.norm(best)


def test_language_query_equals_a_plain_prediction(spark):
    """The query against family and pair votes written out, for the same model."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    m = langid.train_language_model(docs)
    got = {r.doc_id: r for r in langid.op8_language_id(spark, SF).collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        out = langid.features(r.text, m.bits).astype(float) @ m.weights
        fam = m.families[int(np.argmax(out[: len(m.families)]))]
        won = {g: sum((out[len(m.families) + k] > 0) == (g == a) for k, (a, b) in enumerate(m.pairs) if g in (a, b)) for g in m.langs if langid.family(g) == fam}
        assert got[r.doc_id].lang_pred in won and (len(won) > 2 or won[got[r.doc_id].lang_pred] == max(won.values()))


def test_language_edges(spark, odd, docs):
    m = langid.train_language_model(docs)
    got = {r.doc_id: r for r in langid.with_language(odd, m).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[5].lang_pred in m.langs
    none = langid.train_language_model(docs.limit(0))
    assert {r.lang_pred for r in langid.with_language(odd, none).collect()} == {"und"}
    assert langid.drop_unknown_language(odd, m).columns == odd.columns


# --- toxicity ---


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    test = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    m = toxicity.train_severity(docs, labels.where(~test))
    assert m.thresholds == sorted(m.thresholds)
    found = toxicity.with_severity(docs, m).join(labels.where(test).withColumnRenamed("toxic", "label"), "doc_id").select("label", "toxic", "severity").collect()
    toxic, clean = [r for r in found if r.label == 1], [r for r in found if r.label == 0]
    assert sum(r.toxic for r in toxic) >= 0.9 * len(toxic) and sum(r.toxic for r in clean) <= 0.01 * len(clean)
    assert np.mean([r.severity for r in toxic]) > 1 > np.mean([r.severity for r in clean])


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 3))
    y = np.digitize(x @ [2.0, -1.0, 0.0] + rng.logistic(size=600) * 0.3, [-1.0, 0.5, 2.0])
    w, theta = toxicity.fit_cumulative(x, y, 4)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.5 and (np.diff(theta) > 0).all()


def test_gradient_equals_differences_of_the_loss():
    rng = np.random.default_rng(2)
    x, y, p = rng.normal(size=(80, 4)), rng.integers(0, 4, 80), rng.normal(size=7) * 0.3
    balance = np.where(y > 0, 0.7, 2.0)
    _, g = toxicity.loss(p, x, y, balance, 4, 0.05)
    for k in range(len(p)):
        step = np.eye(len(p))[k] * 1e-6
        slope = (toxicity.loss(p + step, x, y, balance, 4, 0.05)[0] - toxicity.loss(p - step, x, y, balance, 4, 0.05)[0]) / 2e-6
        assert abs(slope - g[k]) < 1e-6


def test_texts_with_equal_extremes_of_word_hashes_all_count(monkeypatch):
    """Words of least and greatest hash are shared by texts that have nothing else in common."""
    words = sorted({f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"}, key=lambda w: zlib.crc32(w.encode()))
    inner = words[1:-1]
    texts = [(" ".join([words[0], *inner[k * 20 : k * 20 + 20], words[-1]]), k % 2) for k in range(20)]
    seen = []
    real = toxicity.select_features
    monkeypatch.setattr(toxicity, "select_features", lambda samples, **k: seen.append(len(samples)) or real(samples, **k))
    toxicity.fit(texts)
    assert seen == [20]
    toxicity.fit([*texts, texts[0]])  # an exact repeat counts once
    assert seen == [20, 20]


def test_toxicity_query_equals_a_plain_scorer(spark):
    """The query against weights applied word by word, for the same model."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    m = toxicity.train_severity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, SF).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        eta = sum(m.weights.get(w, 0) + sum(m.weights.get(w[:k] + "*", 0) for k in (4, 5, 6, 7, 8) if len(w) > k) for w in words) * 10 / (len(words) + 40) ** 0.5
        want = sum(1 / (1 + np.exp(t - eta)) for t in m.thresholds) if words else 0.0
        assert abs(got[r.doc_id].severity - want) < 1e-9


def test_toxicity_edges(spark, odd):
    m = toxicity.train_severity(odd, spark.createDataFrame([(1, None), (77, 1)], "doc_id long, toxic int"))
    assert all(r.severity == 0 or not r.toxic for r in toxicity.with_severity(odd, m).collect())
    assert toxicity.drop_toxic(odd, m).count() == len(ODD)


# --- urls ---


def test_url_edges_and_index(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://COM"), (4, "x://a.Example.COM/en/77?x#y"), (5, "x://com/en/"), (6, "x://xcom/en/"), (7, "http://example.net/de/8"), (8, "a://b://c/d"), (8, "a://b://c/d"), (9, "http://spam-farm.example.org/en/1")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, [*urls.RULES, *urls.PATTERNS]).collect())
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "com", "", None, "allow"), (4, "a.example.com", "/en/77", "example.com/en/7", "allow"),
        (5, "com", "/en/", "com/en/", "block"), (6, "xcom", "/en/", None, "allow"), (7, "example.net", "/de/8", "example.net/de/8", "block"),
        (8, "b:", "//c/d", None, "allow"), (8, "b:", "//c/d", None, "allow"), (9, "spam-farm.example.org", "/en/1", None, "block"),
    ]
    index = urls.RuleIndex(urls.RULES, {"com": 50, "en": 90, "example": 99})
    assert index.by["com"][0].name == "com/en/" and not index.always


def test_rules_in_blocks_decide_as_in_one(spark):
    rng = random.Random(9)
    hosts = ["a.com", "b.a.com", "c.net", "x.c.net", "d.org"]
    paths = ["/en", "/en/7", "/en/71", "/de/8/9", "/", "/login"]
    rules = list(dict.fromkeys(urls.prefix_rule(rng.choice(("block", "allow")), rng.choice(hosts + ["com", "net"]), p[: rng.randrange(1, len(p) + 1)]) for p in paths * 6))
    rules += [urls.UrlRule("any-seven", "block", "7", (), rank=5), *urls.PATTERNS]
    pages = spark.createDataFrame([(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}", "clash") for i in range(60)], "page_id long, url string, __best string")
    want = sorted(urls.filter_urls(pages, rules).collect())
    assert len({r.verdict for r in want}) == 2 and pages.columns[2] in urls.filter_urls(pages, rules).columns
    for size in (1, 7):
        rng.shuffle(rules)
        assert sorted(urls.filter_urls(pages, rules[: 2 * size], block_rules=size).collect()) == sorted(urls.filter_urls(pages, rules[: 2 * size]).collect())
    assert sorted(urls.filter_urls(pages, rules, block_rules=20).collect()) == want


# --- shards ---


def test_shards(spark, docs, odd):
    for table, k in ((docs, 24), (odd, 4), (odd.limit(0), 4)):
        rows = shards.shard_documents(table.select("doc_id", "text"), shared_path(spark, "shards"), k, bucket_bytes=100_000).collect()
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        assert not rows or max(map(len, by.values())) - min(len(by.get(i, [])) for i in range(k)) <= 1
        assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, ((r.doc_id, r.text) for r in table.collect())))


def test_shards_equal_a_recomputation_whatever_the_order_of_the_input(spark, docs):
    table = docs.select("doc_id", "text")
    seen = []
    for given in (table, table.orderBy(F.desc("text")).repartition(5), table.repartition(3, "text")):
        seen.append(sorted((r.doc_id, r.shard, r.slot) for r in shards.shard_documents(given, shared_path(spark, "shards"), 7, bucket_bytes=60_000).collect()))
    assert seen[0] == seen[1] == seen[2]
    total = sum(len((r.text or "").encode()) + 16 for r in table.collect())
    n = -(-total // 60_000)
    drawn = shards._drawn(table, 17).select("doc_id", "__draw", F.expr(f"pmod(hash(__draw), {n})").alias("bucket")).collect()
    order = []
    for b in range(n):
        own = [r.doc_id for r in sorted((r for r in drawn if r.bucket == b), key=lambda r: r["__draw"])]
        rng = np.random.default_rng(np.frombuffer(hashlib.sha256(f"17 {b}".encode()).digest(), np.uint32))
        place, picks = list(range(len(own))), (rng.random(len(own)) * np.arange(1, len(own) + 1)).astype(int)
        for i in range(len(own) - 1, 0, -1):
            place[i], place[picks[i]] = place[picks[i]], place[i]
        order += [own[k] for k in place]
    bounds = [len(order) * s // 7 for s in range(8)]
    assert seen[0] == sorted((d, s, p - bounds[s]) for s in range(7) for p, d in enumerate(order) if bounds[s] <= p < bounds[s + 1])


def test_buckets_are_sized_by_whole_rows_and_repeated_rows_spread(spark):
    wide = spark.range(400).select("id", F.lit("short").alias("text"), F.repeat(F.lit("x"), 5000).alias("other"), F.array(F.lit("yy")).alias("more"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    path = shared_path(spark, "shards")
    shards.shuffle_to(wide, path, bucket_bytes=200_000)
    assert spark.read.parquet(path).select("__bucket").distinct().count() >= 8
    same = spark.range(900).select(F.lit(1).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the very same row")).otherwise(F.col("id").cast("string")).alias("text"))
    path = shared_path(spark, "shards")
    shards.shuffle_to(same, path, bucket_bytes=2000)
    back = spark.read.parquet(path)
    assert back.count() == 900 and back.where("text = 'the very same row'").select("__bucket").distinct().count() > 5


def test_fisher_yates_is_uniform():
    rng, seen = np.random.default_rng(8), {}
    for _ in range(6000):
        key = tuple(shards.fisher_yates(3, rng).tolist())
        seen[key] = seen.get(key, 0) + 1
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


# --- pipeline ---


def test_pipeline_stages_take_effect(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    found = decontaminate.PatternSet((r.item_id, r.text) for r in bench)
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = [r.doc_id for r in rows]
    assert len(kept) == len(set(kept)) and len(kept) > 0.5 * len(text)
    assert all(r.round_trip and r.n_ids == len(r["ids"]) for r in rows)
    assert not any(found.search(decontaminate.words_of(text[i]))[0] for i in kept)
    label = components([slow_fingerprint(text[i]) for i in kept])
    assert label == list(range(len(kept)))


def test_shards_digest_columns(spark):
    found = shards.op10_shards(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert all(r.size == len(r.text.encode()) + 8 and r.text_crc32 == zlib.crc32(r.text.encode()) for r in found)


# --- every stage and operator on odd tables ---

CLASHES = ["fp", "component_id", "hits", "items", "n_words", "toxic", "severity", "grade", "lang_pred", "score", "ids", "n_ids", "round_trip", "shard", "slot", "clean_text", "kept", "text_copy", "__kept", "root", "__lines", "__base", "__id", "__th"]


@pytest.fixture(scope="module")
def wild(spark, odd):
    frame = odd.select("doc_id", "text", "lang").withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    for c in CLASHES:
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("what", ["odd", "empty", "null"])
def test_stages_on_odd_tables(wild, spark, k, what):
    docs = {"odd": wild, "empty": wild.limit(0), "null": wild.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in wild.schema.fields])}[what]
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    rows = out.collect()
    assert len(rows) <= len(ODD) and (what != "empty" or not rows)
    if k < 4:
        assert out.columns == docs.columns
        assert all(r.score == "clash" for r in rows) or what == "null"


def test_operators_on_clashing_columns(spark, wild):
    text = {r.doc_id: r.text for r in wild.collect()}
    assert sorted(r.doc_id or 0 for r in quality.quality_rules(wild).collect()) == sorted(i or 0 for i, _ in ODD)
    assert simhash.near_duplicates(wild).count() == len(ODD)
    bench = spark.createDataFrame([(1, "a", "clash")], "item_id long, text string, hits string")
    found = {r.doc_id: r for r in decontaminate.find_benchmark(wild, bench).collect()}
    assert [i for i in found if found[i].hits] == [4] and found[6].n_words == 30_000
    made = shards.shard_documents(wild, shared_path(spark, "shards"), 3).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in made) == sorted((i or 0, t or "") for i, t in ODD) and {r.shard for r in made} == {0, 1, 2}
    assert {r.doc_id: r.decoded for r in pieces.decode_pieces(pieces.with_pieces(wild, pieces.model_path()), pieces.model_path()).collect()} == {i: t or "" for i, t in text.items()}


def test_empty_urls(spark):
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0
    assert {r.verdict for r in urls.filter_urls(spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string"), []).collect()} == {"allow"}


def test_a_text_that_many_rows_repeat(spark):
    hot = spark.range(3000).select((F.col("id") % 2000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text for a third of all rows").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    sizes = simhash.near_duplicates(hot).groupBy("fp").count()
    assert sizes.agg(F.sum("count"), F.max("count")).first()[:] == (3000, 1000)
    counted = tokencount.count_tokens(hot, shared_path(spark, "cache"), tokencount.TokenizerFile(pieces.model_path()))
    assert counted.count() == 3000 and counted.where("n_tokens IS NULL").count() == 0
