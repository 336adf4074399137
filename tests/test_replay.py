"""Sessions replayed from requests."""

import random

from pyspark.sql import functions as F

from tracewell.plans import windows

POLICY = windows.ViewPolicy(rate=1000.0, n_samples=100_000, n_rows=4, total_bytes=1 << 33, reserve=1 << 20, view_s=0.5, buffer_s=20.0, margin_s=3.0)
KINDS = "who long, i long, jump_s double, steps double, share double, zoom double, available long, n string"


def requests(seed, many=200):
    rng = random.Random(seed)
    return [(u, i, rng.choice([None, None, None, rng.uniform(-5, 130)]), rng.choice([-3.0, 1.0, 8.0]), rng.choice([0.05, 0.3, 0.5]), rng.choice([1.0, 1.0, 2.0, 0.5]), rng.choice([0, 1 << 21, 1 << 32]), "clash") for u in (1, 2, None) for i in range(many)]


def test_replay_equals_a_plain_loop(spark):
    rows = requests(3)
    frame = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), KINDS).repartition(7)
    got = {(r.who, r.i): tuple(r)[2:] for r in windows.replay(frame, POLICY, "who", ["i"]).collect()}
    session, seen = {}, set()
    for who, i, *request, _ in rows:
        s = windows.after_request(session.get(who, windows.Session(0.0, 0.5)), POLICY, *request)
        session[who] = s
        seen.add(s.action)
        assert got[who, i] == (s.start_s, s.view_s, s.first, s.n, s.action, s.dropped)
        # a buffer holds its view, lies in the recording and never loses what is near the view
        assert 0 <= s.first and s.first + s.n <= POLICY.n_samples
        if s.action == "full":
            assert s.first <= int(s.start_s * 1000) and int(s.start_s * 1000) + int(s.view_s * 1000) <= s.first + s.n or s.view_s * 1000 > s.n
    assert seen == {None, "full", "left", "right"} and len(got) == len(rows)


def test_replay_of_nothing(spark):
    assert windows.replay(spark.createDataFrame([], KINDS), POLICY, "who", ["i"]).count() == 0


def test_policies_of_columns_equal_those_of_numbers(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(900), rng.randrange(1, 900), rng.randrange(1500), rng.randrange(1, 300), rng.randrange(500), rng.randrange(-90, 900), rng.random() < 0.5, rng.uniform(0, 70), rng.uniform(0, 12), rng.choice([-3.0, 1.0])) for _ in range(300)]
    frame = spark.createDataFrame(rows, "first long, n long, v long, vn long, m long, head long, press boolean, start double, view double, steps double")
    c = F.col
    made = frame.select(
        "*",
        windows.wanted_side_of(c("first"), c("n"), c("v"), c("vn"), c("m"), F.lit(1200)).alias("side"),
        windows.trim_of(c("n"), c("m"), c("v"), c("head"), c("press")).alias("drop"),
        windows.under_pressure_of(c("n") * (1 << 30), c("m") * (1 << 28)).alias("tight"),
        windows.most_buffer_of(c("m") * (1 << 24), 1 << 26, c("vn"), 1000.0).alias("buffer"),
        windows.most_margin_of(c("start"), c("view")).alias("margin"),
        windows.step_view_of(c("start"), c("view"), 60.0, c("steps"), F.lit(0.3)).alias("moved"),
        windows.clamp_length_of(c("view")).alias("length"),
    )
    for r in made.collect():
        assert r.side == windows.wanted_side((r.first, r.n), (r.v, r.vn), r.m, 1200)
        assert r["drop"] == windows.trim(r.n, r.m, r.v, r["head"], r.press)
        assert r.tight == windows.under_pressure(r.n << 30, r.m << 28)
        assert r.buffer == windows.most_buffer_s(r.m << 24, 1 << 26, r.vn, 1000.0) and r.margin == windows.most_margin_s(r.start, r.view)
        assert r.moved == windows.step_view(r.start, r.view, 60.0, r.steps, 0.3) and r.length == windows.clamp_length(r.view)
