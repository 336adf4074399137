"""Properties of the operators, their edges, and the tile form against the relational one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import fixtures_rec as rec
from tracewell.model import PreprocConfig, sample_of, view_sample
from tracewell.operators import events, geometry, render, signal, stats, tiles
from tracewell.plans import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trace(spark):
    return signal.depth_average(rec.samples(spark, SF), geometry.display_rows(rec.channels(spark), False)).where("t < 300").cache()


@pytest.fixture(scope="module")
def rows(spark):
    return geometry.display_rows(rec.channels(spark), False).cache()


def matrix(df, n):
    x = np.full((20, n), np.nan)
    for r in df.collect():
        x[r.row_idx, r.t] = r.uv
    return x


def test_dc_and_medians_vanish(trace):
    assert np.allclose(matrix(signal.dc_removal(trace), 300).mean(1), 0)
    x = matrix(signal.cmr_global(trace), 300)
    assert np.allclose(np.median(x[:10], 0), 0) and np.allclose(np.median(x[10:], 0), 0)


def test_gain_has_its_floor_and_truncated_spans(trace):
    cfg = PreprocConfig(rec.RATE)
    x = matrix(trace, 300)
    got = matrix(signal.agc_gain(trace, cfg).withColumn("uv", F.col("gain")), 300)
    want = np.array([[np.abs(r[max(0, t - 50) : t + 51]).mean() for t in range(300)] for r in x])
    floor = np.repeat([x[:10].std() * 0.003, x[10:].std() * 0.003], 10)[:, None]
    assert np.allclose(got, np.maximum(want, floor))


def test_keys_keep_windows_apart(trace, rows):
    cfg = PreprocConfig(rec.RATE, avg_depths=False)
    both = trace.where("t < 100").withColumn("w", F.lit(0)).unionByName(trace.where("t BETWEEN 100 AND 199").withColumn("w", F.lit(1)))
    for kind in ("global_cmr", "local_cmr", "destripe"):
        c = cfg.with_(spatial=kind)
        apart = signal.preprocess(both, rows, c, ("w",)).where("w = 1").drop("w")
        alone = signal.preprocess(trace.where("t BETWEEN 100 AND 199"), rows, c)
        a, b = (sorted((r.row_idx, r.t, r.uv) for r in d.collect()) for d in (apart, alone))
        assert np.allclose(a, b)


def test_empty_trace(trace, rows):
    cfg = PreprocConfig(rec.RATE, spatial="destripe")
    assert signal.preprocess(trace.limit(0), rows, cfg).count() == 0
    assert stats.percentile_table(trace.limit(0), 0, 20).count() == 0
    assert [r.vmax for r in stats.nearest_rank_vmax(trace.limit(0).withColumnRenamed("uv", "mean_uv"), [50.0]).collect()] == [1.0]
    assert render.bin_means(trace.limit(0), 0, 10, 5).count() == 0


def test_percentile_ranks_are_exact(spark):
    values = np.random.default_rng(1).normal(size=1237)
    trace = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "row_idx int, t long, uv double")
    table = {r.p: r.vmax for r in stats.percentile_table(trace, 1237, 1).collect()}
    ordered = np.sort(np.abs(values))
    assert len(table) == 10_001 and all(table[p] == ordered[p * 1236 // 10_000] for p in range(10_001))


def test_percentile_stride(spark):
    trace = spark.range(1000).select(F.lit(0).alias("row_idx"), F.col("id").alias("t"), F.col("id").cast("double").alias("uv"))
    table = {r.p: r.vmax for r in stats.percentile_table(trace, 1000, 1, stride_above=100).collect()}
    assert table[10_000] == 990.0 and table[0] == 0.0


def test_greedy_refractory(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 400)) * 20
    trace = spark.createDataFrame([(0, i, t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r)], "shank int, row_idx int, t long, uv double")
    shown = spark.createDataFrame([(i, i) for i in range(4)] + [(4, None)], "disp_idx int, data_idx int")
    got = {r.disp_idx: r.n for r in stats.spike_count(trace, shown, -10.0, 5).collect()}
    for i, r in enumerate(x):
        last, n = None, 0
        for t, v in enumerate(r):
            if v < -10 and (last is None or t - last > 5):
                last, n = t, n + 1
        assert got[i] == n
    assert got[4] == 0


def test_anchored_depth_groups(spark):
    # 0, 0.4, 0.8: the third is 0.8 from the group's first depth, so it opens a group although 0.4 from the second
    channels = spark.createDataFrame([(0, 1.0, 0.0, 0), (1, 2.0, 0.4, 0), (2, 3.0, 0.8, 0), (3, None, None, None)], "ch int, x_um double, y_um double, shank int")
    got = [(list(r.channels), r.first_ch, r.y_um) for r in geometry.depth_groups(channels, True).orderBy("data_idx").collect()]
    assert got == [([0, 1, 3], 0, 0.0), ([2], 2, 0.8)]


def test_selection_renumbers(spark, rows):
    got = geometry.select_rows(rows, 100, 250).orderBy("disp_idx").collect()
    data = [r for r in got if r.kind == "data"]
    assert [r.data_idx for r in data] == list(range(len(data))) and data[0].full_idx == data[0].first_ch // 19


def test_event_windows():
    assert events.EventWindow.of(-50, 200, 30_000) == events.EventWindow(-1500, 7500, 4500)
    for bad in ((5, 5), (0, 1e-6)):
        with pytest.raises(ValueError):
            events.EventWindow.of(*bad, 1000)
    assert sample_of(0.0005, 1000) == 1 and view_sample(0.0009, 1000) == 0 and sample_of(-0.0005, 1000) == -1


@pytest.mark.parametrize("kind", ["global_cmr", "local_cmr", "destripe", "off"])
def test_event_average_equals_its_relational_form(spark, kind):
    cfg = PreprocConfig(rec.RATE, spatial=kind, phase_shift=True)
    rows, stims = geometry.display_rows(rec.channels(spark), True), rec.stims(spark, SF)
    got = {(r.data_idx, r.k): r.mean_uv for r in events.event_average(rec.samples(spark, SF), rows, stims, cfg, 1600, -5, 20, 100, 300).collect()}
    w = events.EventWindow.of(-5, 20, rec.RATE)
    placed = events.place_windows(stims, w, rec.RATE, 1600)
    cut = events.cut_windows(signal.depth_average(rec.samples(spark, SF), rows), placed, w).select("stim_idx", "shank", "row_idx", "t", "uv")
    done = signal.preprocess(cut, rows, cfg, ("stim_idx",)).join(placed.where("valid"), "stim_idx").withColumn("k", (F.col("t") - F.col("read_first") - w.pad).cast("int"))
    chosen = geometry.select_rows(rows, 100, 300).where("data_idx IS NOT NULL").select("data_idx", F.col("full_idx").alias("row_idx"))
    want = done.where(F.col("k").between(0, w.n - 1)).join(chosen, "row_idx").groupBy("data_idx", "k").agg(F.avg("uv").alias("v")).collect()
    assert got.keys() == {(r.data_idx, r.k) for r in want} and all(np.isclose(got[r.data_idx, r.k], r.v) for r in want)


def test_percentiles_of_many_samples_use_all(spark):
    n = 4_000_000
    trace = spark.range(n).select(F.lit(0).alias("row_idx"), F.col("id").alias("t"), (F.col("id") % 2).cast("double").alias("uv"))
    table = {r.p: r.vmax for r in stats.percentile_table(trace, n, 1).collect()}
    assert table[0] == 0 and table[10_000] == 1


def test_repeated_stimuli_count_twice(spark, rows):
    cfg = PreprocConfig(rec.RATE, avg_depths=False, highpass=False)
    stims = spark.createDataFrame([(0, 0.4), (1, 0.4), (2, 0.6), (3, 0.0)], "stim_idx long, onset_s double")
    got = events.event_average(rec.samples(spark, SF), rows, stims, cfg, 1600, -5, 20)
    one, two = (events.event_average(rec.samples(spark, SF), rows, stims.where(f"stim_idx = {i}"), cfg, 1600, -5, 20) for i in (0, 2))
    value = lambda d: {(r.data_idx, r.k): r.mean_uv for r in d.collect()}
    a, b, c = value(got), value(one), value(two)
    assert a.keys() == b.keys() and all(np.isclose(a[k], (2 * b[k] + c[k]) / 3) for k in a)


@pytest.mark.parametrize("kind", ["off", "global_cmr", "local_cmr", "destripe"])
def test_tiles_equal_the_whole(spark, kind):
    n, cfg = 1600, PreprocConfig(rec.RATE, spatial=kind, phase_shift=True, avg_depths=False)
    channels = rec.channels(spark).withColumn("ch", (F.col("ch") / 19).cast("int"))
    rows = geometry.display_rows(channels, False)
    samples = rec.samples(spark, SF).select((F.col("ch") / 19).cast("int").alias("ch"), "t", (F.rint(F.col("uv") / 0.01) * 0.01).alias("uv"))
    done = tiles.preprocess_tiles(tiles.tiles_of(samples, 20, n, 500, 0.01), rows, cfg, 0.01, halo=400, kind="<f8")
    got = matrix(tiles.explode_tiles(done, tiles.RowModel.of(rows), "<f8"), n)
    want = matrix(signal.preprocess(signal.depth_average(samples, rows), rows, cfg), n)
    assert np.allclose(got, want, atol=1e-6)


def test_window_policies():
    assert windows.full_span(300, 500, 1600) == (0, 1000) and windows.full_span(1500, 500, 1600) == (1000, 600)
    assert windows.half_window(30.0, 30_000.0) == 450_000
    e = windows.plan_extension((0, 900_000), True, 150_000, (500_000, 15_000), 2_000_000, 900_000)
    assert (e.read_first, e.read_n, e.keep_first, e.keep_n, e.drop) == (898_000, 152_000, 900_000, 150_000, 150_000)
    e = windows.plan_extension((100, 900), False, 500, (150, 100), 5000, 10_000)
    assert (e.read_first, e.read_n, e.keep_first, e.keep_n, e.drop) == (0, 1000, 0, 100, 0)
    assert windows.plan_extension((0, 10), False, 5, (0, 5), 10, 10) is None
    assert windows.trim(900, 150, 900, 10_000, False) == 150 and windows.trim(100, 150, 900, 10_000, True) == 100
    assert windows.wanted_side((100, 800), (150, 700), 100, 1000) == "left" and windows.wanted_side((0, 800), (0, 750), 100, 1000) == "right"
    assert windows.wanted_side((0, 1000), (0, 1000), 100, 1000) is None
    assert windows.under_pressure(100, 14) and windows.most_margin_s(1, 0.5) == 0.5
    assert windows.clamp_length(99) == 10.0 and windows.step_view(9.9, 1.0, 10.0, 1, 0.5) == 9.0


def test_navigation_labels(spark):
    assert [r.label for r in render.nav_labels(spark, 80.0).orderBy("i").collect()] == [f"{10 * i}s" for i in range(9)]


def test_scales():
    assert render.scale_bar(0.5, 800) == (80.0, "50 ms")
    assert stats.fixed_vmax(0.2) == 1.0 and stats.fixed_vmax(300.0) == 300.0 and stats.fixed_vmax(300.0, current=False) == 250.0


def test_latest_only(spark):
    assert windows.latest_only(spark, "view", lambda: spark.range(5).count()) == 5


def test_tiles_that_would_come_out_wrong_raise(spark):
    cut = spark.createDataFrame([(0, 100, bytearray(200)), (100, 100, bytearray(200)), (200, 30, bytearray(60))], "t0 long, n int, x binary")
    assert tiles.with_halo(cut, 100).count() == 3
    with pytest.raises(ValueError, match="shorter than the halo"):
        tiles.with_halo(cut, 101)
    with pytest.raises(ValueError, match="gaps"):
        tiles.with_halo(cut.where("t0 <> 100"), 50)
    assert 900 < tiles.halo_of(PreprocConfig(30_000.0)) < 1200 and tiles.halo_of(PreprocConfig(30_000.0, highpass=False)) == 1


def test_missing_samples_of_a_time(trace, rows):
    some = trace.where("t < 20 AND NOT (t = 3 AND row_idx = 2)")
    x = matrix(trace.where("t < 20"), 20)
    got = {(r.row_idx, r.t): r.uv for r in signal.cmr_local(some, rows).collect()}
    assert len(got) == x.size - 1
    near = {r.data_idx: [j for j in r.others] for r in geometry.neighbours(rows, 100.0, 400.0).collect()}
    for i, others in near.items():
        if i != 2:
            assert np.isclose(got[i, 3], x[i, 3] - np.median([x[j, 3] for j in others if j != 2]))


def test_a_newer_plan_of_a_slot_cancels_the_one_that_runs(spark):
    import threading
    import time

    from pyspark import InheritableThread

    ended = []

    def slow():
        try:
            windows.latest_only(spark, "view", lambda: spark.range(1 << 40).selectExpr("max(crc32(cast(id AS string)))").collect())
            ended.append("finished")
        except Exception as e:
            ended.append(str(e))

    thread = InheritableThread(target=slow)
    thread.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds():
        time.sleep(0.1)
    assert windows.latest_only(spark, "view", lambda: spark.range(5).count()) == 5
    thread.join(30)
    spark.sparkContext.cancelAllJobs()  # should the other still run
    assert isinstance(thread, threading.Thread) and not thread.is_alive() and ended and "cancel" in ended[0].lower()
