"""Radix selection and composable spike counts against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import stats


def plain_count(times, refractory):
    last, n = None, 0
    for t in sorted(times):
        if last is None or t - last > refractory:
            last, n = t, n + 1
    return n


@pytest.mark.parametrize("refractory", [0, 1, 4, 45])
def test_functions_of_spans_compose_to_the_greedy_count(refractory):
    rng = random.Random(refractory)
    for share in (0.02, 0.3, 0.95, 1.0):
        n = rng.randrange(60, 400)
        hits = np.array([[rng.random() < share for _ in range(n)] for _ in range(3)])
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(6))})  # spans shorter than the refractory time too
        for r in range(3):
            d = total = 0
            for lo, hi in zip(cuts, cuts[1:]):
                counts, silent = stats.spike_function(hits[:, lo:hi], refractory)
                total, d = total + counts[r, d], silent[r, d]
            assert total == plain_count(np.flatnonzero(hits[r]).tolist(), refractory)


@pytest.mark.parametrize("span, fan_in", [(64, 2), (7, 3), (1 << 14, 256)])
def test_spike_count_of_long_rows(spark, monkeypatch, span, fan_in):
    monkeypatch.setattr(stats.composed, "__defaults__", (fan_in,))
    rng = random.Random(2)
    times = {0: [t for t in range(5000) if rng.random() < 0.4], 1: [3, 8, 9, 4000], 2: list(range(900, 2000))}
    trace = spark.createDataFrame([(r, t, -30.0 if t in set(v) else 0.0) for r, v in times.items() for t in (v + [2])], "row_idx int, t long, uv double")
    rows = spark.createDataFrame([(0, 0), (1, 1), (2, None), (3, 2), (4, 3)], "disp_idx int, data_idx int")
    for refractory in (0, 4, 45):
        got = {r.disp_idx: r.n for r in stats.spike_count(trace, rows, -20.0, refractory, span=span).collect()}
        assert got == {0: plain_count(times[0], refractory), 1: plain_count(times[1], refractory), 2: 0, 3: plain_count(times[2], refractory), 4: 0}
    some = {r.disp_idx: r.n for r in stats.spike_count(trace, rows, -20.0, 4, 950, 1000, span).collect()}
    assert some[3] == plain_count(range(950, 1950), 4)


def test_a_very_long_row_is_a_few_numbers_per_span(spark):
    """A spike at every sample of 10^8 (made span by span): no time is ever gathered."""
    span, n = 1 << 16, 100_000_000

    def run(it):
        import pyarrow as pa

        counts, silent = stats.spike_function(np.ones((1, span), bool), 45)
        for batch in it:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column(0), pa.array([span] * k), pa.array([counts[0].tolist()] * k, pa.list_(pa.int64())), pa.array([silent[0].tolist()] * k, pa.list_(pa.int64()))], names=["row_idx", "t0", "n", "counts", "silent"])

    made = spark.range(n // span).select((F.col("id") * span).alias("t0")).mapInArrow(run, stats.FUNCTION)
    assert stats.composed(made).first().n == -(-(n // span * span) // 46)


CASES = {
    "hot": [0.0] * 9000 + [float(i) for i in range(1, 1001)],
    "spread": [random.Random(1).gauss(0, 1) * 10 ** random.Random(i).randrange(-9, 9) for i in range(3000)],
    "close": [1.0 + i * 2.0**-52 for i in range(2500)] * 2,
    "odd": [float("nan"), float("inf"), -float("inf"), -0.0, 0.0, 5e-324, -5e-324, None, 1.0],
    "one": [7.5],
}


@pytest.mark.parametrize("name", CASES)
def test_ranks_by_radix_selection(spark, name):
    values = CASES[name]
    kept = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ranks = sorted({0, len(kept) // 3, len(kept) // 2, len(kept) - 2, len(kept) - 1, len(kept), *random.Random(4).choices(range(len(kept)), k=60)} - {-1})
    wanted = spark.createDataFrame([(r, "x") for r in [*ranks, None]], "rank long, name string")
    for few in (0, 16, 1024):
        got = {r.rank: r.value for r in stats.at_ranks(frame, wanted, few=few).collect()}
        assert repr({k: got[k] + 0.0 for k in sorted(got)}) == repr({r: kept[r] + 0.0 for r in ranks if r < len(kept)})


def test_ranks_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert stats.at_ranks(empty, spark.createDataFrame([(0,)], "rank long")).count() == 0
    assert stats.at_ranks(spark.createDataFrame([(1.0,)], "v double"), spark.createDataFrame([], "rank long")).count() == 0
