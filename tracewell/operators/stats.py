"""Order statistics, spike counts and scales."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.model import SMOOTH_RADIUS, PreprocConfig, round_half_away
from tracewell.session import materialize

PERCENT_STEPS = 10_000


def _order_keys(v: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers; NaN is the largest."""
    bits = (v + 0.0).view(np.int64)  # -0 counts as 0
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))).view(np.uint64)


def _cell_counts(values: DataFrame, known: int, bits: int, prefixes: np.ndarray | None) -> pa.Table:
    """(cell, n, lo, hi): how many values begin with the cell's `known + bits` bits, and the smallest and largest of them.

    Only values whose first `known` bits are among `prefixes` count. Tasks count what they read; cells, not values, are shuffled.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            cell, n, lo, hi = (np.concatenate(c) for c in zip(*held, strict=True))
            names, first, at = np.unique(cell, return_index=True, return_inverse=True)
            total, low, high = np.zeros(len(names), np.int64), lo[first], hi[first]
            np.add.at(total, at, n)
            np.fmin.at(low, at, lo)
            np.maximum.at(high, at, hi)
            return names, total, low, high

        for batch in it:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            keys = _order_keys(v)
            if prefixes is not None:
                own = keys >> np.uint64(64 - known)
                inside = prefixes[np.minimum(np.searchsorted(prefixes, own), len(prefixes) - 1)] == own
                v, keys = v[inside], keys[inside]
            order = np.argsort(keys, kind="stable")
            cells = (keys >> np.uint64(64 - known - bits))[order]
            if not len(cells):
                continue
            cut = np.append(0, np.flatnonzero(np.diff(cells)) + 1)
            held.append((cells[cut], np.diff(np.append(cut, len(cells))), v[order][cut], v[order][np.append(cut[1:], len(cells)) - 1]))
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [merged()]
        if held:
            cell, n, lo, hi = merged()
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(n), pa.array(lo), pa.array(hi)], names=["cell", "n", "lo", "hi"])

    counted = values.mapInArrow(run, "cell long, n long, lo double, hi double")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()


def at_ranks(values: DataFrame, wanted: DataFrame, column: str = "v", few: int = 1024) -> DataFrame:
    """`wanted(rank, ...)` with `value`: the value at that rank (from 0) of all values in ascending order; exact.

    Radix selection: the values, written once, are counted by their first bits, then those of the cells that hold
    a wanted rank by further bits. A cell that holds one value only is done, however many there are of it; the
    values of a cell of up to `few` are ranked by themselves at last. So no value is sorted or shuffled but those,
    and an often repeated one is no hot key. The driver gets the counts of cells: at most 2^16 of the first pass and
    2^8 for each of the ranks later on. Ranks beyond the values, null ranks and null values are left out; NaN is the largest.
    """
    spark = values.sparkSession
    held = materialize(values.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"), "values")
    ranks = np.unique(np.array([r[0] for r in wanted.where("rank IS NOT NULL").select("rank").distinct().collect()], np.int64))
    prefix, rest, done, small = np.zeros(len(ranks), np.uint64), ranks.copy(), [], {}
    known, at = 0, np.arange(len(ranks))  # the ranks that are still open
    for bits in (16, 8, 8, 8, 8, 8, 8):
        if not len(at):
            break
        table = _cell_counts(held, known, bits, np.unique(prefix[at]) if known else None)
        cell, n, lo, hi = (table.column(c).to_numpy() for c in ("cell", "n", "lo", "hi"))
        cell = cell.astype(np.int64).view(np.uint64)
        order = np.argsort(cell)
        cell, n, lo, hi = cell[order], n[order], lo[order], hi[order]
        below = np.concatenate(([0], np.cumsum(n)))
        start = np.searchsorted(cell, prefix[at] << np.uint64(bits)) if known else np.zeros(len(at), np.int64)
        place = np.searchsorted(below, below[start] + rest[at], side="right") - 1
        if not known:
            at, place = at[place < len(cell)], place[place < len(cell)]  # a rank beyond all values
            start = np.zeros(len(at), np.int64)
        rest[at] -= below[place] - below[start]
        prefix[at] = cell[place]
        known += bits
        one = (lo[place] == hi[place]) | (np.isnan(lo[place]) & np.isnan(hi[place])) | (known == 64)
        done += zip(ranks[at[one]].tolist(), lo[place[one]].tolist(), strict=True)
        tiny = ~one & (n[place] <= few)
        small.setdefault(known, []).extend(zip(ranks[at[tiny]].tolist(), prefix[at[tiny]].view(np.int64).tolist(), rest[at[tiny]].tolist(), strict=True))
        at = at[~one & ~tiny]
    found = spark.createDataFrame(done, "rank long, value double")
    for known, asked in small.items():
        if asked:
            cells = np.unique(np.array([c for _, c, _ in asked], np.int64).view(np.uint64))
            inside = held.mapInArrow(lambda it, known=known, cells=cells: _of_cells(it, known, cells), "cell long, value double")
            ranked = inside.withColumn("rest", F.row_number().over(Window.partitionBy("cell").orderBy("value")) - 1)
            found = found.unionByName(spark.createDataFrame(asked, "rank long, cell long, rest long").join(ranked, ["cell", "rest"]).select("rank", "value"))
    return wanted.join(found, "rank")


def _of_cells(it: Iterator[pa.RecordBatch], known: int, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cell, value) for the values of some cells."""
    for batch in it:
        v = batch.column(0).to_numpy(zero_copy_only=False)
        own = _order_keys(v) >> np.uint64(64 - known)
        inside = cells[np.minimum(np.searchsorted(cells, own), len(cells) - 1)] == own
        yield pa.RecordBatch.from_arrays([pa.array(own[inside].view(np.int64)), pa.array(v[inside])], names=["cell", "value"])


def percentile_table(trace: DataFrame, n_samples: int, n_rows: int, stride_above: int = 0) -> DataFrame:
    """(p, vmax), p = 0 .. 10000: the absolute value at rank floor(p (n - 1) / 10000).

    All samples count. With `stride_above=2_000_000`, as the reference's display has it, only every
    k-th one does above that many, in the order of rows and times. No samples: no rows.
    """
    stride = max(1, n_rows * n_samples // stride_above) if stride_above else 1
    if stride > 1:
        trace = trace.where((F.col("row_idx").cast("long") * n_samples + F.col("t")) % stride == 0)
    size = trace.agg(F.count("uv").alias("n"))
    steps = trace.sparkSession.range(PERCENT_STEPS + 1).select(F.col("id").cast("int").alias("p"))
    wanted = steps.join(F.broadcast(size), F.lit(True)).where("n > 0").select("p", F.expr(f"(p * (n - 1)) DIV {PERCENT_STEPS}").alias("rank"))
    return at_ranks(trace.select(F.abs("uv").alias("v")), wanted).select("p", F.col("value").alias("vmax"))


def nearest_rank_vmax(values: DataFrame, percents: Sequence[float], column: str = "mean_uv", floor: float = 1e-6) -> DataFrame:
    """(pct, vmax): the absolute value at rank round((n - 1) pct / 100), at least `floor`; 1 without values."""
    asked = values.sparkSession.createDataFrame([(float(p),) for p in percents], "pct double")
    size = values.agg(F.count(column).alias("n"))
    wanted = asked.join(F.broadcast(size), F.lit(True)).withColumn("rank", F.greatest(F.round((F.col("n") - 1) * F.least(F.greatest(F.col("pct") / 100, F.lit(0.0)), F.lit(1.0))), F.lit(0)).cast("long"))
    found = at_ranks(values.select(F.abs(column).alias("v")), wanted.select("pct", "rank"))
    return asked.join(found, "pct", "left").select("pct", F.when(F.col("value").isNull(), 1.0).otherwise(F.greatest("value", F.lit(floor))).alias("vmax"))


def table_vmax(table: DataFrame, percent: float, floor: float = 1.0) -> DataFrame:
    """(vmax): the percentile table's entry for a percentage, at least 1."""
    p = min(round_half_away(percent * 100), PERCENT_STEPS)
    return table.where(F.col("p") == p).select(F.greatest("vmax", F.lit(floor)).alias("vmax"))


def fixed_vmax(microvolts: float, current: bool = True, floor: float = 1.0, otherwise: float = 250.0) -> float:
    """The scale of a display with a fixed range; `otherwise` while the buffer belongs to another configuration."""
    return max(microvolts, floor) if current else otherwise


def greedy_count(times: Column, refractory: int) -> Column:
    """How many of the sorted times count if each counted one silences the next `refractory` samples."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    take = lambda a, t: a["last"].isNull() | (t - a["last"] > refractory)
    folded = F.aggregate(times, start, lambda a, t: F.struct(F.when(take(a, t), t).otherwise(a["last"]).alias("last"), (a["n"] + F.when(take(a, t), 1).otherwise(0)).alias("n")))
    return folded["n"]


def spike_function(hits: np.ndarray, refractory: int) -> tuple[np.ndarray, np.ndarray]:
    """What a span of samples does to the greedy count, for each row of `hits` (rows by samples, true where a spike may count).

    (counts, silent), rows by refractory + 1: entry d holds for a span whose first d samples are silenced how many
    spikes count and how many samples are silenced after its end.
    """
    rows, n = hits.shape
    after = np.where(hits, np.arange(n), n)
    after = np.concatenate((np.minimum.accumulate(after[:, ::-1], 1)[:, ::-1], np.full((rows, refractory + 2), n)), 1)  # the next hit from here on
    enter = np.arange(refractory + 1)
    counts, silent = np.zeros((rows, refractory + 1), np.int64), np.tile(np.maximum(enter - n, 0), (rows, 1))
    at = after[:, np.minimum(enter, n)]
    while (inside := at < n).any():
        counts += inside
        silent = np.where(inside, np.maximum(at + refractory + 1 - n, 0), silent)
        at = np.where(inside, np.take_along_axis(after, np.minimum(at + refractory + 1, n), 1), n)
    return counts, silent


def composed(functions: DataFrame, fan_in: int = 256) -> DataFrame:
    """(row_idx, n): the counts of whole rows from (row_idx, t0, n, counts, silent), spans that follow one another.

    A function of a span is composed with that of the next one; composition is associative, so up to `fan_in`
    neighbours are put together at a time, until a row has one. A gap between spans uses up silence.
    """
    held = functions.select("row_idx", "t0", (F.col("t0") + F.col("n")).alias("t1"), "counts", "silent")
    held = materialize(held.withColumn("i", F.row_number().over(Window.partitionBy("row_idx").orderBy("t0")) - 1), "functions")
    most = held.agg(F.max("i")).first()[0]

    def put(acc: Column, x: Column) -> Column:
        place = lambda e: F.greatest(e - (x["t0"] - acc["t1"]), F.lit(0)).cast("int")
        counts = F.zip_with(acc["counts"], acc["silent"], lambda c, e: c + F.get(x["counts"], place(e)))
        return F.struct(acc["t0"].alias("t0"), x["t1"].alias("t1"), counts.alias("counts"), F.transform(acc["silent"], lambda e: F.get(x["silent"], place(e))).alias("silent"))

    while most:
        together = held.groupBy("row_idx", F.expr(f"i DIV {fan_in}").alias("i")).agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "counts", "silent"))).alias("all"))
        folded = F.aggregate(F.slice("all", 2, fan_in), F.get("all", F.lit(0)), put)
        held, most = together.select("row_idx", "i", folded.alias("f")).select("row_idx", "i", "f.*"), most // fan_in
    return held.select("row_idx", F.get("counts", F.lit(0)).alias("n"))


def _with_markers(counted: DataFrame, rows: DataFrame) -> DataFrame:
    shown = rows.select("disp_idx", F.col("data_idx").alias("row_idx"))
    return shown.join(counted, "row_idx", "left").select("disp_idx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def spike_count(trace: DataFrame, rows: DataFrame, threshold: float, refractory: int, first: int | None = None, n: int | None = None, span: int = 1 << 14) -> DataFrame:
    """(disp_idx, n) for every display row: samples below the threshold, refractory ones skipped; markers have 0.

    The test is on the level: a long dip counts again after each refractory span. Times below the threshold
    are gathered per row and `span` samples; the counts of spans depend on the ones before and are composed.
    """
    seen = trace.where(F.col("uv") < threshold)
    if first is not None:
        seen = seen.where(F.col("t").between(first, first + n - 1))
    spans = seen.groupBy("row_idx", F.expr(f"t DIV {span} * {span}").cast("long").alias("t0")).agg(F.collect_list(F.col("t").cast("long")).alias("times"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts, silent = [], []
            for t0, times in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                hits = np.zeros((1, span), bool)
                hits[0, times.values.to_numpy() - t0] = True
                c, e = spike_function(hits, refractory)
                counts.append(c[0].tolist())
                silent.append(e[0].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([span] * batch.num_rows, pa.int64()), pa.array(counts, pa.list_(pa.int64())), pa.array(silent, pa.list_(pa.int64()))], names=["row_idx", "t0", "n", "counts", "silent"])

    return _with_markers(composed(spans.mapInArrow(run, FUNCTION)), rows)


FUNCTION = "row_idx int, t0 long, n long, counts array<long>, silent array<long>"


def spike_count_tiles(done: DataFrame, rows: DataFrame, threshold: float, refractory: int, first: int | None = None, n: int | None = None, kind: str = "<f4", at_once: int = 64) -> DataFrame:
    """`spike_count` of preprocessed tiles (t0, n, y): a task passes on one function for each row of a tile, whatever the number of spikes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                y = np.frombuffer(row["y"], kind).reshape(-1, row["n"])
                t = np.arange(row["t0"], row["t0"] + row["n"])
                inside = np.ones(len(t), bool) if first is None else (t >= first) & (t < first + n)
                parts = [spike_function((y[lo : lo + at_once] < threshold) & inside, refractory) for lo in range(0, len(y), at_once)]
                counts, silent = (np.concatenate(p).tolist() for p in zip(*parts, strict=True)) if parts else ([], [])
                same = lambda v, many=len(y): pa.array([v] * many, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(y), dtype=np.int32)), same(row["t0"]), same(row["n"]), pa.array(counts, pa.list_(pa.int64())), pa.array(silent, pa.list_(pa.int64()))], names=["row_idx", "t0", "n", "counts", "silent"])

    return _with_markers(composed(done.select("t0", "n", "y").mapInArrow(run, FUNCTION)), rows)


def spike_smooth(counts: DataFrame, sigma: float) -> DataFrame:
    """`counts` with `smoothed`: a 7-tap Gaussian over display rows, markers included as zeros, renormalised at the ends."""
    s = max(sigma, 0.01)
    other = counts.select(F.col("disp_idx").alias("j"), F.col("n").alias("m"))
    near = counts.select("disp_idx", "n", F.explode(F.expr(f"sequence(disp_idx - {SMOOTH_RADIUS}, disp_idx + {SMOOTH_RADIUS})")).alias("j")).join(other, "j")
    w = F.exp(-((F.col("j") - F.col("disp_idx")) ** 2) / (2.0 * s * s))
    return near.groupBy("disp_idx", "n").agg((F.sum(w * F.col("m")) / F.sum(w)).alias("smoothed"))


def overlay_width(smoothed: DataFrame, threshold: float, view_s: float, scale: float, max_x: float) -> DataFrame:
    """`smoothed` with `width`: the overlay's extent for a threshold, a view length and a user's factor."""
    factor = abs(threshold) / 20.0 * (0.5 / view_s) * scale
    return smoothed.withColumn("width", F.least(F.col("smoothed") * factor, F.lit(float(max_x))))


def trace_scale(values: DataFrame, column: str = "mean_uv", by: Sequence[str] = ()) -> DataFrame:
    """(*by, scale): the largest absolute value, at least 1e-6."""
    return values.groupBy(*by).agg(F.greatest(F.coalesce(F.max(F.abs(column)), F.lit(0.0)), F.lit(1e-6)).alias("scale"))


def spikes_of(trace: DataFrame, rows: DataFrame, cfg: PreprocConfig, threshold: float = -20.0, sigma: float = 1.5) -> DataFrame:
    """Counts and smoothed counts with the configuration's refractory time."""
    return spike_smooth(spike_count(trace, rows, threshold, cfg.refractory), sigma)
