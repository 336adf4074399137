"""Event-aligned averages: the preprocessed signal around each stimulus, averaged over stimuli."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.model import AGC_EPSILON, PSTH_PAD_S, PreprocConfig, round_half_away
from tracewell.operators.geometry import select_rows
from tracewell.operators.signal import depth_average
from tracewell.operators.tiles import RowModel, spatial, temporal
from tracewell.sources.recording import reader_of


@dataclass(frozen=True)
class EventWindow:
    """A window around an onset in samples, with the margin that the filters need."""

    start: int
    n: int
    pad: int

    @staticmethod
    def of(start_ms: float, end_ms: float, rate: float) -> EventWindow:
        if end_ms <= start_ms:
            raise ValueError(f"window end {end_ms} ms: not after its start {start_ms} ms")
        first, last = round_half_away(start_ms / 1000.0 * rate), round_half_away(end_ms / 1000.0 * rate)
        if last == first:
            raise ValueError(f"window of {end_ms - start_ms} ms: shorter than a sample at {rate} Hz")
        return EventWindow(first, last - first, round_half_away(PSTH_PAD_S * rate))


def filter_stims(stims: DataFrame, t_start: float, t_end: float) -> DataFrame:
    """Stimuli with an onset in [t_start, t_end], both ends included."""
    return stims.where(F.col("onset_s").between(t_start, t_end))


def onset_sample(onset_s: Column, rate: float) -> Column:
    return F.round(onset_s * rate).cast("long")  # halves away from zero


def place_windows(stims: DataFrame, window: EventWindow, rate: float, n_samples: int) -> DataFrame:
    """`stims` with `onset`, `read_first` and `valid`: whether the padded window lies inside the recording."""
    placed = stims.withColumn("onset", onset_sample(F.col("onset_s"), rate)).withColumn("read_first", F.col("onset") + window.start - window.pad)
    return placed.withColumn("valid", (F.col("read_first") >= 0) & (F.col("read_first") + window.n + 2 * window.pad <= n_samples))


def window_counts(placed: DataFrame, window: EventWindow, start_ms: float, rate: float) -> DataFrame:
    """One row (n_win, start_ms, dt_ms, n_used, n_skipped)."""
    return placed.agg(
        F.lit(window.n).alias("n_win"),
        F.lit(float(start_ms)).alias("start_ms"),
        F.lit(1000.0 / rate).alias("dt_ms"),
        F.count_if("valid").alias("n_used"),
        F.count_if(~F.col("valid")).alias("n_skipped"),
    )


def cut_windows(samples: DataFrame, placed: DataFrame, window: EventWindow) -> DataFrame:
    """(stim_idx, k, ...) for each sample in each valid padded window; k counts from the window's onset offset.

    Windows and samples meet on tiles of the time axis, about as long as a window: an equality join, of
    which each window takes part in as many tiles as it touches. Stimuli at the same time stay apart by
    stim_idx.
    """
    span = window.n + 2 * window.pad
    tile = max(64, span)
    wanted = placed.where("valid").select("stim_idx", "read_first", F.explode(F.expr(f"sequence(read_first DIV {tile}, (read_first + {span - 1}) DIV {tile})")).alias("tile"))
    own = samples.withColumn("tile", F.expr(f"t DIV {tile}"))
    inside = own.join(wanted, "tile").where((F.col("t") >= F.col("read_first")) & (F.col("t") < F.col("read_first") + span))
    return inside.withColumn("k", (F.col("t") - F.col("read_first") - window.pad).cast("int")).drop("tile", "read_first")


def distinct_windows(placed: DataFrame) -> DataFrame:
    """(read_first, weight): each place at which valid windows begin, once, and how many of them do."""
    return placed.where("valid").groupBy("read_first").agg(F.count("*").alias("weight"))


class _Averager:
    """Weighted sums of preprocessed windows, as array slices of a span of averaged rows; only the sums stay."""

    def __init__(self, model: RowModel, cfg: PreprocConfig, window: EventWindow, at_once: int = 64):
        self.model, self.cfg, self.window, self.at_once = model, cfg, window, at_once
        self.span, self.height = window.n + 2 * window.pad, len(model.shank)
        self.total, self.m = np.zeros((self.height, window.n)), 0

    def add(self, x: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> None:
        """Windows that begin at the columns `starts` of x (rows by samples)."""
        w = self.window
        for lo in range(0, len(starts), self.at_once):
            for start, weight in zip(starts[lo : lo + self.at_once].tolist(), weights[lo : lo + self.at_once].tolist(), strict=True):
                own = x[:, start : start + self.span]
                y = temporal(own, self.model, self.cfg, own.mean(1), True)
                floors = {a: max(AGC_EPSILON * float(y[a:b].std()), 1e-8) for a, b in self.model.blocks()}
                self.total += weight * spatial(y, self.model, self.cfg, floors, w.pad, w.pad + w.n)
                self.m += weight

    def sums(self) -> Iterator[pa.RecordBatch]:
        if self.m:
            r, k = np.divmod(np.arange(self.total.size), self.window.n)
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(self.total.ravel()), pa.array(np.full(self.total.size, self.m))], names=["row_idx", "k", "s", "m"])


_SUMS = "row_idx int, k int, s double, m long"


def _tile_sums(averaged: DataFrame, placed: DataFrame, rows: DataFrame, cfg: PreprocConfig, window: EventWindow) -> DataFrame:
    """(row_idx, k, s, m) per task, from samples (row_idx, t, uv).

    A tile of the time axis is as long as a window. Its task gets the windows that begin in it, each place
    once, and the samples that these need, those of the tile and of the next one: so each sample is shuffled
    twice however many windows it is in. A tile's data are bounded, whatever the number of stimuli.
    """
    model = RowModel.of(rows)
    span = window.n + 2 * window.pad
    size, height = max(64, span), len(model.shank)
    starts = distinct_windows(placed).select(F.expr(f"read_first DIV {size}").alias("tile"), F.lit(0).alias("kind"), F.col("read_first").alias("t"), F.col("weight").alias("i"), F.lit(0.0).alias("uv"))
    tiles = F.when(F.col("t") % size < span, F.array(F.expr(f"t DIV {size}"), F.expr(f"t DIV {size} - 1"))).otherwise(F.array(F.expr(f"t DIV {size}")))
    samples = averaged.select(F.explode(tiles).alias("tile"), F.lit(1).alias("kind"), "t", F.col("row_idx").cast("long").alias("i"), "uv")
    touched = starts.select("tile").distinct()
    dealt = starts.unionByName(samples.join(touched, "tile", "left_semi")).repartition("tile").sortWithinPartitions("tile", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Averager(model, cfg, window)
        tile, held = None, []

        def finish() -> None:
            if tile is None:
                return
            kind, t, i, uv = (np.concatenate(c) for c in zip(*held, strict=True))
            head = kind == 0
            x = np.zeros((height, 2 * size))  # a sample that is not there counts as 0
            x[i[~head], t[~head] - tile * size] = np.nan_to_num(uv[~head])
            found.add(x, t[head] - tile * size, i[head])

        for batch in batches:
            names, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(names)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
                if lo < hi and names[lo] != tile:
                    finish()
                    tile, held = int(names[lo]), []
                held.append([c[lo:hi] for c in columns])
        finish()
        yield from found.sums()

    return dealt.mapInArrow(run, _SUMS)


def _file_sums(reader, placed: DataFrame, rows: DataFrame, cfg: PreprocConfig, window: EventWindow, scale: float, size: int) -> DataFrame:
    """(row_idx, k, s, m) per task, from a file: `reader.samples(first, last)` gives samples by channels.

    A row is a tile of the time axis with the places at which windows begin in it. A tile without any has no
    row, so its samples are never read; of the others a task reads what their windows cover, once.
    """
    model = RowModel.of(rows)
    span = window.n + 2 * window.pad
    starts = distinct_windows(placed).withColumn("tile", F.expr(f"read_first DIV {size}"))
    tiles = starts.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("read_first", "weight"))).alias("w"))
    dealt = tiles.select("tile", F.transform("w", lambda x: x["read_first"]).alias("starts"), F.transform("w", lambda x: x["weight"]).alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Averager(model, cfg, window)
        for batch in batches:
            for first, weights in zip(batch.column(1), batch.column(2), strict=True):
                first, weights = (v.values.to_numpy() for v in (first, weights))
                # windows that are far apart are read one by one
                for at in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first) > span) + 1):
                    lo, hi = int(first[at[0]]), int(first[at[-1]]) + span
                    x = model.averages(reader.samples(lo, hi)[:, : reader.signal].T.astype(np.float64)) * scale
                    found.add(x, first[at] - lo, weights[at])
        yield from found.sums()

    return dealt.mapInArrow(run, _SUMS)


def _mean_of(sums: DataFrame, rows: DataFrame, ch_first: int, ch_last: int) -> DataFrame:
    chosen = select_rows(rows, ch_first, ch_last).where("data_idx IS NOT NULL").select("data_idx", F.col("full_idx").alias("row_idx"))
    return sums.join(F.broadcast(chosen), "row_idx").groupBy("data_idx", "k").agg((F.sum("s") / F.sum("m")).alias("mean_uv"))


def event_average(
    samples: DataFrame, rows: DataFrame, stims: DataFrame, cfg: PreprocConfig, n_samples: int, start_ms: float, end_ms: float, ch_first: int = 0, ch_last: int = 1 << 30
) -> DataFrame:
    """(data_idx, k, mean_uv): the mean over stimuli of the preprocessed window, for the selected channels.

    Each window is preprocessed by itself, with its margins and with all rows, since the median and
    the spatial filter need them; the channel selection and the crop follow. Stimuli too close to the
    ends are left out; none left gives no rows. Repeated stimuli count each, but equal windows are
    preprocessed once. What `cut_windows` and `preprocess` with the key stim_idx give in relational form is the same.
    """
    window = EventWindow.of(start_ms, end_ms, cfg.sample_rate)
    placed = place_windows(stims, window, cfg.sample_rate, n_samples)
    # the mean over channels of a row is the same in every window: taken once, before windows multiply the samples
    return _mean_of(_tile_sums(depth_average(samples, rows), placed, rows, cfg, window), rows, ch_first, ch_last)


def event_average_of_file(
    spark: SparkSession, path: str, rows: DataFrame, stims: DataFrame, cfg: PreprocConfig, start_ms: float, end_ms: float, ch_first: int = 0, ch_last: int = 1 << 30, size: int = 1 << 15, **options
) -> DataFrame:
    """`event_average` of a raw or compressed recording, windows read from the file by the tasks that average them.

    No sample becomes a row. `size` is the length of the tiles by which windows are dealt out; options are
    those of the recording sources and default to the side-car files. What no window covers is not read.
    """
    reader = reader_of(path, options)
    window = EventWindow.of(start_ms, end_ms, cfg.sample_rate)
    placed = place_windows(stims, window, cfg.sample_rate, reader.total)
    return _mean_of(_file_sums(reader, placed, rows, cfg, window, reader.scale, size), rows, ch_first, ch_last)


def mean_trace(average: DataFrame) -> DataFrame:
    """(k, mean_uv): the unweighted mean over rows."""
    return average.groupBy("k").agg(F.avg("mean_uv").alias("mean_uv"))
