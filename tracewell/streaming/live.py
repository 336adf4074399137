"""Recordings that still grow: a stream of samples, and causal operators with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.filters import butter_highpass, sosfilt_from
from tracewell.model import AGC_EPSILON, FILTER_ORDER, PreprocConfig
from tracewell.operators.tiles import RowModel, halo_of, recorded, spatial, temporal, unpack
from tracewell.sources.files import file_size
from tracewell.sources.recording import RawReader, RawSource, Span


class RawStreamReader(DataSourceStreamReader):
    """Samples of a growing raw file; the offset is the sample up to which it was read.

    The end of a batch is the end of the file, which never falls back, so a stream that is started again
    from its checkpoint goes on where it stopped. A stream that starts late reads what is there as one
    batch, cut into tasks of `samples_per_task`.
    """

    def __init__(self, options: dict):
        self.reader = RawReader({"n_samples": 1 << 62} | options)

    def initialOffset(self) -> dict:
        return {"sample": self.reader.first}

    def latestOffset(self) -> dict:
        there = file_size(self.reader.path) // (2 * self.reader.channels)
        return {"sample": max(self.reader.first, there)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        step = self.reader.per_task
        return [Span(lo, min(lo + step, end["sample"])) for lo in range(start["sample"], end["sample"], step)] or [Span(0, 0)]

    def commit(self, end: dict) -> None:
        """Nothing is held here: the checkpoint has the offset."""

    def read(self, span: Span) -> Iterator:
        yield from self.reader.read(span)


class RawStream(RawSource):
    @classmethod
    def name(cls) -> str:
        return "tracewell_stream"

    def streamReader(self, schema) -> RawStreamReader:
        return RawStreamReader(dict(self.options))


def read_stream(spark, path: str, **options) -> DataFrame:
    """(ch, t, uv) as a stream, or (t0, n, x) with `form="tile"`; options as for the batch source, with channels and uv_per_bit given."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawStream)
    return spark.readStream.format("tracewell_stream").options(**{k: str(v) for k, v in options.items()}).load(path)


def live_spikes(stream: DataFrame, cfg: PreprocConfig, threshold: float) -> DataFrame:
    """(ch, t, uv) of each spike of each channel of a stream, as it comes in.

    The zero-phase filter looks ahead, so a stream has its forward half only. A channel's state holds
    the filter's numbers, the last counted spike and the next sample; batches of a channel may come in
    any order of rows, but hold consecutive samples.
    """
    sections = butter_highpass(FILTER_ORDER, cfg.highpass_wn)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, last = (list(state.get[0]), state.get[1]) if state.exists else ([0.0] * (2 * len(sections)), None)
        rows = pd.concat(list(frames)).sort_values("t")
        y, after = sosfilt_from(sections, rows["uv"].to_numpy(), np.array(numbers).reshape(len(sections), 1, 2))
        y, numbers = y[0], after.ravel().tolist()
        hits = []
        for t, v in zip(rows["t"].to_numpy()[y < threshold], y[y < threshold], strict=True):
            if last is None or t - last > cfg.refractory:
                last = int(t)
                hits.append((key[0], last, float(v)))
        state.update((numbers, last))
        yield pd.DataFrame(hits, columns=["ch", "t", "uv"]).astype({"ch": "int32", "t": "int64", "uv": "float64"})

    return stream.groupBy("ch").applyInPandasWithState(step, "ch int, t long, uv double", "numbers array<double>, last long", "append", GroupStateTimeout.NoTimeout)


def live_preprocessed(stream: DataFrame, rows: DataFrame, cfg: PreprocConfig, scale: float, n_samples: int | None = None, means: list[float] | None = None, deviations: list[float] | None = None, ends: list[int] | None = None) -> DataFrame:
    """(shank, row_idx, t, uv): all preprocessing stages of a stream of tiles (t0, n, x), zero-phase filter and spatial filter included.

    The filters look ahead, so a sample comes out when those after it, as many as the halo, have come in. A
    shank's state holds the averaged rows from a halo before the next sample that is due. What comes out is
    what `full_window` gives inside the halo, whatever the batches, and after a restart from a checkpoint.
    With `n_samples`, the length of the recording, the rest comes out when the last sample is there.

    What depends on the whole recording has to be given: `means` of the rows for DC removal, without which
    there is none, as the highpass removes it anyway; the `deviations` of filtered shanks for 'destripe'.
    Channels that end before the recording have their number of samples in `ends`; a row has no sample after its end.
    Tiles of a batch may come in any order; a gap between them raises.
    """
    if cfg.dc_removal and means is None and not cfg.highpass:
        raise ValueError("DC removal of a stream without a highpass: give the means of the rows")
    if cfg.spatial == "destripe" and deviations is None:
        raise ValueError("the gain of a stream: give the deviation of each shank")
    whole, halo = RowModel.of(rows), halo_of(cfg)
    cfg = cfg.with_(dc_removal=cfg.dc_removal and means is not None)
    blocks = whole.blocks()
    models = [RowModel(*(f[a:b] for f in (whole.members, whole.first_ch, whole.x_um, whole.y_um, whole.shank))) for a, b in blocks]

    def averaged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for t0, n, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                y = whole.averages(recorded(unpack(x, n, scale), t0, ends))
                parts = [np.ascontiguousarray(y[a:b]).tobytes() for a, b in blocks]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([t0] * len(parts)), pa.array(parts, pa.binary())], names=["block", "t0", "y"])

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block = int(key[0])
        model, height = models[block], len(models[block].shank)
        first, due, held = state.get if state.exists else (0, 0, b"")
        parts = [np.frombuffer(held, np.float64).reshape(height, -1)]
        end = first + parts[0].shape[1]
        for t0, y in pd.concat(list(frames)).sort_values("t0")[["t0", "y"]].itertuples(index=False):
            if not state.exists and len(parts) == 1:
                first = due = end = t0
            if t0 != end:
                raise ValueError(f"a stream with a gap: samples from {t0} follow those up to {end}")
            parts.append(np.frombuffer(y, np.float64).reshape(height, -1))
            end += parts[-1].shape[1]
        x = np.concatenate(parts, 1)
        last = end if n_samples is not None and end >= n_samples else end - halo
        if last > due:
            own = np.zeros(height) if means is None else np.array(means[blocks[block][0] : blocks[block][1]])
            floors = {0: max(AGC_EPSILON * deviations[block], 1e-8)} if deviations else {}
            done = spatial(temporal(x, model, cfg, own, first == 0), model, cfg, floors, due - first, last - first)
            r, k = np.divmod(np.arange(done.size), last - due)
            made = pd.DataFrame({"shank": np.full(done.size, model.shank[0], np.int32), "row_idx": (r + blocks[block][0]).astype(np.int32), "t": k + due, "uv": done.ravel()})
            yield made[~np.isnan(done.ravel())]
            keep = max(first, last - halo)
            x, first, due = x[:, keep - first :], keep, last
        state.update((first, due, np.ascontiguousarray(x).tobytes()))

    kept = stream.select("t0", "n", "x").mapInArrow(averaged, "block int, t0 long, y binary")
    return kept.groupBy("block").applyInPandasWithState(step, "shank int, row_idx int, t long, uv double", "first long, due long, held binary", "append", GroupStateTimeout.NoTimeout)
