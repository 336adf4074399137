"""The tile form of a recording: the whole pipeline without a shuffle of samples.

A tile is one row (tile_id, t0, n, x): all channels over a span of samples, as bytes. A task needs the
samples on both sides of its span too (the halo): the zero-phase filter has settled after some
hundred samples, and the gain looks half its span further. The sources of
`tracewell.sources.recording` read tiles with their halo from the file (`form=tile`, `halo`), so that
nothing is shuffled. Tiles that come from elsewhere get it from their neighbours by `with_halo`, which
joins tiles by their place and so does shuffle them.

Two quantities belong to the whole window and not to a tile: the mean of each row, and the standard
deviation in the floor of the gain. They are aggregates of per-tile sums, one small row per tile,
taken first and passed along.

Channels may end before the recording does. Tiles hold zeros there; given the `ends` of the channels, such
samples are NaN inside the stages and no stage counts them: a row has the mean of the channels that go on,
is filtered up to its end, and takes no part in the spatial filter after it.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.filters import butter_highpass, filtfilt, kfilt_matrix, where_there
from tracewell.model import AGC_EPSILON, CMR_FAR_UM, CMR_NEAR_UM, FILTER_ORDER, PROBE_TYPES_2, PreprocConfig

_SETTLED = 1e-14  # of an impulse's height


def settling(sections) -> int:
    """Samples after which the response of the sections has died away to rounding error, by their slowest pole."""
    slowest = max(abs(p) for _, _, _, a1, a2 in sections for p in np.roots([1.0, a1, a2]))
    return math.ceil(math.log(_SETTLED) / math.log(slowest)) if 0 < slowest < 1 else 1


@dataclass(frozen=True)
class RowModel:
    """The rows of a probe as plain arrays: a few kilobytes that travel with the function."""

    members: tuple[tuple[int, ...], ...]
    first_ch: tuple[int, ...]
    x_um: tuple[float, ...]
    y_um: tuple[float, ...]
    shank: tuple[int, ...]

    @staticmethod
    def of(rows: DataFrame) -> RowModel:
        data = rows.where("data_idx IS NOT NULL").orderBy("data_idx").collect()  # one per row of a probe
        return RowModel(*(tuple(tuple(r[c]) if c == "channels" else r[c] for r in data) for c in ("channels", "first_ch", "x_um", "y_um", "shank")))

    def blocks(self) -> list[tuple[int, int]]:
        cuts = [0, *(i for i in range(1, len(self.shank)) if self.shank[i] != self.shank[i - 1]), len(self.shank)]
        return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def averages(self, x: np.ndarray) -> np.ndarray:
        def mean(own: np.ndarray) -> np.ndarray:
            gone = np.isnan(own)
            if not gone.any():
                return own.mean(0)
            n = (~gone).sum(0)
            return np.where(n > 0, np.where(gone, 0.0, own).sum(0) / np.maximum(n, 1), np.nan)

        return np.stack([mean(x[list(m)]) for m in self.members]) if self.members else np.zeros((0, x.shape[1]))

    def delays(self, probe_type: int) -> np.ndarray:
        step, cycle = (24, 16.0) if probe_type in PROBE_TYPES_2 else (32, 13.0)
        return np.array([(c % 384) // step / cycle for c in self.first_ch])

    def near(self, a: int, b: int) -> list[np.ndarray]:
        x, y = np.array(self.x_um[a:b]), np.array(self.y_um[a:b])
        d = np.hypot(x[:, None] - x, y[:, None] - y)
        return [np.flatnonzero((r >= CMR_NEAR_UM) & (r <= CMR_FAR_UM)) for r in d]


def halo_of(cfg: PreprocConfig) -> int:
    """Samples around a tile that its own ones depend on."""
    own = (settling(butter_highpass(FILTER_ORDER, cfg.highpass_wn)) if cfg.highpass else 0) + (cfg.agc_half if cfg.spatial == "destripe" else 0) + (1 if cfg.phase_shift else 0)
    return max(own, 1)


def unpack(data: bytes, n: int, scale: float) -> np.ndarray:
    return np.frombuffer(data, "<i2").reshape(-1, n).astype(np.float64) * scale


def recorded(x: np.ndarray, first: int, ends: Sequence[int] | None) -> np.ndarray:
    """`x`, channels by samples from `first` on, with NaN from the end of each channel on; written in place."""
    for own, end in zip(x, ends or (), strict=False):
        own[max(0, end - first) :] = np.nan
    return x


def temporal(x: np.ndarray, model: RowModel, cfg: PreprocConfig, means: np.ndarray, at_start: bool) -> np.ndarray:
    """DC, phase and highpass of rows by samples; `at_start`: the first sample is the window's first."""

    def staged(x: np.ndarray, means: np.ndarray, delays: np.ndarray) -> np.ndarray:
        if cfg.dc_removal:
            x = x - means[:, None]
        if cfg.phase_shift:
            d = delays[:, None]
            y = x.copy()
            y[:, 1:] = x[:, 1:] * (1 - d) + x[:, :-1] * d
            x = y
        return filtfilt(butter_highpass(FILTER_ORDER, cfg.highpass_wn), x) if cfg.highpass else x

    return where_there(staged, x, means, model.delays(cfg.probe_type))


def _medians(x: np.ndarray) -> np.ndarray:
    """Of the rows that have a sample; NaN where none has."""
    if not np.isnan(x).any():
        return np.median(x, 0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of no row's sample there
        return np.nanmedian(x, 0)


def _local_mean(x: np.ndarray, h: int) -> np.ndarray:
    """The mean absolute value of up to `h` samples on either side."""
    n = x.shape[1]
    total = np.concatenate((np.zeros((len(x), 1)), np.cumsum(np.abs(x), 1)), 1)
    left, right = np.maximum(np.arange(n) - h, 0), np.minimum(np.arange(n) + h + 1, n)
    return (total[:, right] - total[:, left]) / (right - left)


def spatial(x: np.ndarray, model: RowModel, cfg: PreprocConfig, floors: dict[int, float], lo: int, hi: int) -> np.ndarray:
    """The spatial filter of samples [lo, hi); the gain sees the samples around them."""
    out = x[:, lo:hi].copy()
    for a, b in model.blocks():
        part = x[a:b]
        if cfg.spatial == "global_cmr":
            out[a:b] -= _medians(part[:, lo:hi])
        elif cfg.spatial == "local_cmr":
            for i, near in enumerate(model.near(a, b)):
                if len(near):
                    out[a + i] -= np.nan_to_num(_medians(part[near, lo:hi]))
        elif cfg.spatial == "destripe":
            gain = np.maximum(where_there(lambda x: _local_mean(x, cfg.agc_half), part)[:, lo:hi], floors[a])
            out[a:b] = where_there(lambda x: x @ kfilt_matrix(x.shape[1]).T, (part[:, lo:hi] / gain).T).T * gain
    return out


def _follow(tiles: DataFrame, halo: int) -> None:
    """Raise unless tiles cover a span without gaps and all but the last are as long as the halo."""
    got = tiles.agg(F.count("*").alias("k"), F.count_distinct("t0").alias("starts"), F.sum("n").alias("n"), F.min("t0").alias("lo"), F.max(F.col("t0") + F.col("n")).alias("hi"), F.max("t0").alias("last")).first()
    if not got["k"]:
        return
    if got["starts"] != got["k"] or got["n"] != got["hi"] - got["lo"]:
        raise ValueError(f"tiles with gaps or overlaps: {got['k']} tiles hold {got['n']} samples of a span of {got['hi'] - got['lo']}")
    short = tiles.where((F.col("t0") < got["last"]) & (F.col("n") < halo)).agg(F.count("*"), F.min("n")).first()
    if short[0]:
        raise ValueError(f"{short[0]} tiles are shorter than the halo of {halo} samples, the shortest has {short[1]}; cut longer tiles")


def with_halo(tiles: DataFrame, halo: int) -> DataFrame:
    """(tile_id, t0, n, x, left, right): each tile with up to `halo` samples of its neighbours on either side.

    Each tile sends its last samples to the next one and its first ones to the one before; tiles and
    edges meet by place, in one shuffle. Tiles that don't follow one another without gaps, or are shorter
    than the halo, but for the last, raise: their samples would come out wrong.
    """
    _follow(tiles, halo)
    own = tiles.withColumn("tile_id", F.col("t0"))

    def edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, ends, data = [], [], []
            for t0, n, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                m = np.frombuffer(x, "<i2").reshape(-1, n)
                ids += [t0 + n, t0]
                ends += ["left", "right"]
                data += [np.ascontiguousarray(m[:, -halo:]).tobytes(), np.ascontiguousarray(m[:, :halo]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends), pa.array(data, pa.binary())], names=["at", "side", "edge"])

    sent = tiles.select("t0", "n", "x").mapInArrow(edges, "at long, side string, edge binary")
    left = sent.where("side = 'left'").select(F.col("at").alias("t0"), F.col("edge").alias("left"))
    right = sent.where("side = 'right'").select(F.col("at").alias("__end"), F.col("edge").alias("right"))
    joined = own.join(left, "t0", "left").withColumn("__end", F.col("t0") + F.col("n")).join(right, "__end", "left")
    return joined.select("tile_id", "t0", "n", "x", "left", "right")


def _whole(row: dict, scale: float, ends: Sequence[int] | None) -> tuple[np.ndarray, int]:
    """Samples with halo, and where the tile itself begins in them."""
    x = np.frombuffer(row["x"], "<i2").reshape(-1, row["n"])
    parts = [np.frombuffer(row["left"], "<i2").reshape(len(x), -1) if row["left"] is not None else x[:, :0], x, np.frombuffer(row["right"], "<i2").reshape(len(x), -1) if row["right"] is not None else x[:, :0]]
    at = parts[0].shape[1]
    return recorded(np.concatenate(parts, 1).astype(np.float64) * scale, row["t0"] - at, ends), at


_STATS = "t0 long, counts array<long>, sums array<double>, squares array<double>"


def _sums(halved: DataFrame, model: RowModel, cfg: PreprocConfig, scale: float, means: np.ndarray | None, ends: Sequence[int] | None) -> list:
    """Per tile: count and sum of each averaged row; with `means`, count, sum and sum of squares per shank after filtering."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for row in batch.to_pylist():
                if means is None:
                    parts = list(model.averages(recorded(unpack(row["x"], row["n"], scale), row["t0"], ends)))
                else:
                    x, at = _whole(row, scale, ends)
                    y = temporal(model.averages(x), model, cfg, means, at == 0)[:, at : at + row["n"]]
                    parts = [y[a:b] for a, b in model.blocks()]
                parts = [p[~np.isnan(p)] for p in parts]
                out.append((row["t0"], [len(p) for p in parts], [float(p.sum()) for p in parts], [float((p * p).sum()) for p in parts]))
            yield pa.RecordBatch.from_pylist([dict(zip(("t0", "counts", "sums", "squares"), r, strict=True)) for r in out], pa.schema([("t0", pa.int64()), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))]))

    stats = halved.mapInArrow(run, _STATS)
    width = len(model.shank) if means is None else len(model.blocks())
    wanted = [F.sum(F.get(c, i)).alias(f"{c}_{i}") for c in ("counts", "sums", "squares") for i in range(width)]
    return stats.agg(F.count("*").alias("tiles"), *wanted).first()


def preprocess_tiles(tiles: DataFrame, rows: DataFrame, cfg: PreprocConfig, scale: float, halo: int | None = None, kind: str = "<f4", ends: Sequence[int] | None = None) -> DataFrame:
    """(t0, n, y): preprocessed tiles, y the values of all rows as bytes of numpy type `kind`, row after row.

    `ends` has the number of samples of each channel, if not all have as many as the recording; a row has NaN
    after its end.

    `tiles` come with their halo, or as (t0, n, x), which must follow one another without gaps and be
    no shorter than the halo, but for the last, and raise otherwise. One pass takes the row means if DC removal is on, a second the standard deviation if
    the spatial filter is 'destripe'; the last makes the tiles.
    """
    model = RowModel.of(rows)
    halved = tiles if "left" in tiles.columns else with_halo(tiles, halo or halo_of(cfg))
    means, floors = np.zeros(len(model.shank)), {}
    if cfg.dc_removal:
        total = _sums(tiles.select("t0", "n", "x"), model, cfg, scale, None, ends)
        means = np.array([(total[f"sums_{i}"] or 0.0) / max(1, total[f"counts_{i}"] or 0) for i in range(len(model.shank))])
    if cfg.spatial == "destripe":
        total = _sums(halved, model, cfg, scale, means, ends)
        for i, (a, b) in enumerate(model.blocks()):
            n = max(1, total[f"counts_{i}"] or 0)
            mean = (total[f"sums_{i}"] or 0.0) / n
            floors[a] = max(AGC_EPSILON * math.sqrt(max(0.0, (total[f"squares_{i}"] or 0.0) / n - mean * mean)), 1e-8)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                x, at = _whole(row, scale, ends)
                y = temporal(model.averages(x), model, cfg, means, at == 0)
                done = spatial(y, model, cfg, floors, at, at + row["n"])
                yield pa.RecordBatch.from_arrays([pa.array([row["t0"]]), pa.array([row["n"]], pa.int32()), pa.array([done.astype(kind).tobytes()], pa.binary())], names=["t0", "n", "y"])

    return halved.mapInArrow(run, "t0 long, n int, y binary")


def explode_tiles(done: DataFrame, model: RowModel, kind: str = "<f4") -> DataFrame:
    """(shank, row_idx, t, uv): the relational form of preprocessed tiles, without the places of samples that are not there."""
    shank = np.array(model.shank, np.int32)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                y = np.frombuffer(row["y"], kind).reshape(-1, row["n"])
                for i in range(len(y)):
                    there = np.flatnonzero(~np.isnan(y[i]))
                    n = len(there)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shank[i])), pa.array(np.full(n, i, np.int32)), pa.array(there + row["t0"]), pa.array(y[i, there].astype(np.float64))], names=["shank", "row_idx", "t", "uv"])

    return done.mapInArrow(run, "shank int, row_idx int, t long, uv double")


def below(done: DataFrame, model: RowModel, threshold: float, kind: str = "<f4") -> DataFrame:
    """(shank, row_idx, t, uv) of the samples under a threshold: what spike counting needs of preprocessed tiles."""
    shank = np.array(model.shank, np.int32)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                y = np.frombuffer(row["y"], kind).reshape(-1, row["n"])
                i, t = np.nonzero(y < threshold)
                yield pa.RecordBatch.from_arrays([pa.array(shank[i]), pa.array(i.astype(np.int32)), pa.array(t + row["t0"]), pa.array(y[i, t].astype(np.float64))], names=["shank", "row_idx", "t", "uv"])

    return done.mapInArrow(run, "shank int, row_idx int, t long, uv double")


def tiles_of(samples: DataFrame, n_channels: int, n_samples: int, size: int, scale: float = 1.0) -> DataFrame:
    """Tiles (t0, n, x) from (ch, t, uv) that are whole multiples of `scale`: one shuffle by tile."""

    def run(table: pa.Table) -> pa.Table:
        t0 = table.column("t0")[0].as_py()
        n = min(size, n_samples - t0)
        x = np.zeros((n_channels, n), np.int16)
        x[table.column("ch").to_numpy(), table.column("t").to_numpy() - t0] = np.rint(table.column("uv").to_numpy() / scale).astype(np.int16)
        return pa.table({"t0": pa.array([t0]), "n": pa.array([n], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    dealt = samples.withColumn("t0", F.expr(f"(t DIV {size}) * {size}")).select("t0", F.col("ch").cast("int").alias("ch"), "t", "uv")
    return dealt.groupBy("t0").applyInArrow(run, "t0 long, n int, x binary")
