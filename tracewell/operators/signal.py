"""Signal operators over the relational form `trace(*keys, shank, row_idx, t, uv)`.

`keys` name the window that a sample belongs to, such as a recording or a stimulus: every operator
works on each window by itself, and windows spread over the cluster. Stages that follow a row
through time (DC, phase shift, highpass) share one shuffle by (keys, shank, row_idx); stages across
rows (median, spatial filter) need one by (keys, shank, t). A row of a window is a bounded group:
windows are some seconds long, whatever the length of the recording. For whole recordings the tile
form of `tracewell.operators.tiles` does the same with one shuffle.

Null samples count as 0, the value of a sample that was never recorded.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.filters import butter_highpass, filtfilt, kfilt_matrix, sosfilt, where_there
from tracewell.model import AGC_EPSILON, CMR_FAR_UM, CMR_NEAR_UM, FILTER_ORDER, KFILT_WN, PROBE_TYPES_2, PreprocConfig
from tracewell.operators.geometry import neighbours

Keys = Sequence[str]


def depth_average(samples: DataFrame, rows: DataFrame, keys: Keys = ()) -> DataFrame:
    """(*keys, shank, row_idx, t, uv): the mean of a row's channels per sample; runs before all else.

    `samples` is (*keys, ch, t, uv). Where each row has one channel, samples are copied and nothing is
    shuffled. The rows of a probe are few, so their channel list is broadcast.
    """
    widest = rows.agg(F.max(F.size("channels"))).first()[0] or 0
    members = rows.where("data_idx IS NOT NULL").select("shank", F.col("data_idx").alias("row_idx"), F.explode("channels").alias("ch"))
    own = samples.join(F.broadcast(members), "ch")
    if widest <= 1:
        return own.select(*keys, "shank", "row_idx", "t", F.coalesce(F.col("uv").cast("double"), F.lit(0.0)).alias("uv"))
    return own.groupBy(*keys, "shank", "row_idx", "t").agg(F.avg(F.coalesce(F.col("uv").cast("double"), F.lit(0.0))).alias("uv"))


def _row(keys: Keys) -> Window:
    return Window.partitionBy(*keys, "shank", "row_idx")


def dc_removal(trace: DataFrame, keys: Keys = ()) -> DataFrame:
    """Each row without its mean over the window."""
    return trace.withColumn("uv", F.col("uv") - F.avg("uv").over(_row(keys)))


def channel_phase(first_ch: Column, probe_type: int) -> Column:
    """The share of a sample by which a channel was read late, from its place in the multiplexer."""
    step, cycle = (24, 16.0) if probe_type in PROBE_TYPES_2 else (32, 13.0)
    return F.floor((first_ch % 384) / step) / cycle


def phase_shift(trace: DataFrame, rows: DataFrame, probe_type: int, keys: Keys = ()) -> DataFrame:
    """Each sample moved to the window's common time by linear interpolation with the one before it."""
    delay = rows.where("data_idx IS NOT NULL").select("shank", F.col("data_idx").alias("row_idx"), channel_phase(F.col("first_ch"), probe_type).alias("delay"))
    before = F.lag("uv").over(_row(keys).orderBy("t"))
    own = trace.join(F.broadcast(delay), ["shank", "row_idx"])
    return own.withColumn("uv", F.when(before.isNull(), F.col("uv")).otherwise(F.col("uv") * (1 - F.col("delay")) + before * F.col("delay"))).drop("delay").select(*trace.columns)


def zero_phase_filter(trace: DataFrame, sections, keys: Keys = (), at_once: int = 1 << 20) -> DataFrame:
    """filtfilt along time for each row of each window; the recursion has no SQL form."""
    return _along_rows(trace, lambda x: filtfilt(sections, x), keys, at_once)


def forward_filter(trace: DataFrame, sections, keys: Keys = (), at_once: int = 1 << 20) -> DataFrame:
    """One pass of the sections along time, from a zero state, for each row of each window."""
    return _along_rows(trace, lambda x: sosfilt(sections, x), keys, at_once)


def _along_rows(trace: DataFrame, of: Callable[[np.ndarray], np.ndarray], keys: Keys, at_once: int) -> DataFrame:
    """`of` over the samples of each row of each window, given a matrix of rows of equal length.

    A window function numbers the samples of each row, which puts whole rows in order into one
    partition (the one that DC removal and phase shift need too). Python then takes about `at_once`
    samples at a time and filters rows of equal length together, as one matrix.
    """
    numbered = trace.withColumn("uv", F.coalesce(F.col("uv").cast("double"), F.lit(0.0))).withColumn("__i", F.row_number().over(_row(keys).orderBy("t")))
    at = trace.columns.index("uv")
    fields = trace.schema.fields
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name == "uv" else f for f in fields])

    def filtered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(table.column("__i").to_numpy() == 1)
        sizes = np.diff(np.append(starts, table.num_rows))
        x = table.column(at).to_numpy().copy()
        for n in np.unique(sizes):
            places = starts[sizes == n][:, None] + np.arange(n)
            x[places] = of(x[places])
        yield from table.set_column(at, "uv", pa.array(x)).drop_columns(["__i"]).to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many = 0
        for batch in batches:
            if many >= at_once:
                starts = np.flatnonzero(batch.column("__i").to_numpy() == 1)  # rows that begin in this batch; the last one may go on
                if len(starts):
                    yield from filtered(pa.Table.from_batches([*held, batch.slice(0, int(starts[-1]))]))
                    held, many, batch = [], 0, batch.slice(int(starts[-1]))
            held.append(batch)
            many += batch.num_rows
        if many:
            yield from filtered(pa.Table.from_batches(held))

    return numbered.mapInArrow(run, schema)


def highpass(trace: DataFrame, cfg: PreprocConfig, keys: Keys = ()) -> DataFrame:
    return zero_phase_filter(trace, butter_highpass(FILTER_ORDER, cfg.highpass_wn), keys)


def frames(trace: DataFrame, keys: Keys = ()) -> DataFrame:
    """(*keys, shank, t, x): the rows of a shank at one time as array<struct<row_idx,uv>>, in row order."""
    return trace.groupBy(*keys, "shank", "t").agg(F.sort_array(F.collect_list(F.struct("row_idx", "uv"))).alias("x"))


def _median(values: Column) -> Column:
    """The median of a sorted array; even counts average the middle two."""
    n = F.size(values)
    middle = F.get(values, (n / 2).cast("int"))
    return F.when(n % 2 == 1, middle).otherwise((F.get(values, (n / 2).cast("int") - 1) + middle) / 2)


def cmr_global(trace: DataFrame, keys: Keys = ()) -> DataFrame:
    """Each sample without the median of its shank at that time.

    The samples of a shank at one time are as many as its rows: they meet in one array, are sorted
    there, and leave as rows again. That is cheaper than a windowed median, whose aggregate keeps a
    table of counts for every group.
    """
    whole = frames(trace, keys).withColumn("m", _median(F.sort_array(F.transform("x", lambda e: e["uv"]))))
    done = whole.withColumn("y", F.transform("x", lambda e: F.struct(e["row_idx"].alias("row_idx"), (e["uv"] - F.col("m")).alias("uv"))))
    return done.select(*keys, "shank", "t", F.inline("y")).select(*trace.columns)


def _across_rows(whole: DataFrame, trace: DataFrame, rows: DataFrame, of: Callable[[int, np.ndarray, np.ndarray | None], np.ndarray], at_once: int = 1 << 10) -> DataFrame:
    """`trace` anew from `whole` (see `frames`): `of(shank, uv, gain)` over matrices of times by rows of a shank.

    A shank's samples at some thousand times make one matrix, in the order of its rows; samples that are
    not there are NaN and stay away. `gain` is a matrix too where the frames hold it, else None.
    """
    places = {s: np.array(sorted(r), np.int32) for s, r in _shank_rows(rows).items()}  # a few numbers for each row of a probe
    keys, fields = [c for c in trace.columns if c not in ("row_idx", "uv")], trace.schema.fields
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name == "uv" else f for f in fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                lists, shank = part.column("x"), part.column("shank").to_numpy()
                flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), sizes)
                row, uv = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("row_idx", "uv"))
                gain = flat.field("gain").to_numpy(zero_copy_only=False) if flat.type.num_fields > 2 else None
                out = np.zeros(len(row))
                for s in np.unique(shank):
                    mine = shank[owner] == s
                    times = np.cumsum(shank == s) - 1
                    at = times[owner[mine]], np.searchsorted(places[int(s)], row[mine])
                    x = np.full((times[-1] + 1, len(places[int(s)])), np.nan)
                    x[at] = np.where(np.isnan(uv[mine]), 0.0, uv[mine])
                    g = None
                    if gain is not None:
                        g = np.ones_like(x)
                        g[at] = gain[mine]
                    out[mine] = of(int(s), x, g)[at]
                made = {c: part.column(c).take(pa.array(owner)) for c in keys} | {"row_idx": pa.array(row), "uv": pa.array(out)}
                yield pa.RecordBatch.from_arrays([made[f.name] for f in fields], names=[f.name for f in fields])

    return whole.mapInArrow(run, schema)


def cmr_local(trace: DataFrame, rows: DataFrame, keys: Keys = (), near: float = CMR_NEAR_UM, far: float = CMR_FAR_UM) -> DataFrame:
    """Each sample without the median of its neighbours' input values; a row without neighbours stays.

    The samples of a shank at one time meet in one array, so that they are shuffled once and not once per
    neighbour; medians are taken over matrices of many times, which costs rows times neighbours each.
    """
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    place = {s: {r: i for i, r in enumerate(sorted(own))} for s, own in _shank_rows(rows).items()}
    for r in neighbours(rows, near, far).collect():  # one row for each row of a probe
        found.setdefault(r["shank"], []).append((place[r["shank"]][r["data_idx"]], np.array([place[r["shank"]][j] for j in r["others"]])))

    def rest(shank: int, x: np.ndarray, _) -> np.ndarray:
        y = x.copy()
        median = np.nanmedian if np.isnan(x).any() else np.median
        for i, others in found.get(shank, ()):
            with np.errstate(all="ignore"), warnings.catch_warnings():
                warnings.simplefilter("ignore")  # of no neighbour's sample there
                y[:, i] -= np.nan_to_num(median(x[:, others], axis=1))
        return y

    return _across_rows(frames(trace, keys), trace, rows, rest)


def agc_gain(trace: DataFrame, cfg: PreprocConfig, keys: Keys = ()) -> DataFrame:
    """`trace` with `gain`: the mean absolute value over a centred span, with a floor.

    Span sums are differences of one running sum, so the cost does not grow with the span. The floor
    is a share of the standard deviation of all of the shank's samples in the window, taken as an
    aggregate and joined.
    """
    h = cfg.agc_half
    along = _row(keys).orderBy("t")
    upto = F.sum(F.abs("uv")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    row, n = F.row_number().over(along), F.count("*").over(_row(keys))
    summed = trace.withColumn("__c", upto).withColumn("__i", row).withColumn("__n", n).withColumn("__all", F.sum(F.abs("uv")).over(_row(keys)))
    high = F.coalesce(F.lead("__c", h).over(along), F.col("__all"))
    low = F.coalesce(F.lag("__c", h + 1).over(along), F.lit(0.0))
    count = F.least(F.col("__i") + h, F.col("__n")) - F.greatest(F.col("__i") - h, F.lit(1)) + 1
    local = summed.withColumn("__m", (high - low) / count)
    floor = trace.groupBy(*keys, "shank").agg(F.greatest(F.stddev_pop("uv") * AGC_EPSILON, F.lit(1e-8)).alias("__floor"))
    joined = local.join(F.broadcast(floor) if not keys else floor, [*keys, "shank"])
    return joined.select(*trace.columns, F.greatest("__m", "__floor").alias("gain"))


def _shank_rows(rows: DataFrame) -> dict[int, list[int]]:
    return {r["shank"]: r["own"] for r in rows.where("data_idx IS NOT NULL").groupBy("shank").agg(F.collect_list("data_idx").alias("own")).collect()}


def kfilt(trace: DataFrame, rows: DataFrame, keys: Keys = (), wn: float = KFILT_WN) -> DataFrame:
    """The spatial highpass across the rows of a shank at each time: one constant matrix per shank.

    The matrix depends on the number of rows alone. Where rows have no sample at a time, the others are
    filtered as if they were all of the shank's.
    """

    def filtered(shank: int, x: np.ndarray, _) -> np.ndarray:
        return where_there(lambda own: own @ kfilt_matrix(own.shape[1], wn).T, x)

    return _across_rows(frames(trace, keys), trace, rows, filtered)


def destripe(trace: DataFrame, rows: DataFrame, cfg: PreprocConfig, keys: Keys = ()) -> DataFrame:
    """Divide by the gain, filter across rows as `kfilt` does, multiply by the gain."""
    gained = agc_gain(trace, cfg, keys)
    whole = gained.groupBy(*keys, "shank", "t").agg(F.sort_array(F.collect_list(F.struct("row_idx", "uv", "gain"))).alias("x"))

    def filtered(shank: int, x: np.ndarray, gain: np.ndarray) -> np.ndarray:
        return where_there(lambda own: own @ kfilt_matrix(own.shape[1]).T, x / gain) * gain

    return _across_rows(whole, trace, rows, filtered)


def preprocess(trace: DataFrame, rows: DataFrame, cfg: PreprocConfig, keys: Keys = ()) -> DataFrame:
    """The stages that `cfg` switches on, in their order: DC, phase shift, highpass, spatial filter."""
    if cfg.dc_removal:
        trace = dc_removal(trace, keys)
    if cfg.phase_shift:
        trace = phase_shift(trace, rows, cfg.probe_type, keys)
    if cfg.highpass:
        trace = highpass(trace, cfg, keys)
    if cfg.spatial == "global_cmr":
        return cmr_global(trace, keys)
    if cfg.spatial == "local_cmr":
        return cmr_local(trace, rows, keys)
    return destripe(trace, rows, cfg, keys) if cfg.spatial == "destripe" else trace
