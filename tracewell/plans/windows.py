"""Windows of a recording: the full one around a view, its extension to either side, and the policies that size them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.model import OVERLAP_SAMPLES, PreprocConfig
from tracewell.operators.signal import depth_average, preprocess

#: Reads (ch, t, uv) of samples [first, first + n).
Scan = Callable[[int, int], DataFrame]


@dataclass(frozen=True)
class Buffer:
    """A preprocessed span [first, first + n) of a recording."""

    first: int
    n: int
    trace: DataFrame

    @property
    def end(self) -> int:
        return self.first + self.n


def half_window(buffer_s: float, rate: float) -> int:
    return int(buffer_s / 2.0 * rate)


def full_span(center: int, half: int, n_samples: int) -> tuple[int, int]:
    """(first, n) of a window around `center` that stays inside the recording."""
    first = max(center - half, 0)
    return first, max(min(2 * half, n_samples - first), 0)


def _process(scan: Scan, rows: DataFrame, cfg: PreprocConfig, first: int, n: int) -> DataFrame:
    return preprocess(depth_average(scan(first, n), rows), rows, cfg)


def full_window(scan: Scan, rows: DataFrame, cfg: PreprocConfig, center: int, half: int, n_samples: int) -> Buffer:
    first, n = full_span(center, half, n_samples)
    return Buffer(first, n, _process(scan, rows, cfg, first, n))


@dataclass(frozen=True)
class Extension:
    """What an extension reads, which of it is kept, and what the old buffer loses."""

    read_first: int
    read_n: int
    keep_first: int
    keep_n: int
    drop: int


def trim(old_n: int, ext: int, most: int, headroom: int, pressure: bool) -> int:
    """Samples to drop from the far side: what exceeds the cap, or all that comes in under memory pressure,
    but never nearer to the view than the headroom allows."""
    over = max(old_n + ext - most, 0)
    return min(max(over, ext) if pressure else over, max(headroom, 0), old_n)


def plan_extension(buffer: tuple[int, int], right: bool, step: int, view: tuple[int, int], n_samples: int, most: int, pressure: bool = False, overlap: int = OVERLAP_SAMPLES) -> Extension | None:
    """How to extend (first, n) towards one side; None at the end of the recording."""
    first, n = buffer
    end = first + n
    if right:
        ext = min(step, max(n_samples - end, 0))
        read = max(end - overlap, 0)
        return Extension(read, end - read + ext, end, ext, trim(n, ext, most, view[0] - first - overlap, pressure)) if ext else None
    ext = min(step, first)
    return Extension(first - ext, ext + min(overlap, n), first - ext, ext, trim(n, ext, most, end - (view[0] + view[1]) - overlap, pressure)) if ext else None


def extend(old: Buffer, right: bool, scan: Scan, rows: DataFrame, cfg: PreprocConfig, step: int, view: tuple[int, int], n_samples: int, most: int, pressure: bool = False, overlap: int = OVERLAP_SAMPLES) -> Buffer:
    """`old` extended by up to `step` samples.

    The new part is preprocessed with an overlap into the old one, which lets the filters settle, and
    by itself otherwise: its mean and its gain floor are those of what was read. So a buffer depends
    on the order in which it grew; `full_window` does not.
    """
    e = plan_extension((old.first, old.n), right, step, view, n_samples, most, pressure, overlap)
    if e is None:
        return old
    fresh = _process(scan, rows, cfg, e.read_first, e.read_n).where(F.col("t").between(e.keep_first, e.keep_first + e.keep_n - 1))
    lo, hi = (old.first + e.drop, old.end) if right else (old.first, old.end - e.drop)
    kept = old.trace.where((F.col("t") >= lo) & (F.col("t") < hi))
    return Buffer(lo if right else e.keep_first, (hi - lo) + e.keep_n, kept.unionByName(fresh))


def wanted_side(buffer: tuple[int, int], view: tuple[int, int], margin: int, n_samples: int) -> str | None:
    """The side to extend next: one whose margin to the view is short and that is not at an end; the shorter one first, left if equal."""
    left, right = view[0] - buffer[0], buffer[0] + buffer[1] - (view[0] + view[1])
    need_left, need_right = left < margin and buffer[0] > 0, right < margin and buffer[0] + buffer[1] < n_samples
    if need_left and (not need_right or left <= right):
        return "left"
    return "right" if need_right else None


def under_pressure(total: int, available: int, percent: float = 15.0, reserve: int = 1500 << 20) -> bool:
    return total > 0 and (available / total * 100.0 < percent or available < reserve)


def most_buffer_s(available: int, reserve: int, n_rows: int, rate: float) -> float:
    """Seconds that fit in memory at four bytes a sample and row, one at least."""
    return max((available - reserve) / (max(n_rows, 1) * 4) / rate, 1.0)


def most_margin_s(buffer_s: float, view_s: float) -> float:
    return max(0.9 * (buffer_s - view_s) / 3.0, 0.5)


def trim_of(old_n: Column, ext: Column, most: Column, headroom: Column, pressure: Column) -> Column:
    """`trim` of each row."""
    over = F.greatest(old_n + ext - most, F.lit(0))
    return F.least(F.when(pressure, F.greatest(over, ext)).otherwise(over), F.greatest(headroom, F.lit(0)), old_n)


def wanted_side_of(first: Column, n: Column, view_first: Column, view_n: Column, margin: Column, n_samples: Column) -> Column:
    """`wanted_side` of each row."""
    left, right = view_first - first, first + n - (view_first + view_n)
    need_left, need_right = (left < margin) & (first > 0), (right < margin) & (first + n < n_samples)
    return F.when(need_left & (~need_right | (left <= right)), "left").when(need_right, "right")


def under_pressure_of(total: Column, available: Column, percent: float = 15.0, reserve: int = 1500 << 20) -> Column:
    return (total > 0) & ((available / total * 100.0 < percent) | (available < reserve))


def most_buffer_of(available: Column, reserve: int, n_rows: Column, rate: float) -> Column:
    return F.greatest((available - reserve) / (F.greatest(n_rows, F.lit(1)) * 4) / rate, F.lit(1.0))


def most_margin_of(buffer_s: Column, view_s: Column) -> Column:
    return F.greatest(0.9 * (buffer_s - view_s) / 3.0, F.lit(0.5))


def step_view_of(start_s: Column, view_s: Column, total_s: float, steps: Column, share: Column) -> Column:
    moved = start_s + steps * share * view_s
    return F.least(F.greatest(moved, F.lit(0.0)), F.greatest(F.lit(total_s) - view_s, F.lit(0.0)))


def clamp_length_of(view_s: Column) -> Column:
    return F.least(F.greatest(view_s, F.lit(0.01)), F.lit(10.0))


# --- moving the view ---


def clamp_view(start_s: float, view_s: float, total_s: float) -> float:
    return min(max(start_s, 0.0), max(total_s - view_s, 0.0))


def clamp_length(view_s: float) -> float:
    return min(max(view_s, 0.01), 10.0)


def step_view(start_s: float, view_s: float, total_s: float, steps: float, share: float = 0.05) -> float:
    """A view moved by a share of its length per step: 0.05 or 0.3 for the wheel, 0.5 for the arrow keys."""
    return clamp_view(start_s + steps * share * view_s, view_s, total_s)


@dataclass(frozen=True)
class ViewPolicy:
    """What sizes the views and buffers of a session: the recording, the memory and the display's wishes."""

    rate: float
    n_samples: int
    n_rows: int
    total_bytes: int
    reserve: int = 1500 << 20
    view_s: float = 0.5
    buffer_s: float = 30.0
    margin_s: float = 5.0
    overlap: int = OVERLAP_SAMPLES


@dataclass(frozen=True)
class Session:
    """Where a view stands and what its buffer holds; no buffer has n = 0."""

    start_s: float
    view_s: float
    first: int = 0
    n: int = 0
    action: str | None = None
    dropped: int = 0


def after_request(s: Session, p: ViewPolicy, jump_s: float | None, steps: float, share: float, zoom: float, available: int) -> Session:
    """A session after a request: zoom, then jump or step, then what the buffer needs.

    A view that is not inside the buffer gets a full window around it. Otherwise the side whose margin is short
    grows by the margin, and the other one is trimmed to what the memory that is available allows.
    """
    total_s, view_s = p.n_samples / p.rate, clamp_length(s.view_s * zoom)
    start_s = step_view(s.start_s, view_s, total_s, steps, share) if jump_s is None else clamp_view(jump_s, view_s, total_s)
    view = int(start_s * p.rate), int(view_s * p.rate)
    room_s = most_buffer_s(available, p.reserve, p.n_rows, p.rate)
    buffer_s = min(p.buffer_s, room_s)
    if not s.n or view[0] < s.first or view[0] + view[1] > s.first + s.n:
        first, n = full_span(view[0] + view[1] // 2, half_window(buffer_s, p.rate), p.n_samples)
        return Session(start_s, view_s, first, n, "full", s.n)
    margin = int(min(p.margin_s, most_margin_s(room_s, view_s)) * p.rate)
    side = wanted_side((s.first, s.n), view, margin, p.n_samples)
    plan = side and plan_extension((s.first, s.n), side == "right", margin, view, p.n_samples, int(buffer_s * p.rate), under_pressure(p.total_bytes, available, reserve=p.reserve), p.overlap)
    if not plan:
        return Session(start_s, view_s, s.first, s.n)
    return Session(start_s, view_s, s.first + plan.drop if side == "right" else plan.keep_first, s.n - plan.drop + plan.keep_n, side, plan.drop)


REPLAYED = "start_s double, view_s double, first long, n long, action string, dropped long"


def replay(requests: DataFrame, policy: ViewPolicy, key: str, order: list[str]) -> DataFrame:
    """(key, order..., start_s, view_s, first, n, action, dropped): the session of each key after each of its requests.

    Requests have `jump_s` (null: a step), `steps`, `share`, `zoom` and `available` bytes. The requests of a key
    are a sequence and go through one task in order, one batch at a time; only the session is held. Of two
    requests that are equal in `order` either may come first; a null key is a session of its own.
    """
    fields = [key, *order, "jump_s", "steps", "share", "zoom", "available"]
    at = {c: i for i, c in enumerate(fields)}
    schema = T.StructType([*(requests.schema[c] for c in (key, *order)), *T.StructType.fromDDL(REPLAYED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, session = object(), None
        for batch in batches:
            made = []
            columns = [batch.column(at[c]).to_pylist() for c in (key, "jump_s", "steps", "share", "zoom", "available")]
            for k, *request in zip(*columns, strict=True):
                if k != name:
                    name, session = k, Session(0.0, policy.view_s)
                session = after_request(session, policy, *request)
                made.append(session)
            values = [pa.array([getattr(s, f.name) for s in made], pa.string() if f.name == "action" else pa.float64() if f.name.endswith("_s") else pa.int64()) for f in schema.fields[1 + len(order) :]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1 + len(order))), *values], names=schema.names)

    return requests.select(*fields).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def latest_only(spark, slot: str, plan: Callable[[], object]):
    """Run a plan as the only one of its slot: what the slot still runs, in any thread, is cancelled first.

    The tags are the context's: a session's tags are known to the thread alone that has set them.
    """
    context = spark.sparkContext
    context.cancelJobsWithTag(slot)
    context.addJobTag(slot)
    try:
        return plan()
    finally:
        context.removeJobTag(slot)
