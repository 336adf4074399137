"""Raw recordings as Spark data sources.

`tracewell_raw` reads interleaved int16 files and `tracewell_cbin` their chunk-compressed form.
Both give (ch, t, uv), or with option `form=tile` one row per range of samples: (t0, n, x), x the
int16 values of all signal channels as bytes, channel after channel; with `halo` also the samples of
the window before and after the range, `left` and `right`, read from the file by the same task. Only the asked window is read,
the trailing sync channels are left out, and each task opens the file for itself. Pass `paths` that
all executors can open.

A raw file that is shorter than its metadata says, as an interrupted recording leaves it, is read as if
zeros followed: every window and every tile has all of its samples.

Options: path; first, n (samples; default: all); channels (number of saved channels), signal_channels,
n_samples, uv_per_bit (default: from the side-car files); samples_per_task; on_error (raise or zero,
for a compressed chunk that cannot be read).
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tracewell.session import materialize
from tracewell.sources.files import find, open_binary

LONG = "ch int, t long, uv double"
TILE = "t0 long, n int, x binary"
HALO_TILE = "tile_id long, t0 long, n int, x binary, left binary, right binary"


@dataclass
class Span(InputPartition):
    """Samples [first, last) of a file."""

    first: int
    last: int


class _Reader(DataSourceReader):
    """What both formats share: the window, its pushed-down limits and the shape of the rows."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.form = options.get("form", "long")
        self.halo = int(options.get("halo", 0))
        if not {"channels", "n_samples", "uv_per_bit"} <= set(options):
            from tracewell.sources.sidecar import find_meta

            meta = find_meta(self.path)
            options = {"channels": meta.n_saved_chans, "signal_channels": meta.n_chans, "n_samples": meta.n_samples, "uv_per_bit": meta.uv_per_bit} | options
        self.channels = int(options["channels"])
        self.signal = int(options.get("signal_channels", self.channels))
        self.total = int(options["n_samples"])
        self.scale = float(options["uv_per_bit"])
        self.first = max(0, int(options.get("first", 0)))
        self.last = min(self.total, self.first + int(options["n"]) if "n" in options else self.total)
        self.per_task = int(options.get("samples_per_task", 1 << 16))
        self.zero = options.get("on_error", "raise") == "zero"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Limits on t narrow the window; whatever else is asked stays with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("t",) and self.form == "long":
                if isinstance(f, GreaterThanOrEqual):
                    self.first = max(self.first, f.value)
                    continue
                if isinstance(f, GreaterThan):
                    self.first = max(self.first, f.value + 1)
                    continue
                if isinstance(f, LessThanOrEqual):
                    self.last = min(self.last, f.value + 1)
                    continue
                if isinstance(f, LessThan):
                    self.last = min(self.last, f.value)
                    continue
            yield f

    def samples(self, first: int, last: int) -> np.ndarray:
        """Samples by saved channels of [first, last)."""
        raise NotImplementedError

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.last <= span.first:
            return
        if self.form == "tile":
            lo, hi = max(self.first, span.first - self.halo), min(self.last, span.last + self.halo)
            whole = self.samples(lo, hi)[:, : self.signal].T
            a, b = span.first - lo, min(span.last - lo, whole.shape[1])
            packed = lambda m: pa.array([np.ascontiguousarray(m).tobytes() if m.shape[1] else None], pa.binary())
            columns = {"tile_id": pa.array([span.first]), "t0": pa.array([span.first]), "n": pa.array([b - a], pa.int32()), "x": packed(whole[:, a:b]), "left": packed(whole[:, :a]), "right": packed(whole[:, b:])}
            names = ["tile_id", "t0", "n", "x", "left", "right"] if self.halo else ["t0", "n", "x"]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)
            return
        x = self.samples(span.first, span.last)[:, : self.signal]
        n = len(x)
        at = max(1, (1 << 18) // max(1, self.signal))
        for lo in range(0, n, at):
            part = x[lo : lo + at]
            ch = np.tile(np.arange(self.signal, dtype=np.int32), len(part))
            t = np.repeat(np.arange(span.first + lo, span.first + lo + len(part), dtype=np.int64), self.signal)
            yield pa.RecordBatch.from_arrays([pa.array(ch), pa.array(t), pa.array(part.astype(np.float64).ravel() * self.scale)], names=["ch", "t", "uv"])


class RawReader(_Reader):
    def partitions(self) -> list[Span]:
        return [Span(lo, min(lo + self.per_task, self.last)) for lo in range(self.first, self.last, self.per_task)] or [Span(0, 0)]

    def samples(self, first: int, last: int) -> np.ndarray:
        with open_binary(self.path) as f:
            f.seek(first * self.channels * 2)
            data = f.read((last - first) * self.channels * 2)
        there = len(data) // (2 * self.channels)
        x = np.zeros((last - first, self.channels), "<i2")  # samples that the file lacks are 0
        x[:there] = np.frombuffer(data[: there * 2 * self.channels], "<i2").reshape(-1, self.channels)
        return x


def read_header(path: str) -> dict:
    """The .ch file beside a .cbin file."""
    with open_binary(path[: -len(".cbin")] + ".ch") as f:
        header = json.loads(f.read().decode("utf-8"))
    needed = ("chunk_bounds", "chunk_offsets", "chunk_order", "do_spatial_diff", "do_time_diff", "dtype", "n_channels")
    if lost := [k for k in needed if k not in header]:
        raise ValueError(f"{path}: the header lacks {', '.join(lost)}")
    if header["dtype"] != "int16":
        raise ValueError(f"{path}: samples of type {header['dtype']}; only int16 is read")
    return header


def decode_chunk(data: bytes, n: int, header: dict) -> np.ndarray:
    """Samples by channels of one compressed chunk; sums wrap around as the differences did."""
    raw = zlib.decompress(data)
    channels = header["n_channels"]
    if len(raw) != n * channels * 2:
        raise ValueError(f"a chunk of {len(raw)} bytes; {n * channels * 2} expected")
    x = np.frombuffer(raw, "<i2").reshape((n, channels), order="F" if header["chunk_order"] == "F" else "C")
    if header["do_spatial_diff"]:
        x = np.cumsum(x, axis=1, dtype=np.int16)
    if header["do_time_diff"]:
        x = np.cumsum(x, axis=0, dtype=np.int16)
    return x


class CbinReader(_Reader):
    def __init__(self, options: dict):
        self.header = read_header(options["path"])
        bounds = self.header["chunk_bounds"]
        super().__init__({"channels": self.header["n_channels"], "n_samples": bounds[-1]} | options)

    def _touched(self, first: int, last: int) -> list[tuple[int, int, int]]:
        """(chunk, first, last) of the chunks that hold samples of [first, last)."""
        bounds = self.header["chunk_bounds"]
        return [(k, max(lo, first), min(hi, last)) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if lo < last and hi > first]

    def partitions(self) -> list[Span]:
        return [Span(lo, hi) for _, lo, hi in self._touched(self.first, self.last)] or [Span(0, 0)]

    def _chunk(self, k: int) -> np.ndarray:
        lo, hi = self.header["chunk_bounds"][k : k + 2]
        begin, end = self.header["chunk_offsets"][k : k + 2]
        try:
            with open_binary(self.path) as f:
                f.seek(begin)
                return decode_chunk(f.read(end - begin), hi - lo, self.header)
        except (ValueError, zlib.error, OSError):
            if not self.zero:
                raise
            return np.zeros((hi - lo, self.header["n_channels"]), np.int16)

    def samples(self, first: int, last: int) -> np.ndarray:
        bounds = self.header["chunk_bounds"]
        return np.concatenate([self._chunk(k)[lo - bounds[k] : hi - bounds[k]] for k, lo, hi in self._touched(first, last)])


def reader_of(path: str, options: dict) -> _Reader:
    """The reader of a recording by its file's ending; options as for the sources."""
    return (CbinReader if path.endswith(".cbin") else RawReader)({k: str(v) for k, v in options.items()} | {"path": path})


class RawWriter(DataSourceArrowWriter):
    """Tiles (t0, n, x) as ranges of one interleaved int16 file: each task writes its own, in any order.

    The file gets its size first, so a range written again, by a task that is run again, changes nothing. What a
    tile holds beyond that size is not written.
    """

    def __init__(self, options: dict):
        self.path = local_file(options["path"])
        self.channels, self.total = int(options["channels"]), int(options["n_samples"])
        self.fill = int(options.get("fill", 0))
        with open(self.path, "wb") as f:
            f.truncate(self.total * self.channels * 2)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        with open(self.path, "r+b") as f:
            for batch in iterator:
                for t0, n, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    n, own = min(n, max(0, self.total - t0)), np.frombuffer(x, "<i2").reshape(-1, n)
                    own = own[:, :n]
                    whole = np.full((n, self.channels), self.fill, "<i2")  # channels beyond the tile's, as the sync channel
                    whole[:, : len(own)] = own.T
                    f.seek(t0 * self.channels * 2)
                    f.write(whole.tobytes())
        return WriterCommitMessage()

    def abort(self, messages: list) -> None:
        Path(self.path).unlink(missing_ok=True)


def local_file(path: str) -> str:
    """A path to write ranges of: in a folder that driver and executors have mounted."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: ranges of a file are written to a mounted folder only")
    return path.removeprefix("file://")


def encode_chunk(x: np.ndarray, order: str = "F", spatial: bool = True, time: bool = True) -> bytes:
    """Samples by channels as one compressed chunk; what `decode_chunk` reverses."""
    x = x.astype(np.int16)
    if time:
        x = np.concatenate((x[:1], x[1:] - x[:-1]))
    if spatial:
        x = np.concatenate((x[:, :1], x[:, 1:] - x[:, :-1]), 1)
    return zlib.compress(x.tobytes(order))


def write_cbin(tiles: DataFrame, path: str, channels: int, fill: int = 0, order: str = "F", spatial: bool = True, time: bool = True) -> None:
    """Tiles (t0, n, x) as a chunk-compressed file, a chunk for each tile, and its header.

    Chunks are compressed by the tasks that have the tiles and kept in a table; their sizes, which the header lists,
    give each its place in the file, where tasks write them.
    """
    path = local_file(path)

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for t0, n, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(x, "<i2").reshape(-1, n)
                whole = np.full((n, channels), fill, np.int16)
                whole[:, : len(own)] = own.T
                yield pa.RecordBatch.from_arrays([pa.array([t0]), pa.array([n], pa.int32()), pa.array([encode_chunk(whole, order, spatial, time)], pa.binary())], names=["t0", "n", "data"])

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as f:
            for batch in it:
                for at, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                    f.seek(at)
                    f.write(data)
                yield batch.select(["at"])

    chunks = materialize(tiles.select("t0", "n", "x").mapInArrow(packed, "t0 long, n int, data binary"), "chunks")
    sizes = chunks.select("t0", "n", F.octet_length("data").alias("size")).orderBy("t0").collect()
    offsets = [0, *itertools.accumulate(r["size"] for r in sizes)]
    header = {"chunk_bounds": [r["t0"] for r in sizes] + [sizes[-1]["t0"] + sizes[-1]["n"] if sizes else 0], "chunk_offsets": offsets, "chunk_order": order, "do_spatial_diff": spatial, "do_time_diff": time, "dtype": "int16", "n_channels": channels}
    with open(path, "wb") as f:
        f.truncate(offsets[-1])
    places = tiles.sparkSession.createDataFrame([(r["t0"], at) for r, at in zip(sizes, offsets, strict=False)], "t0 long, at long")
    chunks.join(places, "t0").select("at", "data").mapInArrow(put, "at long").write.format("noop").mode("overwrite").save()
    Path(path).with_suffix(".ch").write_text(json.dumps(header))


class _Source(DataSource):
    made: type[_Reader]

    def schema(self) -> str:
        return (HALO_TILE if int(self.options.get("halo", 0)) else TILE) if self.options.get("form") == "tile" else LONG

    def reader(self, schema) -> _Reader:
        return self.made(dict(self.options))


class RawSource(_Source):
    made = RawReader

    @classmethod
    def name(cls) -> str:
        return "tracewell_raw"

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(dict(self.options))


class CbinSource(_Source):
    made = CbinReader

    @classmethod
    def name(cls) -> str:
        return "tracewell_cbin"


@dataclass
class RecordingSpan(InputPartition):
    """Samples [first, last) of one of many recordings, and what its side-car files say about it."""

    recording: str
    options: dict
    first: int
    last: int


class RecordingsReader(DataSourceReader):
    """Many recordings, raw or compressed, as one table with the column `recording`, the file's path.

    Recordings and their lengths are known when the table is planned: their side-car files are read, by the file
    system that the paths are of. Limits on `recording` and `t` leave out files and samples before anything is read.
    """

    def __init__(self, options: dict):
        self.options = {k: v for k, v in options.items() if k != "path"}
        self.paths = sorted(p for pattern in options["path"].split(",") for p in find(pattern.strip()) if p.endswith((".bin", ".dat", ".cbin")))
        self.limits: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("recording",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = [p for p in self.paths if p in wanted]
            elif name == ("t",) and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and self.options.get("form", "long") == "long":
                self.limits.append(f)
            else:
                yield f

    def _planned(self, path: str) -> list[RecordingSpan]:
        options = recording_options(path) | self.options
        reader = reader_of(path, options)
        for _ in reader.pushFilters(self.limits):
            pass
        options |= {"first": reader.first, "n": max(0, reader.last - reader.first)}
        return [RecordingSpan(path, options, s.first, s.last) for s in reader.partitions() if s.last > s.first]

    def partitions(self) -> list[RecordingSpan]:
        with ThreadPoolExecutor(16) as pool:
            return [s for spans in pool.map(self._planned, self.paths) for s in spans] or [RecordingSpan("", {}, 0, 0)]

    def read(self, span: RecordingSpan) -> Iterator[pa.RecordBatch]:
        if not span.recording:
            return
        for batch in reader_of(span.recording, span.options).read(Span(span.first, span.last)):
            name = pa.array([span.recording] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([name, *batch.columns], names=["recording", *batch.schema.names])


class RecordingsSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "tracewell_recordings"

    def schema(self) -> str:
        return "recording string, " + super().schema()

    def reader(self, schema) -> RecordingsReader:
        return RecordingsReader(dict(self.options))


def recording_options(path: str) -> dict:
    """What the readers need to know of a recording, from its side-car files."""
    from tracewell.sources.sidecar import find_meta

    meta = find_meta(path)
    known = {"channels": meta.n_saved_chans, "signal_channels": meta.n_chans, "n_samples": meta.n_samples, "uv_per_bit": meta.uv_per_bit}
    if path.endswith(".cbin"):
        known["n_samples"] = min(meta.n_samples, read_header(path)["chunk_bounds"][-1])
    return known


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let limits on t reach their readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawSource)
    spark.dataSource.register(CbinSource)
    spark.dataSource.register(RecordingsSource)


def open_recording(spark: SparkSession, path: str, first: int = 0, n: int | None = None, **options) -> DataFrame:
    """(ch, t, uv) of a window of a recording, raw or compressed, scaled by its side-car files."""
    register(spark)
    known = recording_options(path) | {"first": first} | options
    if n is not None:
        known["n"] = n
    return spark.read.format("tracewell_cbin" if path.endswith(".cbin") else "tracewell_raw").options(**{k: str(v) for k, v in known.items()}).load(path)
