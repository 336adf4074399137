"""A PNG file from a table of pixels, and its chunks as a DataFrame."""

from __future__ import annotations

import itertools
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tracewell.sources.recording import local_file

SIGNATURE = bytes.fromhex("89504e470d0a1a0a")


def scanlines(pixels: DataFrame) -> DataFrame:
    """(py, line): the bytes of each line of (py, px, r, g, b, a), after a filter byte of 0."""
    byte = lambda c: F.unhex(F.lpad(F.hex(F.col(c)), 2, "0"))
    points = pixels.select("py", "px", F.hex(F.concat(byte("r"), byte("g"), byte("b"), byte("a"))).alias("v"))
    whole = points.groupBy("py").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("px", "v"))), lambda p: p["v"]), "").alias("v"))
    return whole.select("py", F.unhex(F.concat(F.lit("00"), "v")).alias("line"))


def chunk(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


def png_bytes(pixels: DataFrame, width: int, height: int) -> bytes:
    """The file: 8-bit RGBA, one data chunk. A picture is as large as a screen, so its lines are collected; `save_png` does without."""
    if width <= 0 or height <= 0:
        raise ValueError("an empty picture")
    lines = [bytes(r["line"]) for r in scanlines(pixels).orderBy("py").collect()]
    if len(lines) < height or any(len(x) < 1 + 4 * width for x in lines):
        raise ValueError(f"too few pixels for a picture of {width} by {height}")
    body = b"".join(x[: 1 + 4 * width] for x in lines[:height])
    return SIGNATURE + chunk(b"IHDR", header(width, height)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def header(width: int, height: int) -> bytes:
    return struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)


def adler_joined(a: int, b: int, n: int) -> int:
    """The Adler-32 of two texts in a row from that of each; the second has `n` bytes."""
    prime = 65521
    low, high, low2, high2 = a & 0xFFFF, a >> 16, b & 0xFFFF, b >> 16
    return ((high + high2 + n * (low - 1)) % prime) << 16 | (low + low2 - 1) % prime


@dataclass
class Piece(WriterCommitMessage):
    """What a task has written: lines [first, first + n) as one data chunk of its own."""

    file: str
    first: int
    n: int
    size: int
    adler: int


class PngWriter(DataSourceArrowWriter):
    """Lines (py, line) in order, each task a range of them, as one file.

    A task compresses its lines into a data chunk that ends on a byte, with its own checksum, and writes it beside
    the file. The commit puts header, chunks and end in order; from a task it has the checksums and sizes only.
    """

    def __init__(self, options: dict):
        self.path, self.width, self.height = local_file(options["path"]), int(options["width"]), int(options["height"])
        if self.width <= 0 or self.height <= 0:
            raise ValueError("an empty picture")
        self.folder = f"{self.path}.parts"
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Piece:
        deflate = zlib.compressobj(wbits=-15)
        data, adler, n, size, first = [], 1, 0, 0, -1
        for batch in iterator:
            for py, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if py >= self.height:
                    continue
                first = py if first < 0 else first
                if py != first + n or len(line) < 1 + 4 * self.width:
                    raise ValueError(f"too few pixels for a picture of {self.width} by {self.height}: line {py}")
                own = line[: 1 + 4 * self.width]
                data.append(deflate.compress(own))
                adler, n, size = zlib.adler32(own, adler), n + 1, size + len(own)
        file = f"{self.folder}/{uuid.uuid4().hex}"
        with open(file, "wb") as f:
            f.write(chunk(b"IDAT", b"".join(data) + deflate.flush(zlib.Z_FULL_FLUSH)) if n else b"")
        return Piece(file, first, n, size, adler)

    def commit(self, messages: list) -> None:
        pieces = sorted((m for m in messages if m is not None and m.n), key=lambda m: m.first)
        ends = [0, *itertools.accumulate(p.n for p in pieces)]
        if [p.first for p in pieces] != ends[:-1] or ends[-1] != self.height:
            self.abort(messages)
            raise ValueError(f"too few pixels for a picture of {self.width} by {self.height}")
        adler = 1
        with open(self.path, "wb") as f:
            f.write(SIGNATURE + chunk(b"IHDR", header(self.width, self.height)) + chunk(b"IDAT", b"\x78\x9c"))
            for p in pieces:
                with open(p.file, "rb") as own:
                    shutil.copyfileobj(own, f)
                adler = adler_joined(adler, p.adler, p.size)
            f.write(chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + chunk(b"IEND", b""))
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class PngSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracewell_png"

    def writer(self, schema, overwrite: bool) -> PngWriter:
        return PngWriter(dict(self.options))


def save_png(pixels: DataFrame, width: int, height: int, path: str, parts: int | None = None) -> None:
    """A picture file of (py, px, r, g, b, a), its lines dealt out by range, to so many tasks if `parts` is given."""
    pixels.sparkSession.dataSource.register(PngSource)
    lines = scanlines(pixels).select(F.col("py").cast("int").alias("py"), "line").repartitionByRange(*([parts] if parts else []), "py").sortWithinPartitions("py")
    lines.write.format("tracewell_png").mode("append").options(path=path, width=width, height=height).save()


def pixels_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, py, px, r, g, b, a) of picture files of 8-bit RGBA without line filters, as `save_png` writes them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, body, size = len(SIGNATURE), [], (0, 0)
                while at < len(data):
                    n, tag = struct.unpack(">I4s", data[at : at + 8])
                    own, crc = data[at + 8 : at + 8 + n], struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
                    if zlib.crc32(tag + own) != crc:
                        raise ValueError(f"{name}: a chunk of a wrong checksum")
                    if tag == b"IHDR":
                        size = struct.unpack(">II", own[:8])
                    elif tag == b"IDAT":
                        body.append(own)
                    at += 12 + n
                lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], 1 + 4 * size[0])
                if lines[:, 0].any():
                    raise ValueError(f"{name}: lines with a filter")
                x = lines[:, 1:].reshape(-1, 4).astype(np.int32)
                py, px = np.divmod(np.arange(len(x), dtype=np.int32), size[0])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), *map(pa.array, (py, px, *x.T))], names=["path", "py", "px", *"rgba"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, py int, px int, r int, g int, b int, a int")


def chunk_checks(chunks: DataFrame) -> DataFrame:
    """(tag, size, crc) of chunks (tag string, data binary)."""
    return chunks.select("tag", F.octet_length("data").alias("size"), F.lower(F.lpad(F.hex(F.crc32(F.concat(F.col("tag").cast("binary"), "data"))), 8, "0")).alias("crc"))


def export_name(recording: str, stims: str) -> str:
    """The file name of an exported event average."""
    stem = lambda p: os.path.splitext(os.path.basename(p))[0]
    return f"{stem(recording)}_{stem(stims)}_psth.png"
