"""A recording as an object: metadata, rows, windows and tiles of a file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tracewell.model import Meta, PreprocConfig
from tracewell.operators import geometry, signal, tiles
from tracewell.sources.recording import open_recording
from tracewell.sources.sidecar import channels_frame, find_meta


@dataclass
class Recording:
    """A raw or compressed file with its side-car metadata. All frames are lazy."""

    spark: SparkSession
    path: str
    meta: Meta

    @staticmethod
    def open(spark: SparkSession, path: str) -> Recording:
        return Recording(spark, path, find_meta(path))

    def config(self, **changes) -> PreprocConfig:
        """The default configuration at this recording's rate and probe."""
        return PreprocConfig(self.meta.sample_rate, probe_type=self.meta.probe_type).with_(**changes)

    def channels(self) -> DataFrame:
        return channels_frame(self.spark, self.meta)

    def rows(self, avg_depths: bool = True) -> DataFrame:
        """Display rows of the probe."""
        return geometry.display_rows(self.channels(), avg_depths)

    def samples(self, first: int = 0, n: int | None = None, **options) -> DataFrame:
        """(ch, t, uv) of a window; only its samples are read."""
        return open_recording(self.spark, self.path, first, n, **options)

    def preprocessed(self, cfg: PreprocConfig, first: int = 0, n: int | None = None) -> DataFrame:
        """The relational form of a window, for windows of some seconds."""
        rows = self.rows(cfg.avg_depths)
        return signal.preprocess(signal.depth_average(self.samples(first, n), rows), rows, cfg)

    def preprocessed_tiles(self, cfg: PreprocConfig, first: int = 0, n: int | None = None, size: int = 1 << 16) -> DataFrame:
        """The tile form of a window or of the whole recording: one task per `size` samples, or per chunk of a compressed file, which reads its halo itself."""
        cut = self.samples(first, n, form="tile", samples_per_task=size, halo=tiles.halo_of(cfg))
        return tiles.preprocess_tiles(cut, self.rows(cfg.avg_depths), cfg, self.meta.uv_per_bit)

    def explode(self, done: DataFrame, rows: DataFrame) -> DataFrame:
        return tiles.explode_tiles(done, tiles.RowModel.of(rows))

    def below(self, done: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
        return tiles.below(done, tiles.RowModel.of(rows), threshold)
