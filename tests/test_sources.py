"""Files: recordings in both forms, their side-cars, stimuli, preferences, pictures."""

import dataclasses
import itertools
import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions.filters import butter_highpass, sosfilt
from tracewell.model import PreprocConfig
from tracewell.operators import events, geometry, stats, tiles
from tracewell.recording import Recording
from tracewell.sources import png, prefs, recording, sidecar, stimuli
from tracewell.streaming import live

META = "nSavedChans=4\nimSampRate=30000\nfileSizeBytes={size}\nsnsApLfSy=3,0,1\nimAiRangeMax=0.6\nimMaxInt=512\nimChan0apGain=500\n~snsGeomMap=(NP1000,1,0,70)(0:27:0:1)(0:59:20:1)(1:300:0:1)\n"


def write_cbin(x, path, chunk, order="F", spatial=True, time=True):
    """A chunk-compressed copy of samples by channels, with its header file."""
    bounds, offsets = [*range(0, len(x), chunk), len(x)], [0]
    with open(path, "wb") as f:
        for lo, hi in itertools.pairwise(bounds):
            f.write(recording.encode_chunk(x[lo:hi], order, spatial, time))
            offsets.append(f.tell())
    header = {"chunk_bounds": bounds, "chunk_offsets": offsets, "chunk_order": order, "do_spatial_diff": spatial, "do_time_diff": time, "dtype": "int16", "n_channels": x.shape[1]}
    with open(path[: -len(".cbin")] + ".ch", "w") as f:
        json.dump(header, f)


@pytest.fixture
def x():
    return np.random.default_rng(1).integers(-32768, 32767, (1000, 4)).astype("<i2")


def values(df, n=1000, rows=3):
    out = np.full((n, rows), np.nan)
    for r in df.collect():
        out[r.t, r.ch] = r.uv
    return out


def test_raw_recording_with_meta(spark, tmp_path, x):
    path = str(tmp_path / "a.ap.bin")
    x.tofile(path)
    (tmp_path / "a.ap.meta").write_text(META.format(size=x.nbytes))
    scale = 0.6 / 512 / 500 * 1e6
    found = recording.open_recording(spark, path, 100, 300, samples_per_task=70)
    got = values(found)
    assert np.allclose(got[100:400], x[100:400, :3] * scale) and np.isnan(got[:100]).all() and np.isnan(got[400:]).all()
    meta = sidecar.find_meta(path)
    assert meta.n_samples == 1000 and meta.channels[2] == sidecar.Channel(2, 300.0, 0.0, 1)
    assert recording.open_recording(spark, path, 990, 300).count() == 30
    assert recording.open_recording(spark, path, 5000, 10).count() == 0
    assert sidecar.channels_frame(spark, meta).count() == 3


def test_recording_from_file_to_spikes(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 12_000
    x = (rng.normal(size=(n, 4)) * 60).astype("<i2")
    path = str(tmp_path / "b.ap.bin")
    x.tofile(path)
    (tmp_path / "b.ap.meta").write_text(META.format(size=x.nbytes))
    r = Recording.open(spark, path)
    cfg = r.config(avg_depths=False)
    rows = r.rows(avg_depths=False)
    whole = r.preprocessed(cfg)
    tiles = r.preprocessed_tiles(cfg, size=4000)
    a = {(v.row_idx, v.t): v.uv for v in whole.collect()}
    b = {(v.row_idx, v.t): v.uv for v in r.explode(tiles, rows).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-2
    threshold = -250.0
    sparse = r.below(tiles, rows, threshold)
    assert sorted((v.row_idx, v.t) for v in sparse.collect()) == sorted(k for k in b if b[k] < threshold)
    one, two = (sorted(map(tuple, stats.spike_count(t, rows, threshold, cfg.refractory).collect())) for t in (r.explode(tiles, rows), sparse))
    assert one == two and sum(k[1] for k in one) > 0


def test_time_limits_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    r = recording.RawReader({"path": "x", "channels": 2, "n_samples": 1000, "uv_per_bit": 1, "samples_per_task": 100})
    left = list(r.pushFilters([GreaterThanOrEqual(("t",), 250), LessThan(("t",), 380), EqualTo(("ch",), 1)]))
    assert len(left) == 1 and [(s.first, s.last) for s in r.partitions()] == [(250, 350), (350, 380)]


@pytest.mark.parametrize(("order", "spatial", "time"), list(itertools.product("FC", (True, False), (True, False))))
def test_cbin_round_trip(spark, tmp_path, x, order, spatial, time):
    path = str(tmp_path / "a.ap.cbin")
    write_cbin(x, path, 300, order, spatial, time)
    recording.register(spark)
    df = spark.read.format("tracewell_cbin").options(uv_per_bit=1, first=250, n=100).load(path)
    assert np.array_equal(values(df, rows=4)[250:350], x[250:350]) and df.count() == 400


@pytest.mark.parametrize("kind", ["raw", "cbin"])
def test_tiles_with_halo(spark, tmp_path, x, kind):
    path = str(tmp_path / ("a.bin" if kind == "raw" else "a.cbin"))
    x.tofile(path) if kind == "raw" else write_cbin(x, path, 300)
    recording.register(spark)
    options = {"channels": 4, "n_samples": 1000, "uv_per_bit": 1, "samples_per_task": 300, "form": "tile", "halo": 350, "first": 100, "n": 850}
    rows = spark.read.format(f"tracewell_{kind}").options(**options).load(path).orderBy("t0").collect()
    assert rows[0].t0 == 100 and rows[0].left is None and rows[-1].right is None and sum(r.n for r in rows) == 850
    for r in rows:
        parts = [np.frombuffer(p, "<i2").reshape(4, -1) if p is not None else x[:0].T for p in (r.left, r.x, r.right)]
        lo, hi = max(100, r.t0 - 350), min(950, r.t0 + r.n + 350)
        assert np.array_equal(np.concatenate(parts, 1), x[lo:hi].T) and parts[0].shape[1] == r.t0 - lo


def test_broken_chunk(spark, tmp_path, x):
    path = str(tmp_path / "a.ap.cbin")
    write_cbin(x, path, 300)
    data = bytearray(open(path, "rb").read())
    data[5] ^= 0xFF
    open(path, "wb").write(data)
    recording.register(spark)
    with pytest.raises(Exception, match="(?i)decompress|chunk"):
        spark.read.format("tracewell_cbin").options(uv_per_bit=1).load(path).count()
    df = spark.read.format("tracewell_cbin").options(uv_per_bit=1, on_error="zero").load(path)
    got = values(df, rows=4)
    assert (got[:300] == 0).all() and np.array_equal(got[300:], x[300:])


def test_cbin_header_checks(tmp_path):
    (tmp_path / "a.ch").write_text(json.dumps({"chunk_bounds": [0]}))
    with pytest.raises(ValueError, match="lacks"):
        recording.read_header(str(tmp_path / "a.cbin"))


def test_tile_form(spark, tmp_path, x):
    path = str(tmp_path / "a.bin")
    x.tofile(path)
    recording.register(spark)
    df = spark.read.format("tracewell_raw").options(channels=4, signal_channels=3, n_samples=1000, uv_per_bit=1, samples_per_task=400, form="tile").load(path)
    rows = {r.t0: np.frombuffer(r.x, "<i2").reshape(3, r.n) for r in df.collect()}
    assert sorted(rows) == [0, 400, 800] and np.array_equal(np.concatenate([rows[k] for k in sorted(rows)], 1), x[:, :3].T)


def open_ephys(tmp_path, folder="probeA"):
    base = tmp_path / "rec" / "experiment1"
    data = base / "continuous" / folder
    os.makedirs(data)
    stream = {"folder_name": folder + "/", "sample_rate": 30000, "num_channels": 4, "source_processor_id": 7, "channels": [{"bit_volts": 0.195}] * 4}
    (base / "structure.oebin").write_text(json.dumps({"continuous": [{"folder_name": "other"}, stream]}))
    (tmp_path / "rec" / "settings.xml").write_text(
        '<S><PROCESSOR NodeId="3"/><PROCESSOR NodeId="7"><E><NP_PROBE probe_part_number="PRB2_4"><ELECTRODE_XPOS CH0="0" CH2="250"/><ELECTRODE_YPOS CH0="5" CH2="40"/></NP_PROBE></E></PROCESSOR></S>'
    )
    return data


def test_open_ephys(spark, tmp_path, x):
    data = open_ephys(tmp_path)
    x.tofile(str(data / "continuous.dat"))
    meta = sidecar.find_meta(str(data / "continuous.dat"))
    assert (meta.n_chans, meta.n_samples, meta.uv_per_bit, meta.probe_type) == (4, 1000, 0.195, 21)
    assert [(c.x_um, c.y_um, c.shank) for c in meta.channels] == [(0, 5, 0), (0, 5, 0), (250, 40, 1), (250, 40, 1)]
    assert np.allclose(values(recording.open_recording(spark, str(data / "continuous.dat")), rows=4), x * 0.195)
    write_cbin(x, str(data / "c.cbin"), 300)
    assert sidecar.find_meta(str(data / "c.cbin")).n_samples == 1000


def test_no_sidecar(tmp_path):
    with pytest.raises(FileNotFoundError):
        sidecar.find_meta(str(tmp_path / "a.bin"))
    (tmp_path / "a.meta").write_text("nSavedChans=4\n")
    with pytest.raises(ValueError, match="required"):
        sidecar.find_meta(str(tmp_path / "a.bin"))


def test_meta_frame_agrees_with_the_driver(spark, tmp_path):
    texts = [META.format(size=8008), "nSavedChans=385\nimSampRate=2500\nfileSizeBytes=770000\nsnsApLfSy=0,384,1\n", "nSavedChans=5\nimSampRate=1\nfileSizeBytes=100\nimMaxInt=x\n", "imSampRate=1\n"]
    frame = sidecar.parse_meta(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string"))
    got = {r.path: r for r in frame.collect()}
    for i, t in enumerate(texts[:3]):
        (tmp_path / "m.meta").write_text(t)
        m = sidecar.read_meta(str(tmp_path / "m.meta"))
        r = got[str(i)]
        assert (r.n_saved_chans, r.n_chans, r.sample_rate, r.n_samples, r.probe_type, r.error) == (m.n_saved_chans, m.n_chans, m.sample_rate, m.n_samples, m.probe_type, None)
        assert np.isclose(r.uv_per_bit, m.uv_per_bit)
    assert got["3"].error


def test_geometry_without_a_map(spark):
    maps = spark.createDataFrame([("a", None, 3), ("b", "(0:1:2:1)", 2), ("c", "", 0)], "path string, geom_map string, n_chans int")
    got = sorted((r.path, r.ch, r.x_um, r.y_um) for r in sidecar.parse_geom_map(maps).collect())
    assert got == [("a", 0, 0.0, 0.0), ("a", 1, 0.0, 20.0), ("a", 2, 0.0, 40.0), ("b", 0, 1.0, 2.0), ("b", 1, 0.0, 0.0)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "latin-1"])
def test_stimulus_files(spark, tmp_path, encoding):
    (tmp_path / "s.csv").write_bytes("häder,x\n1.5,9\n\n2,9\n".encode(encoding))
    (tmp_path / "stims_file_layout.csv").write_text("h\n\nO,x,x\n")
    layout = stimuli.resolve_layout(str(tmp_path / "s.csv"), "/nowhere")
    assert layout == stimuli.StimLayout(1, (0,))
    assert [(r.stim_idx, r.onset_s) for r in stimuli.load_stims(spark, str(tmp_path / "s.csv"), layout).orderBy("stim_idx").collect()] == [(0, 1.5), (1, 2.0)]
    assert stimuli.decode_text((tmp_path / "s.csv").read_bytes()).startswith("häder")


@pytest.mark.parametrize(("text", "cols", "message"), [("h\n1\n", (1,), "marked as onset"), ("h\n1x\n", (0,), "no number"), ("h\n5d\n", (0,), "no number"), ("h\n", (0,), "no stimulus times")])
def test_stimulus_errors(spark, tmp_path, text, cols, message):
    (tmp_path / "s.txt").write_text(text)
    with pytest.raises(Exception, match=message):
        stimuli.load_stims(spark, str(tmp_path / "s.txt"), stimuli.StimLayout(1, cols)).collect()


def test_layouts(tmp_path):
    with pytest.raises(ValueError):
        stimuli.parse_layout("a,b\nx,x\n")
    with pytest.raises(FileNotFoundError):
        stimuli.resolve_layout(str(tmp_path / "s.csv"), str(tmp_path / "none"))
    stimuli.write_default_layout(str(tmp_path / "config" / "d.csv"))
    assert stimuli.resolve_layout(str(tmp_path / "s.csv"), str(tmp_path / "config" / "d.csv")) == stimuli.StimLayout(1, (0,))


PREFS = """view_dur_s = 1.25
color_mode = "Voltage"
color_pct = 97.5
color_uv = 120.0
colormap_choice = "Vanimo"
spike_threshold = -35.0
mem_reserve_mb = 800.5
last_dir = "/data"
something_else = 1

[preproc_cfg]
dc_removal = false
phase_shift = true
highpass = false
spatial_filter = "LocalCmr"
avg_depths = false
sample_rate = 2500.0
im_dat_prb_type = 24
"""


def test_preferences(tmp_path):
    path = str(tmp_path / "p" / "prefs.toml")
    mine = prefs.Preferences(preproc=PreprocConfig(20_000.0, phase_shift=True, spatial="destripe"), colormap="Vanimo", view_s=1.25, last_dir="a b")
    prefs.save_preferences(mine, path)
    got = prefs.load_preferences(path, 30_000.0, 21)
    assert got == dataclasses.replace(mine, preproc=mine.preproc.with_(sample_rate=30_000.0, probe_type=21))
    assert prefs.load_preferences(str(tmp_path / "none"), 1.0, 0, legacy=path) is not None
    (tmp_path / "bad.toml").write_text("= nothing")
    assert prefs.load_preferences(str(tmp_path / "bad.toml"), 1.0, 0) is None


def test_preferences_of_another_program(tmp_path):
    path = tmp_path / "prefs.toml"
    path.write_text(PREFS)
    got = prefs.load_preferences(str(path), 30_000.0, 0)
    assert got == prefs.Preferences(PreprocConfig(30_000.0, False, True, False, "local_cmr", False, 0), 1.25, "Voltage", 97.5, 120.0, "Vanimo", -35.0, memory_reserve_mb=800.5, last_dir="/data")
    for line in ('color_mode = "Voltage"', "view_dur_s = 1.25", 'spatial_filter = "LocalCmr"', "highpass = false"):
        path.write_text(PREFS.replace(line, ""))
        assert prefs.load_preferences(str(path), 30_000.0, 0) is None
    path.write_text(PREFS.replace("Vanimo", "Plaid"))
    assert prefs.load_preferences(str(path), 30_000.0, 0) is None


def test_png(spark, tmp_path):
    pixels = spark.createDataFrame([(y, x, 10 * x, y, 7, 255) for y in range(3) for x in range(4)], "py int, px int, r int, g int, b int, a int")
    path = str(tmp_path / png.export_name("/d/rec.ap.bin", "/d/stims.csv"))
    assert path.endswith("rec.ap_stims_psth.png")
    data = png.png_bytes(pixels, 4, 3)
    assert data[:8] == png.SIGNATURE and data[-4:].hex() == "ae426082"
    open(path, "wb").write(data)
    assert png.pixels_of(spark, path).count() == 12
    size = int.from_bytes(data[33:37], "big")
    lines = zlib.decompress(data[41 : 41 + size])
    assert lines == b"".join(b"\0" + bytes(v for x in range(4) for v in (10 * x, y, 7, 255)) for y in range(3))
    for bad in ((0, 3), (5, 3), (4, 4)):
        with pytest.raises(ValueError):
            png.png_bytes(pixels, *bad)


def picture(spark, width, height):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (height, width, 4))
    rows = [(y, c, *map(int, x[y, c])) for y in range(height) for c in range(width)]
    return x, spark.createDataFrame(rows, "py int, px int, r int, g int, b int, a int").repartition(5)


def test_picture_is_written_in_pieces(spark, tmp_path):
    x, pixels = picture(spark, 13, 29)
    path = str(tmp_path / "p.png")
    png.save_png(pixels, 13, 29, path, parts=4)
    data = open(path, "rb").read()
    assert data.count(b"IDAT") > 3 and data.startswith(png.SIGNATURE)  # pieces of several tasks
    got = {(r.py, r.px): (r.r, r.g, r.b, r.a) for r in png.pixels_of(spark, path).collect()}
    assert got == {(y, c): tuple(map(int, x[y, c])) for y in range(29) for c in range(13)}
    assert not (tmp_path / "p.png.parts").exists()
    png.save_png(pixels, 7, 20, path)  # a cut of it
    assert {(r.py, r.px) for r in png.pixels_of(spark, path).collect()} == {(y, c) for y in range(20) for c in range(7)}
    open(path, "wb").write(data[:60] + bytes([data[60] ^ 1]) + data[61:])
    with pytest.raises(Exception, match="checksum"):
        png.pixels_of(spark, path).count()


@pytest.mark.parametrize("where, size", [("py <> 5", (4, 9)), ("py <> 8", (4, 9)), ("NOT (py = 3 AND px = 3)", (4, 9)), ("true", (5, 9)), ("true", (0, 9))])
def test_pictures_that_lack_pixels_raise(spark, tmp_path, where, size):
    _, pixels = picture(spark, 4, 9)
    with pytest.raises(Exception, match="too few pixels|empty picture"):
        png.save_png(pixels.where(where), *size, str(tmp_path / "p.png"))


def test_checksums_of_pieces_join():
    rng = np.random.default_rng(0)
    a, b = rng.bytes(70_001), rng.bytes(9_999)
    assert png.adler_joined(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    assert png.adler_joined(1, zlib.adler32(b), len(b)) == zlib.adler32(b) and png.adler_joined(zlib.adler32(a), 1, 0) == zlib.adler32(a)


def test_live_spikes(spark, tmp_path):
    rng, cfg = np.random.default_rng(3), PreprocConfig(1000.0)
    x = rng.normal(scale=300, size=(900, 2)).astype("<i2")
    path = str(tmp_path / "live.bin")
    x[:500].tofile(path)
    stream = live.read_stream(spark, path, channels=2, uv_per_bit=0.1, samples_per_task=200)
    query = live.live_spikes(stream, cfg, -20.0).writeStream.format("memory").queryName("spikes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        for _ in range(3):
            query.processAllAvailable()
        with open(path, "ab") as f:
            f.write(x[500:].tobytes())
        for _ in range(3):
            query.processAllAvailable()
        got = sorted((r.ch, r.t) for r in spark.sql("SELECT * FROM spikes").collect())
    finally:
        query.stop()
    sections, want = butter_highpass(3, cfg.highpass_wn), []
    for ch in range(2):
        y = sosfilt(sections, x[:, ch] * 0.1)[0]
        last = None
        for t in np.flatnonzero(y < -20.0):
            if last is None or t - last > cfg.refractory:
                last = int(t)
                want.append((ch, last))
    assert got == want


def test_a_stream_started_again_goes_on_where_it_stopped(spark, tmp_path):
    x = np.random.default_rng(1).integers(-99, 99, (7000, 2)).astype("<i2")
    path, target = str(tmp_path / "live.bin"), str(tmp_path / "out")
    x[:5000].tofile(path)

    def run():
        stream = live.read_stream(spark, path, channels=2, uv_per_bit=1, samples_per_task=700)
        query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        query.processAllAvailable()
        query.stop()

    run()
    with open(path, "ab") as f:
        f.write(x[5000:].tobytes())
    run()
    got = spark.read.parquet(target)
    assert got.count() == 14_000 and got.distinct().count() == 14_000
    assert np.array_equal(values(got, 7000, 2), x)


def test_short_file_is_read_as_if_zeros_followed(spark, tmp_path):
    x = np.arange(1, 301, dtype="<i2").reshape(100, 3)
    path = str(tmp_path / "a.bin")
    x.tofile(path)
    recording.register(spark)
    options = {"channels": 3, "n_samples": 150, "uv_per_bit": 1, "samples_per_task": 60}
    whole = spark.read.format("tracewell_raw").options(**options).load(path)
    assert whole.count() == 450 and whole.where("t >= 100 AND uv <> 0").count() == 0 and whole.where("t < 100 AND uv = 0").count() == 0
    tiles = spark.read.format("tracewell_raw").options(form="tile", **options).load(path).orderBy("t0").collect()
    assert [(r.t0, r.n, len(r.x)) for r in tiles] == [(0, 60, 360), (60, 60, 360), (120, 30, 180)]


def test_tabs_around_fields(spark):
    texts = spark.createDataFrame([("a", "\t5\t6\n\u00a0 7 8\t"), ("b", "1,\t2\n\t3 ,4\t")], "path string, text string")
    for col, want in ((0, [5.0, 7.0, 1.0, 3.0]), (1, [6.0, 8.0, 2.0, 4.0])):
        got = stimuli.stims_of(texts, stimuli.StimLayout(0, (col,))).orderBy("path", "stim_idx").collect()
        assert [r.onset_s for r in got] == want


def tiles_frame(spark, x, size):
    rows = [(lo, len(x[lo : lo + size]), bytearray(np.ascontiguousarray(x[lo : lo + size].T).tobytes())) for lo in range(0, len(x), size)]
    return spark.createDataFrame(rows, "t0 long, n int, x binary").repartition(3)


def test_tiles_are_written_as_ranges_of_a_file(spark, tmp_path, x):
    path = str(tmp_path / "a.bin")
    recording.register(spark)
    frame = tiles_frame(spark, x, 130)
    frame.write.format("tracewell_raw").mode("append").options(path=path, channels=6, n_samples=1000, fill=7).save()
    whole = np.fromfile(path, "<i2").reshape(-1, 6)
    assert np.array_equal(whole[:, :4], x) and (whole[:, 4:] == 7).all()
    with pytest.raises(Exception, match="mounted folder"):
        frame.write.format("tracewell_raw").mode("append").options(path="memory://a.bin", channels=6, n_samples=1000).save()


@pytest.mark.parametrize("order", "FC")
def test_tiles_are_written_as_chunks(spark, tmp_path, x, order):
    path = str(tmp_path / "b.cbin")
    recording.write_cbin(tiles_frame(spark, x, 130), path, 4, order=order)
    r = recording.reader_of(path, {"uv_per_bit": 1})
    assert np.array_equal(r.samples(0, 1000), x) and r.header["chunk_bounds"][-2:] == [910, 1000]


@pytest.mark.parametrize("kind", ["bin", "cbin"])
def test_windows_come_from_the_file_and_only_they(spark, tmp_path, kind):
    rng = np.random.default_rng(7)
    y = rng.integers(-400, 400, (4000, 4)).astype("<i2")
    path = str(tmp_path / f"w.{kind}")
    y.tofile(path) if kind == "bin" else write_cbin(y, path, 200)
    channels = spark.createDataFrame([(c, 16.0 * c, 20.0 * (c // 2), 0) for c in range(4)], "ch int, x_um double, y_um double, shank int")
    rows = geometry.display_rows(channels, True)
    cfg = PreprocConfig(1000.0)
    stims = spark.createDataFrame([(i, t) for i, t in enumerate([0.2, 0.2, 0.2, 0.5004, 0.51, 3.7, 0.1, 3.99, 2.0])], "stim_idx long, onset_s double")
    options = {"channels": 4, "n_samples": 4000, "uv_per_bit": 0.5}
    long = spark.createDataFrame([(c, t, float(y[t, c]) * 0.5) for t in range(4000) for c in range(4)], "ch int, t long, uv double")
    want = {(r.data_idx, r.k): r.mean_uv for r in events.event_average(long, rows, stims, cfg, 4000, -5, 20).collect()}
    for size in (64, 1000, 1 << 15):
        got = {(r.data_idx, r.k): r.mean_uv for r in events.event_average_of_file(spark, path, rows, stims, cfg, -5, 20, size=size, **options).collect()}
        assert got.keys() == want.keys() and len(got) == 50 and max(abs(got[k] - want[k]) for k in got) < 1e-9
    if kind == "cbin":  # a chunk that no window touches may be broken
        data = bytearray(open(path, "rb").read())
        at = json.load(open(path.replace(".cbin", ".ch")))["chunk_offsets"]
        data[at[5] + 5] ^= 0xFF
        open(path, "wb").write(data)
        assert events.event_average_of_file(spark, path, rows, stims, cfg, -5, 20, **options).count() == 50
        with pytest.raises(Exception, match="(?i)decompress|chunk"):
            events.event_average_of_file(spark, path, rows, stims.union(spark.createDataFrame([(99, 1.1)], stims.schema)), cfg, -5, 20, **options).count()


def test_no_window_fits_the_file(spark, tmp_path, x):
    x.tofile(str(tmp_path / "n.bin"))
    rows = geometry.display_rows(spark.createDataFrame([(c, 0.0, 20.0 * c, 0) for c in range(4)], "ch int, x_um double, y_um double, shank int"), True)
    stims = spark.createDataFrame([(0, 0.01), (1, None)], "stim_idx long, onset_s double")
    found = events.event_average_of_file(spark, str(tmp_path / "n.bin"), rows, stims, PreprocConfig(1000.0), -5, 20, channels=4, n_samples=1000, uv_per_bit=1)
    assert found.count() == 0


@pytest.mark.parametrize("spatial", ["global_cmr", "destripe", "off"])
def test_a_preprocessed_stream_equals_the_whole_and_goes_on_after_a_restart(spark, tmp_path, spatial):
    x = np.random.default_rng(5).integers(-900, 900, (6000, 4)).astype("<i2")
    path, target = str(tmp_path / "live.bin"), str(tmp_path / "out")
    channels = spark.createDataFrame([(c, 16.0 * c, 20.0 * (c % 2), c // 2) for c in range(4)], "ch int, x_um double, y_um double, shank int")
    rows = geometry.display_rows(channels, False)
    cfg = PreprocConfig(2000.0, dc_removal=False, phase_shift=True, spatial=spatial)
    recording.register(spark)
    x.tofile(str(tmp_path / "whole.bin"))
    source = spark.read.format("tracewell_raw").options(channels=4, n_samples=6000, uv_per_bit=0.5, form="tile", halo=tiles.halo_of(cfg), samples_per_task=6000).load(str(tmp_path / "whole.bin"))
    model = tiles.RowModel.of(rows)
    deviations = [float(tiles.temporal(x[:, 2 * b : 2 * b + 2].T * 0.5, tiles.RowModel(*(f[2 * b : 2 * b + 2] for f in (model.members, model.first_ch, model.x_um, model.y_um, model.shank))), cfg, None, True).std()) for b in (0, 1)]
    want = {(r.row_idx, r.t): r.uv for r in tiles.explode_tiles(tiles.preprocess_tiles(source, rows, cfg, 0.5, kind="<f8"), model, "<f8").collect()}

    def run(n):
        x[:n].tofile(path)
        stream = live.read_stream(spark, path, channels=4, uv_per_bit=0.5, form="tile", samples_per_task=333)
        made = live.live_preprocessed(stream, rows, cfg, 0.5, 6000, deviations=deviations)
        made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(target).awaitTermination()

    run(2500)
    halo = tiles.halo_of(cfg)
    assert spark.read.parquet(target).count() == 4 * max(0, 2500 - halo)
    run(2600)
    run(6000)
    got = spark.read.parquet(target).collect()
    assert len(got) == len(want) and max(abs(want[r.row_idx, r.t] - r.uv) for r in got) < 1e-8


def test_streams_that_cannot_be_preprocessed(spark):
    rows = geometry.display_rows(spark.createDataFrame([(0, 0.0, 0.0, 0)], "ch int, x_um double, y_um double, shank int"), False)
    frame = spark.createDataFrame([], "t0 long, n int, x binary")
    with pytest.raises(ValueError, match="means"):
        live.live_preprocessed(frame, rows, PreprocConfig(1000.0, highpass=False), 1.0)
    with pytest.raises(ValueError, match="deviation"):
        live.live_preprocessed(frame, rows, PreprocConfig(1000.0, spatial="destripe"), 1.0)


@pytest.fixture
def many(tmp_path, x):
    """Two raw recordings and a compressed one in folders of their own, each with its side-car files."""
    whole = {}
    for name, part in (("a", x[:600]), ("b", x[600:]), ("c", x)):
        folder = tmp_path / "recordings" / name
        folder.mkdir(parents=True)
        (folder / "r.ap.meta").write_text(META.format(size=part.size * 2))
        path = str(folder / ("r.ap.cbin" if name == "c" else "r.ap.bin"))
        part.tofile(path) if name != "c" else write_cbin(part, path, 300)
        whole[path] = part
    return whole


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_many_recordings_are_one_table(spark, tmp_path, many, scheme):
    recording.register(spark)
    table = spark.read.format("tracewell_recordings").options(samples_per_task=250).load(f"{scheme}{tmp_path}/recordings/*/r.ap.*")
    scale = sidecar.find_meta(next(iter(many))).uv_per_bit
    got = {}
    for r in table.collect():
        got.setdefault(r.recording, {})[r.t, r.ch] = r.uv
    assert set(got) == {scheme + p for p in many}
    for path, part in many.items():
        assert len(got[scheme + path]) == len(part) * 3 and all(abs(part[t, c] * scale - v) < 1e-9 for (t, c), v in got[scheme + path].items())
    tile = spark.read.format("tracewell_recordings").options(samples_per_task=250, form="tile", halo=10).load(f"{scheme}{tmp_path}/recordings/*/r.ap.*")
    assert tile.columns == ["recording", "tile_id", "t0", "n", "x", "left", "right"] and tile.agg({"n": "sum"}).first()[0] == 2000


def test_limits_on_recordings_leave_out_files(spark, tmp_path, many):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

    pattern = f"{tmp_path}/recordings/?/r.ap.*bin"
    a, b, c = many
    r = recording.RecordingsReader({"path": pattern, "samples_per_task": "250"})
    assert not list(r.pushFilters([In(("recording",), (a, c)), GreaterThanOrEqual(("t",), 500)]))
    assert {(s.recording, s.first, s.last) for s in r.partitions()} == {(a, 500, 600), (c, 500, 600), (c, 600, 900), (c, 900, 1000)}
    r = recording.RecordingsReader({"path": pattern})
    assert len(list(r.pushFilters([EqualTo(("recording",), b), EqualTo(("ch",), 1)]))) == 1 and {s.recording for s in r.partitions()} == {b}
    open(a, "wb").close()  # neither is read now
    recording.register(spark)
    assert spark.read.format("tracewell_recordings").load(pattern).where(F.col("recording") == b).count() == 1200
    nothing = spark.read.format("tracewell_recordings").load(f"{tmp_path}/recordings/z*/r.bin")
    assert nothing.count() == 0 and nothing.columns == ["recording", "ch", "t", "uv"]


def test_side_cars_by_uri(spark, tmp_path, x):
    data = open_ephys(tmp_path)
    x.tofile(str(data / "continuous.dat"))
    path = f"file://{data}/continuous.dat"
    assert sidecar.find_meta(path) == sidecar.find_meta(str(data / "continuous.dat"))
    assert np.allclose(values(recording.open_recording(spark, path), rows=4), x * 0.195)
    with pytest.raises(FileNotFoundError):
        sidecar.find_meta("mock:///nowhere/a.bin")
