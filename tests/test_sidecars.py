"""Layouts and settings of many files as DataFrames against the readers of one file."""

import pytest

from tracewell.sources import sidecar, stimuli

LAYOUTS = {"a": "h\n\n h2 \nx, O ,o\no", "b": "a\nb", "c": "o x", "d": "", "e": "x\to\t\n", "f": "\r\nh\r\n o,x\r\n", "g": None}


def test_layouts_equal_the_parser_of_one(spark):
    frame = spark.createDataFrame([(f"{k}/l.csv", t) for k, t in LAYOUTS.items()], "path string, text string")
    for r in stimuli.layouts_of(frame).collect():
        text = LAYOUTS[r.path[0]]
        try:
            want = stimuli.parse_layout(text or "")
            assert (r.n_header_rows, tuple(r.onset_cols), r.error) == (want.n_header_rows, want.onset_cols, None)
        except ValueError:
            assert r.n_header_rows is None and (r.error or text is None)


def test_a_layout_beside_a_file_comes_before_the_default_one(spark):
    files = spark.createDataFrame([("x/1.csv", "h\n1,2\n"), ("x/2.csv", "h\n3,q\n"), ("y/1.csv", "h\n5 6\n"), ("z/1.csv", "h\n7"), ("x/3.csv", "h\n")], "path string, text string")
    layouts = stimuli.layouts_of(spark.createDataFrame([("x/l.csv", "h\no,o"), ("z/l.csv", "none"), ("x/m.csv", "o")], "path string, text string"))
    default = stimuli.layouts_of(spark.createDataFrame([("d.csv", "h\nx o")], "path string, text string"))
    resolved = stimuli.resolved_layouts(files.select("path"), layouts, default)
    assert {r.path: (r.layout_path, r.onset_cols, r.error is None) for r in resolved.collect()} == {
        "x/1.csv": ("x/l.csv", [0, 1], True), "x/2.csv": ("x/l.csv", [0, 1], True), "x/3.csv": ("x/l.csv", [0, 1], True), "y/1.csv": ("d.csv", [1], True), "z/1.csv": ("z/l.csv", None, False),
    }
    got = sorted((r.path, r.stim_idx, r.onset_s, r.error and r.error[:9]) for r in stimuli.stims_by_layout(files, resolved).collect() if r.path != "x/1.csv")
    assert got == [("x/2.csv", None, None, "no number"), ("x/3.csv", None, None, "no stimul"), ("y/1.csv", 0, 6.0, None), ("z/1.csv", None, None, "the layou")]
    nothing = stimuli.resolved_layouts(files.select("path"), layouts.limit(0), default.limit(0))
    assert {r.error for r in nothing.collect()} == {"no layout beside the file and no default one"}


PROBE = '<NP_PROBE probe_part_number="{part}"><CHANNELS CH0="0"/><ELECTRODE_XPOS {x}/><ELECTRODE_YPOS {y}/></NP_PROBE>'
ONE = PROBE.format(part="PRB2_1", x='CH0="0" CH1="32" CH4="250" CH7="500" foo="9"', y='CH0="5" CH1="20" CH4="40" CH5="1" CH7="3"')
TWO = PROBE.format(part="NP1010", x='CH2="8"', y='CH2="5.5"')


@pytest.mark.parametrize("n", [1, 6, 9])
def test_settings_equal_the_reader_of_one(spark, n):
    texts = {
        "a": f'<?xml version="1.0"?><SETTINGS><INFO/><SIGNALCHAIN><PROCESSOR NodeId="7"><EDITOR x="1">{ONE}{TWO}</EDITOR></PROCESSOR><PROCESSOR NodeId="8"/></SIGNALCHAIN></SETTINGS>',
        "b": f'<SETTINGS><PROCESSOR NodeId="7">{TWO}</PROCESSOR><PROCESSOR NodeId="9">{ONE}</PROCESSOR></SETTINGS>',
        "c": f'<SETTINGS><SIGNALCHAIN><PROCESSOR NodeId="5"/></SIGNALCHAIN><SIGNALCHAIN><PROCESSOR NodeId="7">{ONE}</PROCESSOR></SIGNALCHAIN></SETTINGS>',
    }
    frame = spark.createDataFrame([*texts.items(), ("x", "no xml"), ("y", None)], "path string, content string")
    probes = sidecar.parse_settings(frame, 12).cache()
    assert {(r.path, r.processor) for r in probes.collect()} == {("a", "7"), ("b", "7"), ("b", "9"), ("c", "7")}
    got = {}
    for r in sidecar.settings_channels(probes, n).collect():
        got.setdefault((r.path, r.processor), []).append((r.ch, r.x_um, r.y_um, r.shank))
    for r in probes.collect():
        channels, kind = sidecar.geometry_of_settings(texts[r.path], int(r.processor), n)
        assert r.probe_type == kind and sorted(got[r.path, r.processor]) == [(c.ch, c.x_um, c.y_um, c.shank) for c in channels]
