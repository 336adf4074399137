"""Side-car metadata of recordings: SpikeGLX .meta text, Open Ephys structure.oebin and settings.xml.

The DataFrame functions parse many files at once; the driver-side ones describe the one recording
that is opened. Both follow the same rules.
"""

from __future__ import annotations

import json
import os
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.model import Channel, Meta
from tracewell.operators.geometry import anchored_starts
from tracewell.sources.files import file_size, folders_above, is_file, read_text

# What a .meta file means where it is silent.
META_DEFAULTS = {"imAiRangeMax": 0.6, "imChan0apGain": 500.0, "imChan0lfGain": 250.0, "imMaxInt": 512.0, "imDatPrb_type": 0}
ROW_UM = 20.0
NP2_PREFIX, NP2_PART, NP2_TYPE = "PRB2", "NP2", 21
SHANK_GAP_UM, SAME_COLUMN_UM, COLUMN_SLACK_UM = 100.0, 1.0, 0.5


# --- SpikeGLX, as DataFrames ---


def parse_meta(files: DataFrame) -> DataFrame:
    """One row per file of (path, content): counts, rate, scale, probe type and geometry map of a .meta text.

    A file without one of the required keys, or with a value there that is no number, gives a row
    with `error` set. Unknown keys are ignored; of a repeated key the last counts.
    """
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    pairs = lines.select("path", "at", F.split(F.rtrim(F.col("line"), F.lit("\r")), "=", 2).alias("kv")).where(F.size("kv") == 2)
    keys = ["nSavedChans", "imSampRate", "fileSizeBytes", "snsApLfSy", *META_DEFAULTS]
    value = lambda k: F.max_by(F.when(F.col("kv")[0] == k, F.col("kv")[1]), F.when(F.col("kv")[0] == k, F.col("at"))).alias(k)
    geom = F.max_by(F.when(F.col("kv")[0].isin("~snsGeomMap", "snsGeomMap"), F.col("kv")[1]), F.when(F.col("kv")[0].isin("~snsGeomMap", "snsGeomMap"), F.col("at"))).alias("geom_map")
    found = files.select("path").join(pairs.groupBy("path").agg(*map(value, keys), geom), "path", "left")
    number = lambda c, kind: F.expr(f"try_cast(trim({c}) AS {kind})")
    part = lambda i: F.expr(f"try_cast(trim(get(split(snsApLfSy, ','), {i})) AS INT)")
    whole = F.size(F.split("snsApLfSy", ",")) >= 3
    ap, lf, sy = (F.when(whole, part(i)) for i in range(3))
    saved = number("nSavedChans", "INT")
    listed = F.coalesce(ap + lf, F.lit(0))
    chans = F.when(listed > 0, listed).otherwise(F.greatest(saved - F.coalesce(sy, F.lit(1)), F.lit(0)))
    or_default = lambda c: F.coalesce(number(c, "DOUBLE"), F.lit(float(META_DEFAULTS[c])))
    gain = F.when((F.coalesce(lf, F.lit(0)) > 0) & (F.coalesce(ap, F.lit(0)) == 0), or_default("imChan0lfGain")).otherwise(or_default("imChan0apGain"))
    rate, size = number("imSampRate", "DOUBLE"), number("fileSizeBytes", "BIGINT")
    missing = saved.isNull() | rate.isNull() | size.isNull()
    return found.select(
        "path",
        saved.alias("n_saved_chans"),
        F.when(~missing, chans).alias("n_chans"),
        rate.alias("sample_rate"),
        F.when(~missing & (saved > 0), F.expr("try_cast(trim(fileSizeBytes) AS BIGINT) DIV (try_cast(trim(nSavedChans) AS INT) * 2)")).alias("n_samples"),
        F.when(~missing, or_default("imAiRangeMax") / or_default("imMaxInt") / gain * 1e6).alias("uv_per_bit"),
        F.coalesce(number("imDatPrb_type", "INT"), F.lit(0)).alias("probe_type"),
        "geom_map",
        F.when(missing, "nSavedChans, imSampRate and fileSizeBytes are required").alias("error"),
    )


def parse_geom_map(maps: DataFrame) -> DataFrame:
    """(path, ch, x_um, y_um, shank) from (path, geom_map, n_chans).

    Entries are (shank:x:y:used); a token without exactly four parts is skipped. An unreadable number
    is 0; a map with fewer entries than channels leaves the rest at 0, more are dropped. No map: one
    column of sites 20 um apart.
    """
    tokens = F.filter(F.transform(F.split(F.coalesce("geom_map", F.lit("")), "\\)"), lambda t: F.split(F.ltrim(t, F.lit("(")), ":")), lambda p: F.size(p) == 4)
    entries = maps.withColumn("e", tokens)
    chans = entries.select("path", "e", F.explode(F.expr("sequence(0, n_chans - 1)")).alias("ch"), "n_chans").where("n_chans > 0")
    number = lambda i, kind: F.coalesce(F.expr(f"try_cast(trim(get(get(e, ch), {i})) AS {kind})"), F.lit(0))
    listed = F.size("e") > 0
    return chans.select(
        "path",
        "ch",
        F.when(listed, number(1, "DOUBLE")).otherwise(F.lit(0.0)).alias("x_um"),
        F.when(listed, number(2, "DOUBLE")).otherwise(F.col("ch") * ROW_UM).alias("y_um"),
        F.when(listed, number(0, "INT")).otherwise(F.lit(0)).alias("shank"),
    )


# --- Open Ephys, as DataFrames ---

_OEBIN = (
    "continuous array<struct<folder_name:string,sample_rate:double,num_channels:int,source_processor_id:int,"
    "channels:array<struct<bit_volts:double,bitVolts:double>>>>"
)


def parse_oebin(files: DataFrame) -> DataFrame:
    """One row per stream of (path, content): (path, folder, sample_rate, n_chans, processor, uv_per_bit, error).

    The folder's trailing slash is taken off. Scales that differ between channels, or are missing, give
    an `error`.
    """
    streams = files.select("path", F.inline(F.from_json("content", _OEBIN).getField("continuous")))
    volts = F.transform("channels", lambda c: F.coalesce(c["bit_volts"], c["bitVolts"]))
    first = F.get(volts, 0)
    differs = F.exists(volts, lambda v: F.abs(v - first) > 1e-6)
    error = (
        F.when(F.col("sample_rate").isNull() | F.col("num_channels").isNull() | F.col("channels").isNull(), "sample_rate, num_channels and channels are required")
        .when(F.exists(volts, lambda v: v.isNull()) | (F.size(volts) == 0), "a channel without bit_volts")
        .when(differs, "channels of different bit_volts")
    )
    return streams.select(
        "path",
        F.regexp_replace("folder_name", "/+$", "").alias("folder"),
        "sample_rate",
        F.col("num_channels").alias("n_chans"),
        F.coalesce("source_processor_id", F.lit(0)).alias("processor"),
        first.alias("uv_per_bit"),
        error.alias("error"),
    )


def parse_settings(files: DataFrame, n_chans: int) -> DataFrame:
    """(path, processor, probe_type, xs, ys) of settings.xml texts (path, content): the first probe of each processor.

    A probe is an element of its processor, or of that one's EDITOR. `xs` and `ys` are the positions of channels
    0 .. n_chans - 1, null where the attribute CH<n> is missing. Of processors with one id the first counts; a text that is no XML gives no rows.
    """
    sites = "struct<" + ",".join(f"_CH{i}:double" for i in range(n_chans)) + ">"
    probes = f"array<struct<_probe_part_number:string,ELECTRODE_XPOS:{sites},ELECTRODE_YPOS:{sites}>>"
    processors = f"array<struct<_NodeId:string,NP_PROBE:{probes},EDITOR:struct<NP_PROBE:{probes}>>>"
    root = F.from_xml("content", f"PROCESSOR {processors}, SIGNALCHAIN array<struct<PROCESSOR:{processors}>>")
    none = F.array().cast(processors)
    inner = F.flatten(F.transform(root["SIGNALCHAIN"], lambda c: F.coalesce(c["PROCESSOR"], none)))
    each = files.select("path", F.posexplode(F.concat(F.coalesce(root["PROCESSOR"], none), F.coalesce(inner, none))).alias("at", "p"))
    probe = F.get(F.coalesce(F.col("p.NP_PROBE"), F.col("p.EDITOR.NP_PROBE")), F.lit(0))
    one = each.where("p._NodeId IS NOT NULL").groupBy("path", F.col("p._NodeId").alias("processor")).agg(F.min_by(probe, "at").alias("b")).where("b IS NOT NULL")
    positions = lambda side: F.array(*[F.col(f"b.{side}._CH{i}") for i in range(n_chans)])
    part = F.coalesce(F.col("b._probe_part_number"), F.lit(""))
    kind = F.when(part.startswith(NP2_PREFIX) | part.contains(NP2_PART), NP2_TYPE).otherwise(0)
    return one.select("path", "processor", kind.alias("probe_type"), positions("ELECTRODE_XPOS").alias("xs"), positions("ELECTRODE_YPOS").alias("ys"))


def settings_channels(probes: DataFrame, n_chans: int) -> DataFrame:
    """(path, processor, ch, x_um, y_um, shank) of the probes of `parse_settings`: channels without a position take the nearest one's."""
    probe = ("path", "processor")
    known = probes.select(*probe, "ys", F.posexplode("xs").alias("ch", "x_um")).select(*probe, "ch", "x_um", F.get("ys", F.col("ch")).alias("y_um"))
    columns = F.sort_array(F.array_distinct(F.filter("xs", lambda x: x.isNotNull())))
    starts = probes.select(*probe, anchored_starts(anchored_starts(columns, SAME_COLUMN_UM, True), SHANK_GAP_UM, False).alias("starts"))
    shank = F.greatest(F.size(F.filter("starts", lambda s: s <= F.col("x_um") + COLUMN_SLACK_UM)) - 1, F.lit(0))
    return fill_positions(known, n_chans, probe).join(starts, list(probe)).select(*probe, "ch", "x_um", "y_um", shank.cast("int").alias("shank"))


def fill_positions(known: DataFrame, n_chans: int, probe: tuple[str, ...] = ()) -> DataFrame:
    """(*probe, ch, x_um, y_um) for channels 0 .. n-1 of each probe from those with a position: else that of the
    nearest channel that has one, the lower of two equally near, else (0, 0). A null coordinate is no position."""
    site = F.when((F.col("ch") < n_chans) & F.col("x_um").isNotNull() & F.col("y_um").isNotNull(), F.struct("ch", "x_um", "y_um"))
    listed = known.groupBy(*probe).agg(F.collect_list(site).alias("k"))  # the sites of a probe, at most one per channel
    own = listed.select(*probe, "k", F.posexplode(F.array_repeat(F.lit(0), n_chans)).alias("ch", "zero"))
    best = F.array_min(F.transform("k", lambda e: F.struct(F.abs(e["ch"] - F.col("ch")).alias("d"), e["ch"].alias("c"), e["x_um"].alias("x"), e["y_um"].alias("y"))))
    filled = own.withColumn("b", best)
    return filled.select(*probe, "ch", F.coalesce(F.col("b.x"), F.lit(0.0)).alias("x_um"), F.coalesce(F.col("b.y"), F.lit(0.0)).alias("y_um"))


# --- the recording that is opened, on the driver ---


def _float(text: str | None, default: float) -> float:
    try:
        return float(text.strip())
    except (AttributeError, ValueError):
        return default


def geometry_of_map(text: str | None, n: int) -> tuple[Channel, ...]:
    entries = [p for p in (t.lstrip("(").split(":") for t in (text or "").split(")")) if len(p) == 4]
    if not entries:
        return tuple(Channel(i, 0.0, ROW_UM * i, 0) for i in range(n))
    made = [Channel(i, _float(e[1], 0.0), _float(e[2], 0.0), int(_float(e[0], 0.0))) for i, e in enumerate(entries[:n])]
    return (*made, *(Channel(i, 0.0, 0.0, 0) for i in range(len(made), n)))


def read_meta(path: str) -> Meta:
    """A SpikeGLX .meta file."""
    pairs = dict(line.rstrip("\r").split("=", 1) for line in read_text(path).split("\n") if "=" in line)
    try:
        saved, rate, size = int(pairs["nSavedChans"]), float(pairs["imSampRate"]), int(pairs["fileSizeBytes"])
    except (KeyError, ValueError) as e:
        raise ValueError(f"{path}: nSavedChans, imSampRate and fileSizeBytes are required") from e
    kinds = pairs.get("snsApLfSy", "").split(",")
    ap, lf, sy = (int(_float(k, -1)) for k in kinds[:3]) if len(kinds) >= 3 else (-1, -1, -1)
    chans = ap + lf if min(ap, lf) >= 0 and ap + lf > 0 else max(saved - (sy if sy >= 0 else 1), 0)
    value = lambda k: _float(pairs.get(k), META_DEFAULTS[k])
    gain = value("imChan0lfGain") if lf > 0 and ap == 0 else value("imChan0apGain")
    geometry = pairs.get("~snsGeomMap", pairs.get("snsGeomMap"))
    return Meta(saved, chans, rate, size // (saved * 2), value("imAiRangeMax") / value("imMaxInt") / gain * 1e6, int(value("imDatPrb_type")), geometry_of_map(geometry, chans))


def shanks_of(xs: list[float]) -> list[float]:
    """Where shanks start: among the columns of x, each more than 100 um from the start before."""
    columns: list[float] = []
    for x in sorted(xs):
        if not columns or x - columns[-1] >= SAME_COLUMN_UM:
            columns.append(x)
    starts: list[float] = []
    for x in columns:
        if not starts or x - starts[-1] > SHANK_GAP_UM:
            starts.append(x)
    return starts


def geometry_of_settings(xml: str, processor: int, n: int) -> tuple[tuple[Channel, ...], int]:
    """Channels and probe type of a processor's first probe."""
    node = next((p for p in ET.fromstring(xml).iter("PROCESSOR") if p.get("NodeId") == str(processor)), None)
    probe = next(node.iter("NP_PROBE"), None) if node is not None else None
    if probe is None:
        raise ValueError(f"no probe of processor {processor}")

    def positions(tag: str) -> dict[int, float]:
        found = next(probe.iter(tag), None)
        pairs = {} if found is None else found.attrib
        return {int(k[2:]): float(v) for k, v in pairs.items() if re.fullmatch(r"CH\d+", k)}

    xs, ys = positions("ELECTRODE_XPOS"), positions("ELECTRODE_YPOS")
    both = sorted(xs.keys() & ys.keys())
    starts = shanks_of(list(xs.values()))

    def channel(i: int) -> Channel:
        near = min((c for c in both if c < n), key=lambda c: (abs(c - i), c), default=None)
        x, y = (xs[near], ys[near]) if near is not None else (0.0, 0.0)
        shank = max((k for k, s in enumerate(starts) if x + COLUMN_SLACK_UM >= s), default=0)
        return Channel(i, x, y, shank)

    part = probe.get("probe_part_number", "")
    return tuple(map(channel, range(n))), NP2_TYPE if part.startswith(NP2_PREFIX) or NP2_PART in part else 0


def find_open_ephys(path: str) -> tuple[str, str] | None:
    """The nearest structure.oebin above a data file, and the first settings.xml at or above it."""
    above = folders_above(path)
    for k, d in enumerate(above):
        if is_file(f"{d}/structure.oebin"):
            settings = next((f"{s}/settings.xml" for s in above[k:] if is_file(f"{s}/settings.xml")), None)
            return (f"{d}/structure.oebin", settings) if settings else None
    return None


def read_open_ephys(path: str, oebin: str, settings: str) -> Meta:
    folder = folders_above(path)[0].rpartition("/")[2]
    streams = json.loads(read_text(oebin)).get("continuous", [])
    stream = next((s for s in streams if s.get("folder_name", "").rstrip("/") == folder), None)
    if stream is None:
        raise ValueError(f"{oebin}: no stream of folder {folder}")
    try:
        rate, n, chans = float(stream["sample_rate"]), int(stream["num_channels"]), stream["channels"]
        volts = [float(c["bit_volts"] if "bit_volts" in c else c["bitVolts"]) for c in chans]
    except KeyError as e:
        raise ValueError(f"{oebin}: stream {folder} lacks {e}") from e
    if not volts or any(abs(v - volts[0]) > 1e-6 for v in volts):
        raise ValueError(f"{oebin}: channels of different or no bit_volts")
    channels, kind = geometry_of_settings(read_text(settings), int(stream.get("source_processor_id", 0)), n)
    if path.endswith(".cbin"):  # the compressed size says nothing about samples
        samples = int(json.loads(read_text(path[: -len(".cbin")] + ".ch"))["chunk_bounds"][-1])
    else:
        samples = file_size(path) // (n * 2)
    return Meta(n, n, rate, samples, volts[0], kind, channels)


def find_meta(path: str) -> Meta:
    """The metadata of a data file: a .meta beside it, else Open Ephys files above it."""
    beside = os.path.splitext(path)[0] + ".meta"
    if is_file(beside):
        return read_meta(beside)
    found = find_open_ephys(path)
    if found is None:
        raise FileNotFoundError(f"{path}: neither a .meta beside it nor structure.oebin and settings.xml above it")
    return read_open_ephys(path, *found)


def channels_frame(spark, meta: Meta) -> DataFrame:
    return spark.createDataFrame([(c.ch, float(c.x_um), float(c.y_um), c.shank) for c in meta.channels], "ch int, x_um double, y_um double, shank int")


def text_column(content: Column) -> Column:
    """The text of a file's bytes: UTF-8 with or without its mark, UTF-16 with its mark, else Latin-1."""
    lead = lambda n: F.hex(F.substring(content, 1, n))
    rest = lambda n: F.expr("NULL") if n is None else F.substring(content, n + 1, 1 << 30)
    even = lambda c: F.substring(c, F.lit(1), (F.octet_length(c) / 2).cast("int") * 2)
    return (
        F.when(lead(3) == "EFBBBF", F.make_valid_utf8(rest(3).cast("string")))
        .when(lead(2) == "FFFE", F.decode(even(rest(2)), "UTF-16LE"))
        .when(lead(2) == "FEFF", F.decode(even(rest(2)), "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
