"""Stimulus onset files: a layout that says where the onsets stand, and the loader."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.sources.sidecar import text_column

LAYOUT_NAME, DEFAULT_LAYOUT = "stims_file_layout.csv", "header\no\n"
_NUMBER = r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])"


@dataclass(frozen=True)
class StimLayout:
    n_header_rows: int
    onset_cols: tuple[int, ...]


def fields_of(line: str) -> list[str]:
    return [f.strip() for f in line.split(",")] if "," in line else line.split()


def parse_layout(text: str) -> StimLayout:
    """Lines without an `o` are headers; the first one with it marks the onset columns. Blank lines don't count."""
    headers = 0
    for line in filter(None, map(str.strip, text.splitlines())):
        found = tuple(i for i, f in enumerate(fields_of(line)) if f.lower() == "o")
        if found:
            return StimLayout(headers, found)
        headers += 1
    raise ValueError("the layout marks no onset column with 'o', as in 'o,x,x'")


def decode_text(data: bytes) -> str:
    """As `text_column`, for the one small file that a driver reads."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            rest = data[len(mark) :]
            return (rest[: len(rest) // 2 * 2] if "16" in name else rest).decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def resolve_layout(stim_path: str, default_path: str) -> StimLayout:
    """The layout beside the stimulus file, else the default one."""
    beside = os.path.join(os.path.dirname(stim_path), LAYOUT_NAME)
    path = beside if os.path.isfile(beside) else default_path
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no {LAYOUT_NAME} beside {stim_path} and no default layout at {default_path}")
    with open(path, "rb") as f:
        return parse_layout(decode_text(f.read()))


def write_default_layout(path: str) -> None:
    """A default layout file, unless there is one."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(DEFAULT_LAYOUT)


_SPACES = r"(?U)\s+"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_fields(line: Column) -> Column:
    return F.when(F.instr(line, ",") > 0, F.transform(F.split(line, ","), stripped)).otherwise(F.split(stripped(line), _SPACES))


def stims_of(texts: DataFrame, layout: StimLayout) -> DataFrame:
    """(path, stim_idx, onset_s) from (path, text): each onset column of each data line, in reading order.

    Header lines count as they stand, blank ones among them; blank data lines are skipped. A line
    with too few columns, a value that is no number, or a file without onsets raises.
    """
    lines = texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    data = lines.where((F.col("line_no") >= layout.n_header_rows) & (stripped(F.col("line")) != "")).withColumn("f", split_fields(F.col("line")))
    need = max(layout.onset_cols)
    short = F.concat(F.lit(f"column {need + 1} is marked as onset, but row "), F.col("line_no") + 1, F.lit(" has "), F.size("f"), F.lit(" columns: "), F.col("path"))
    wide = data.withColumn("f", F.when(F.size("f") > need, F.col("f")).otherwise(F.raise_error(short)))
    order = {c: i for i, c in enumerate(layout.onset_cols)}
    each = wide.select("path", "line_no", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.get("f", c).alias("v")) for c, i in order.items()])).alias("o"))
    bad = F.concat(F.lit("no number: '"), F.col("o.v"), F.lit("' in row "), F.col("line_no") + 1, F.lit(", column "), F.col("o.c") + 1, F.lit(": "), F.col("path"))
    value = F.when(F.col("o.v").rlike(f"^{_NUMBER}$"), F.col("o.v").cast("double")).otherwise(F.raise_error(bad).cast("double"))
    onset = each.select("path", (F.col("line_no").cast("long") * len(order) + F.col("o.i")).alias("at"), value.alias("onset_s"))
    return onset.selectExpr("path", "row_number() OVER (PARTITION BY path ORDER BY at) - 1L AS stim_idx", "onset_s")


def layouts_of(texts: DataFrame) -> DataFrame:
    """(path, n_header_rows, onset_cols, error) of layout files (path, text), by the rules of `parse_layout`; a layout without an onset column has an error."""
    lines = F.filter(F.split("text", "\r?\n"), lambda x: stripped(x) != "")
    marked = F.transform(lines, lambda x: F.transform(split_fields(stripped(x)), lambda f, i: F.when(F.lower(f) == "o", i)))
    columns = F.transform(marked, lambda m: F.filter(m, lambda i: i.isNotNull()))
    first = F.array_position(F.transform(columns, lambda c: F.size(c) > 0), True)
    found = texts.withColumn("c", columns).withColumn("at", first.cast("int"))
    return found.select(
        "path",
        F.when(F.col("at") > 0, F.col("at") - 1).alias("n_header_rows"),
        F.when(F.col("at") > 0, F.get("c", F.col("at") - 1)).alias("onset_cols"),
        F.when(F.col("at") == 0, F.lit("the layout marks no onset column")).alias("error"),
    )


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def resolved_layouts(files: DataFrame, layouts: DataFrame, default: DataFrame) -> DataFrame:
    """(path, layout_path, n_header_rows, onset_cols, error) for each stimulus file (path): the layout in its folder, else the default one.

    `layouts` and `default` (one row, or none) are what `layouts_of` gives. A layout beside a file holds even
    if it has an error; a file without any gets an error. Of several layouts in a folder the least path holds.
    """
    own = layouts.groupBy(folder_of(F.col("path")).alias("folder")).agg(F.min_by(F.struct("path", "n_header_rows", "onset_cols", "error"), "path").alias("l"))
    placed = files.select("path", folder_of(F.col("path")).alias("folder"))
    beside = placed.join(own, "folder").select("path", F.col("l.path").alias("layout_path"), "l.n_header_rows", "l.onset_cols", "l.error")
    rest = placed.join(own.select("folder"), "folder", "left_anti").select("path")
    known = default.agg(F.min_by(F.struct("path", "n_header_rows", "onset_cols", "error"), "path").alias("l"))  # one row
    missing = F.when(F.col("l").isNull(), "no layout beside the file and no default one").otherwise(F.col("l.error"))
    fallen = rest.join(F.broadcast(known), F.lit(True)).select("path", F.col("l.path").alias("layout_path"), "l.n_header_rows", "l.onset_cols", missing.alias("error"))
    return beside.unionByName(fallen)


def stims_by_layout(texts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, stim_idx, onset_s, error) of many stimulus files (path, text), each read by its own layout.

    A file that cannot be read has one row with its first error, and no onsets; the others are not held up by it.
    """
    files = texts.join(resolved, "path")
    lines = files.where("error IS NULL").select("path", "n_header_rows", "onset_cols", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    data = lines.where((F.col("line_no") >= F.col("n_header_rows")) & (stripped(F.col("line")) != "")).withColumn("f", split_fields(F.col("line")))
    each = data.select("path", "line_no", "f", F.posexplode("onset_cols").alias("i", "c")).withColumn("v", F.get("f", "c"))
    at = F.struct("line_no", "i")
    error = F.when(F.col("v").isNull(), F.concat(F.lit("row "), F.col("line_no") + 1, F.lit(" has "), F.size("f"), F.lit(" columns, column "), F.col("c") + 1, F.lit(" is marked as onset")))
    error = error.when(~F.col("v").rlike(f"^{_NUMBER}$"), F.concat(F.lit("no number in row "), F.col("line_no") + 1, F.lit(", column "), F.col("c") + 1))
    each = each.withColumn("error", error).withColumn("at", at)
    broken = each.where("error IS NOT NULL").groupBy("path").agg(F.min_by("error", "at").alias("error"))
    good = each.join(broken.select("path"), "path", "left_anti")
    onsets = good.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).cast("long").alias("stim_idx"), F.col("v").cast("double").alias("onset_s"), F.lit(None).cast("string").alias("error"))
    empty = files.where("error IS NULL").select("path").join(each.select("path").distinct(), "path", "left_anti").withColumn("error", F.lit("no stimulus times"))
    failed = files.where("error IS NOT NULL").select("path", "error").unionByName(broken).unionByName(empty)
    return onsets.unionByName(failed.select("path", F.lit(None).cast("long").alias("stim_idx"), F.lit(None).cast("double").alias("onset_s"), "error"))


def load_stims(spark: SparkSession, path: str, layout: StimLayout) -> DataFrame:
    """Stimuli of a file or of all files of a pattern. Files without any onset raise."""
    files = spark.read.format("binaryFile").load(path).select("path", text_column(F.col("content")).alias("text"))
    found = stims_of(files, layout)
    empty = files.join(found.select("path").distinct(), "path", "left_anti").select("path").head()
    if empty is not None:
        raise ValueError(f"no stimulus times in {empty['path']} after {layout.n_header_rows} header rows")
    return found


def is_number(text: str) -> bool:
    return re.fullmatch(_NUMBER, text) is not None
