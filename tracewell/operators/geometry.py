"""The row model of a probe: depth groups, gaps, boundaries, and look-ups in them.

Input is `channels(ch, x_um, y_um, shank)`, one row per channel of a probe: a table of a few thousand
rows at most, whatever the length of the recording. Null coordinates count as 0, as for a channel
without a known position. With `keys`, columns that tell probes apart, a table holds many probes and each
is treated by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAME_DEPTH, NEAR_DEPTH, DEFAULT_PITCH, GAP_FACTOR = 0.5, 0.1, 20.0, 1.5  # fixed values, micrometres and a factor


Keys = tuple[str, ...]


def _known(channels: DataFrame, keys: Keys = ()) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return channels.select(*keys, F.col("ch").cast("int").alias("ch"), zero("x_um"), zero("y_um"), F.coalesce(F.col("shank"), F.lit(0)).cast("int").alias("shank"))


def anchored_starts(sorted_values: Column, apart: float, inclusive: bool) -> Column:
    """Starts of groups in a sorted array: a value opens a group if it is `apart` from the last *start*.

    `inclusive` says whether a distance of exactly `apart` opens one.
    """
    far = (lambda d: d >= apart) if inclusive else (lambda d: d > apart)
    return F.aggregate(
        sorted_values,
        F.array().cast("array<double>"),
        lambda acc, v: F.when((F.size(acc) == 0) | far(v - F.element_at(acc, -1)), F.concat(acc, F.array(v))).otherwise(acc),
    )


def pitch_per_shank(channels: DataFrame, keys: Keys = ()) -> DataFrame:
    """(*keys, shank, pitch_um): the least distance of two depths of a shank, 20 if it has one depth only."""
    depths = _known(channels, keys).groupBy(*keys, "shank").agg(F.sort_array(F.collect_set("y_um")).alias("ys"))
    starts = depths.withColumn("ys", anchored_starts(F.col("ys"), NEAR_DEPTH, True))
    steps = F.filter(F.transform("ys", lambda y, i: y - F.get("ys", i - 1)), lambda d: d > NEAR_DEPTH)
    return starts.select(*keys, "shank", F.coalesce(F.array_min(steps), F.lit(DEFAULT_PITCH)).alias("pitch_um"))


def depth_groups(channels: DataFrame, avg_depths: bool, keys: Keys = ()) -> DataFrame:
    """Data rows (*keys, data_idx, channels, first_ch, x_um, y_um, shank), numbered by shank, depth and channel.

    With `avg_depths`, channels of a shank within half a micrometre of a group's first depth are one row.
    """
    known = _known(channels, keys)
    if avg_depths:
        starts = known.groupBy(*keys, "shank").agg(anchored_starts(F.sort_array(F.collect_set("y_um")), SAME_DEPTH, True).alias("starts"))
        own = known.join(starts, [*keys, "shank"]).withColumn("y_um", F.array_max(F.filter("starts", lambda s: s <= F.col("y_um"))))
        groups = own.groupBy(*keys, "shank", "y_um").agg(F.sort_array(F.collect_list("ch")).alias("channels"), F.min("ch").alias("first_ch"), F.min_by("x_um", "ch").alias("x_um"))
    else:
        groups = known.select(*keys, "shank", "y_um", F.array("ch").alias("channels"), F.col("ch").alias("first_ch"), "x_um")
    order = Window.partitionBy(*keys).orderBy("shank", "y_um", "first_ch")  # one row per channel group of a probe
    return groups.select(*keys, (F.row_number().over(order) - 1).alias("data_idx"), "channels", "first_ch", "x_um", "y_um", "shank")


def display_rows(channels: DataFrame, avg_depths: bool, keys: Keys = ()) -> DataFrame:
    """(*keys, disp_idx, kind, data_idx, channels, first_ch, x_um, y_um, shank) from the deepest row up.

    kind is 'data', 'gap' (between rows of a shank more than 1.5 pitches apart) or 'boundary' (between
    shanks); markers stand before the row that they separate and have null columns but kind.
    """
    order = Window.partitionBy(*keys).orderBy("data_idx")
    rows = depth_groups(channels, avg_depths, keys).join(pitch_per_shank(channels, keys), [*keys, "shank"])
    step = F.col("y_um") - F.lag("y_um").over(order)
    mark = F.when(F.lag("shank").over(order) != F.col("shank"), "boundary").when(step > GAP_FACTOR * F.col("pitch_um"), "gap")
    rows = rows.withColumn("mark", mark)
    shown = ["data_idx", "channels", "first_ch", "x_um", "y_um", "shank"]
    data = rows.select(*keys, F.col("data_idx").alias("o"), F.lit(1).alias("p"), F.lit("data").alias("kind"), *shown)
    nothing = [F.lit(None).cast(data.schema[c].dataType).alias(c) for c in shown]
    marks = rows.where("mark IS NOT NULL").select(*keys, F.col("data_idx").alias("o"), F.lit(0).alias("p"), F.col("mark").alias("kind"), *nothing)
    whole = data.unionByName(marks)
    return whole.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("o", "p")) - 1).alias("disp_idx"), "kind", *shown)


def channel_range(rows: DataFrame, lo: int, hi: int, clamp: bool = False, keys: Keys = ()) -> DataFrame:
    """One row (*keys, first_idx, last_idx) for each probe: display indices that a channel selection covers.

    The first data row with a channel from `lo` on, and the last one with a channel up to `hi`;
    the whole display where none has. `clamp` keeps last from falling below first.
    """
    data = F.col("kind") == "data"
    found = rows.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(data & (F.col("first_ch") >= lo), F.col("disp_idx"))), F.lit(0)).alias("first_idx"),
        F.coalesce(F.max(F.when(data & (F.col("first_ch") <= hi), F.col("disp_idx"))), F.greatest(F.max("disp_idx"), F.lit(0)), F.lit(0)).alias("last_idx"),
    )
    return found.withColumn("last_idx", F.greatest("last_idx", "first_idx")) if clamp else found


def select_rows(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """The display rows of a channel selection, data rows numbered anew from 0; `full_idx` is the old number."""
    span = channel_range(rows, lo, hi, clamp=True)
    own = rows.join(F.broadcast(span), F.col("disp_idx").between(F.col("first_idx"), F.col("last_idx"))).drop("first_idx", "last_idx")
    number = F.when(F.col("kind") == "data", F.count(F.col("data_idx")).over(Window.orderBy("disp_idx")) - 1).cast("int")
    return own.withColumn("full_idx", F.col("data_idx")).withColumn("data_idx", number)


def row_of_channel(rows: DataFrame, keys: Keys = ()) -> DataFrame:
    """(*keys, channel, disp_idx, data_idx) with channels numbered from 1, for each member of each data row."""
    members = rows.where("kind = 'data'").select(*keys, F.explode("channels").alias("channel"), "disp_idx", "data_idx")
    return members.withColumn("channel", F.col("channel") + 1)


def channel_at_y(rows: DataFrame, height: int, keys: Keys = ()) -> DataFrame:
    """(*keys, py, channel) for each pixel row of a picture of `height`: the channel number from 1 under it, null on a marker."""
    n = rows.groupBy(*keys).agg(F.count("*").cast("long").alias("n"))
    pixels = n.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("py"))
    at = pixels.select(*keys, "py", F.expr(f"CAST(greatest(n - 1 - (py * n) DIV {height}, 0) AS INT)").alias("disp_idx"))
    return at.join(rows, [*keys, "disp_idx"], "left").select(*keys, F.col("py").cast("int").alias("py"), (F.col("first_ch") + 1).alias("channel"))


def depth_delta(channels: DataFrame, keys: Keys = ()) -> DataFrame:
    """(*keys, ch1, ch2, delta_um): vertical distance of each two channels of a probe, ch1 < ch2."""
    known = _known(channels, keys)
    sites = known.groupBy(*keys).agg(F.collect_list(F.struct("ch", "y_um")).alias("all"))  # the channels of one probe
    pairs = known.join(sites, list(keys)) if keys else known.join(F.broadcast(sites), F.lit(True))
    each = pairs.select(*keys, F.col("ch").alias("ch1"), F.col("y_um").alias("y1"), F.explode("all").alias("o")).where("ch1 < o.ch")
    return each.select(*keys, "ch1", F.col("o.ch").alias("ch2"), F.abs(F.col("y1") - F.col("o.y_um")).alias("delta_um"))


def neighbours(rows: DataFrame, near: float, far: float) -> DataFrame:
    """(shank, data_idx, others): rows of the same shank whose distance lies in [near, far], ends included."""
    own = rows.where("data_idx IS NOT NULL").select("shank", "data_idx", "x_um", "y_um")
    other = own.select("shank", F.col("data_idx").alias("j"), F.col("x_um").alias("xj"), F.col("y_um").alias("yj"))
    dist = F.sqrt((F.col("x_um") - F.col("xj")) ** 2 + (F.col("y_um") - F.col("yj")) ** 2)
    return own.join(other, "shank").where(dist.between(near, far)).groupBy("shank", "data_idx").agg(F.sort_array(F.collect_list("j")).alias("others"))


def cluster_shanks(positions: DataFrame, keys: Keys = ()) -> DataFrame:
    """(*keys, ch, x_um, shank) from (*keys, ch, x_um): columns of x more than 100 um from a shank's first column open a shank."""
    xs = positions.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col("x_um").cast("double"))).alias("xs"))
    starts = xs.select(*keys, anchored_starts(_thinned(F.col("xs")), 100.0, False).alias("starts"))
    shank = F.size(F.filter("starts", lambda s: s <= F.col("x_um") + 0.5)) - 1
    own = positions.join(starts, list(keys)) if keys else positions.join(F.broadcast(starts), F.lit(True))
    return own.select(*keys, "ch", "x_um", F.greatest(shank, F.lit(0)).cast("int").alias("shank"))


def _thinned(xs: Column) -> Column:
    """Sorted positions without those under 1 um from the last one kept."""
    return anchored_starts(xs, 1.0, True)
