"""Filters, projections and label look-ups of points.

A frame of points has scan_id, point_id, x, y, z, i and label; every operation
works on all scans at once and keeps the ids.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.geometry import clamp, norm, pitch, yaw
from talus.operators.ordered import Cut, ranked

SCAN = ["scan_id"]


def _strictly(value: Column, low, high) -> Column:
    return (value > F.lit(low)) & (value < F.lit(high))


def points_inside(side_range=None, fwd_range=None, height_range=None, intensity_range=None, horizontal_fov=None, vertical_fov=None) -> Column:
    """The conjunction of strict range tests; sideways ranges and horizontal angles count to the right,
    so they are negated and swapped.  The vertical angle is taken against the full range, not the
    horizontal distance."""
    x, y, z, i = (F.col(c) for c in "xyzi")
    test = F.lit(True)
    if side_range is not None:
        test &= _strictly(y, -side_range[1], -side_range[0])
    if fwd_range is not None:
        test &= _strictly(x, *fwd_range)
    if height_range is not None:
        test &= _strictly(z, *height_range)
    if intensity_range is not None:
        test &= _strictly(i, *intensity_range)
    if horizontal_fov is not None:
        test &= _strictly(F.atan2(y, x), -horizontal_fov[1] * pi / 180, -horizontal_fov[0] * pi / 180)
    if vertical_fov is not None:
        test &= _strictly(F.atan2(z, norm(x, y, z)), vertical_fov[0] * pi / 180, vertical_fov[1] * pi / 180)
    return test


def filter_points(points: DataFrame, **ranges) -> DataFrame:
    """Rows inside all given ranges (see `points_inside`); plain ranges reach the Parquet scan."""
    return points.where(points_inside(**ranges))


def sub_cloud(points: DataFrame, mask: Column) -> DataFrame:
    """Ids and coordinates of the rows under a mask; point ids are never renumbered."""
    return points.where(mask).select("scan_id", "point_id", "x", "y", "z")


def bounding_box(points: DataFrame, res_x: float = 1.0, res_y: float = 1.0) -> DataFrame:
    """Extent of every scan and the size of its linear image."""
    box = points.groupBy("scan_id").agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax")
    )
    height = F.ceil((F.col("xmax") - F.col("xmin")) * res_x).cast("long")
    width = F.ceil((F.col("ymax") - F.col("ymin")) * res_y).cast("long")
    return box.withColumn("height", height).withColumn("width", width)


def linear_pixels(points: DataFrame, res_x: float, res_y: float) -> DataFrame:
    """Adds row, col, lidx, height and width of a bird's-eye grid; a point on the far border falls into the last pixel."""
    box = bounding_box(points, res_x, res_y).select("scan_id", "xmin", "ymin", "height", "width")
    row = F.greatest(F.least(F.floor((F.col("x") - F.col("xmin")) * res_x), F.col("height") - 1), F.lit(0)).cast("long")
    col = F.greatest(F.least(F.floor((F.col("y") - F.col("ymin")) * res_y), F.col("width") - 1), F.lit(0)).cast("long")
    # Files of points are small beside their rows: sorted, lest the points be broadcast.
    return (
        points.join(box.hint("merge"), "scan_id")
        .withColumn("row", row)
        .withColumn("col", col)
        .withColumn("lidx", F.col("row") * F.col("width") + F.col("col"))
        .drop("xmin", "ymin")
    )


def _with_pixels(points: DataFrame, row: Column, col: Column, ok: Column, height: int, width: int) -> DataFrame:
    pixel = lambda c: F.when(ok, c.cast("long")).otherwise(F.lit(-1).cast("long"))
    return (
        points.withColumn("row", pixel(row))
        .withColumn("col", pixel(col))
        .withColumn("lidx", F.when(F.col("row") >= 0, F.col("row") * width + F.col("col")).otherwise(F.lit(-1).cast("long")))
        .withColumn("height", F.lit(height).cast("long"))
        .withColumn("width", F.lit(width).cast("long"))
    )


def outside_fov(fov_yaw=(0.0, 2 * pi), fov_pitch=(0.0, pi)) -> Column:
    """True for points outside the inclusive field of view, and at the origin, where pitch is undefined."""
    x, y, z = (F.col(c) for c in "xyz")
    return F.coalesce(~(yaw(x, y).between(*fov_yaw) & pitch(x, y, z).between(*fov_pitch)), F.lit(True))


def spherical_pixels(points: DataFrame, res_yaw: int, res_pitch: int, fov_yaw=(0.0, 2 * pi), fov_pitch=(0.0, pi)) -> DataFrame:
    """Adds pixels of a range image; points outside the field of view get -1."""
    x, y, z = (F.col(c) for c in "xyz")
    row = F.floor((pitch(x, y, z) - min(fov_pitch)) / abs(fov_pitch[1] - fov_pitch[0]) * res_pitch)
    col = F.floor((yaw(x, y) - min(fov_yaw)) / abs(fov_yaw[1] - fov_yaw[0]) * res_yaw)
    row, col = clamp(row, 0, res_pitch - 1), clamp(col, 0, res_yaw - 1)
    return _with_pixels(points, row, col, ~outside_fov(fov_yaw, fov_pitch), res_pitch, res_yaw)


def layer_pixels(points: DataFrame, layer: str | Column = "layer", height: int = 64, width: int = 1024) -> DataFrame:
    """Adds pixels of a range image whose rows are scan lines."""
    # 0.0 - y rather than -y: a negated zero would turn the angle around.
    turn = F.floor((F.atan2(F.lit(0.0) - F.col("y"), F.col("x")) / pi + 1.0) * 0.5 * width)
    layer = F.col(layer) if isinstance(layer, str) else layer
    return _with_pixels(points, layer, clamp(turn, 0, width - 1), F.lit(True), height, width)


def project(points: DataFrame, kind: str, **params) -> DataFrame:
    """Dispatch to the projection named linear, spherical or layers (also called conv)."""
    kinds = {"linear": linear_pixels, "spherical": spherical_pixels, "layers": layer_pixels, "conv": layer_pixels}
    if kind not in kinds:
        raise ValueError(f"unknown projection {kind!r}; known: {', '.join(sorted(kinds))}")
    return kinds[kind](points, **params)


def rigid_transform(points: DataFrame, rotation, shift) -> DataFrame:
    """R p + b by three linear expressions."""
    x, y, z = (F.col(c) for c in "xyz")
    new = [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(b)) for r, b in zip(rotation, shift)]
    return points.withColumns(dict(zip("xyz", new)))


def quantize_z(z: Column, min_z: float | Column, res_z: float) -> Column:
    """Height level from 1 upwards; heights below `min_z` count as `min_z`."""
    return (F.floor(F.greatest(z - min_z, F.lit(0.0)) * res_z) + 1).cast("long")


def scan_layers(points: DataFrame, max_layers: int = 64, window: int = 20) -> DataFrame:
    """Adds `layer`: scan lines found by the sign changes of the smoothed angle, numbered from the end.

    The angle is opened (minimum, then maximum) over `window` rows in file order; every change
    from negative to not negative starts a line.  Where a scan has fewer than `max_layers` lines, but
    more than one, what precedes its first change is split again wherever the opened angle falls, into
    as many lines as are lacking: the first ends at the first fall, each other starts at one from the
    second on, the last takes the rest.  What belongs to no line, between the first two falls or beyond
    the only one, has layer 0.  A window over one scan is a window over the rows of one file.
    """
    order = Window.partitionBy("scan_id").orderBy("point_id")
    whole = Window.partitionBy("scan_id")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    half = window // 2
    low = order.rowsBetween(-half, window - half - 1)
    high = order.rowsBetween(-(window - half - 1), half)
    rows = points.withColumn("__low", F.min(F.atan2("y", "x")).over(low))
    rows = rows.withColumn("__open", F.max("__low").over(high))
    rows = rows.withColumn("__start", ((F.col("__open") >= 0) & (F.lag(F.col("__open") >= 0, 1, True).over(order) == F.lit(False))).cast("long"))
    rows = rows.withColumn("__line", F.sum("__start").over(running)).withColumn("__last", F.sum("__start").over(whole))
    # Falls of the angle before the first change; the row before a fall counts as its place.
    falls = (F.col("__line") == 0) & (F.lead("__line").over(order) == 0) & (F.lead("__open").over(order) < F.col("__open"))
    rows = rows.withColumn("__fall", F.coalesce(falls, F.lit(False)).cast("long"))
    rows = rows.withColumn("__part", F.sum("__fall").over(running))
    parts = F.least(F.sum("__fall").over(whole), F.lit(max_layers) - F.col("__last"))
    rows = rows.withColumn("__parts", parts)
    split = (F.col("__line") == 0) & (F.col("__last") > 0) & (F.col("__last") + 1 < max_layers)
    part = F.when((F.col("__part") == 0) & (F.col("__parts") > 0), 0).when((F.col("__part") > 1) & (F.col("__parts") > 1), F.least(F.col("__part"), F.col("__parts")) - 1)
    top = F.lit(max_layers - 1) - F.col("__last")
    layer = F.when(split, F.coalesce(top - (F.col("__parts") - 1 - part), F.lit(0))).otherwise(top + F.col("__line"))
    return rows.withColumn("layer", layer.cast("long")).drop("__low", "__open", "__start", "__line", "__last", "__fall", "__part", "__parts")


def subsample_layers(points: DataFrame, ratio: int) -> DataFrame:
    """Every `ratio`-th scan line of points that have `layer`."""
    return points.where(F.pmod(F.col("layer"), F.lit(ratio)) == 0)


# ---- labels ------------------------------------------------------------------------------------


def unpack_label(packed: Column) -> tuple[Column, Column]:
    """Semantic and instance part of an unsigned 32-bit label."""
    packed = packed.cast("long")
    return packed.bitwiseAND(F.lit(0xFFFF)), F.shiftright(packed.bitwiseAND(F.lit(0xFFFFFFFF)), 16)


def pack_label(semantic: Column, instance: Column) -> Column:
    return semantic.cast("long") + F.shiftleft(instance.cast("long"), 16)


def look_up(df: DataFrame, key: str, table: DataFrame, columns: list[str], default=0) -> DataFrame:
    """Left join with a label table; keys that it lacks get the default, as in a dense table of zeros."""
    joined = df.join(table.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})


def map_label(label: Column, mapping: dict[int, int], default: int = 0) -> Column:
    """A label mapped by a fixed small table inside the expression; no join."""
    table = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, label.cast("int")), F.lit(default))


#: Labels of ground surfaces.
GROUND_LABELS = (40, 44, 48, 49, 60, 72)


def is_ground(label: Column) -> Column:
    return label.isin(*GROUND_LABELS).cast("int")


def agreement_colour(truth: Column, predicted: Column) -> Column:
    """Grey level of true positives, true negatives, false positives and false negatives."""
    return (
        F.when(truth & predicted, 225).when(~truth & ~predicted, 0).when(~truth & predicted, 75).otherwise(150)
    )


def quota_sample(df: DataFrame, group: str, ids: list[str], quota: Column, cut: Cut) -> DataFrame:
    """The first rows of each group in the order of `ids`, as many as `quota` says (an expression over `n`, the group's size).

    Places come from sums by ranges of group and order, so a group of any size is spread; `cut` stores the ranges.
    """
    placed = ranked(df.withColumnRenamed("n", "__n"), [group], [F.col(c) for c in ids], cut, "__place").withColumnRenamed("__place_all", "n")
    return placed.where(F.col("__place") <= quota).drop("__place", "n").withColumnRenamed("__n", "n")


def subset(df: DataFrame, belongs: Column, by: str, order: str) -> DataFrame:
    """The rows of a subset with their place in it, from 0, in the order of their ids: the map from subset to set."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return df.where(belongs).withColumn("place", place.cast("long"))


def first_difference(value: Column, by: str, order: str) -> Column:
    """Value less that of the row before; null at the first row of a group."""
    return value - F.lag(value).over(Window.partitionBy(by).orderBy(order))


def nth_smallest(df: DataFrame, value: str, n: int, by: str, tie: str) -> DataFrame:
    """The n-th smallest value (from 1) of each group that has as many."""
    order = Window.partitionBy(by).orderBy(value, tie)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == n).select(by, value)


def las_levels(points: DataFrame, scale: float = 0.001) -> DataFrame:
    """Integer coordinates of a point file: offset at the scan's minimum, steps of `scale`."""
    low = points.groupBy("scan_id").agg(*[F.min(c).alias(f"{c}_offset") for c in "xyz"])
    joined = points.join(low, "scan_id")
    return joined.withColumns({f"{c}_level": F.floor((F.col(c) - F.col(f"{c}_offset")) / scale + 0.5).cast("long") for c in "xyz"})
