"""Rasters: sparse frames of (scan_id, row, col, channels), aggregates, back-projection, morphology, normals."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from talus.operators.points import quantize_z

PIXEL = ["scan_id", "row", "col"]


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt in turn, or by columns, to as many tasks as a shuffle has at most.

    Adaptive execution merges shuffled partitions by their bytes, so a row a scan, or well packed pixels, end in one
    task that then makes or sorts all images.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def join_pixels(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two images by shuffling and sorting both.

    Estimates do not count the pixels that `explode` makes, nor what a grouped function returns, so a whole image
    table passes for a small side and would be broadcast through the driver.
    """
    return left.join(right.hint("merge"), on, how)


# ---- from points ---------------------------------------------------------------------------------


def aggregate(name: str, value: Column, key: Column | None = None, tie: str = "point_id") -> Column:
    """A collision aggregate by name: max, min, sum, mean, argmin and argmax (of `key`; ties to the lowest id)."""
    if name in ("argmin", "argmax"):
        if key is None:
            raise ValueError(f"{name} needs a key")
        place = F.struct(key, F.col(tie)) if name == "argmin" else F.struct(-key, F.col(tie))
        return F.min_by(value, place)
    known: dict[str, Callable] = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}
    if name not in known:
        raise ValueError(f"unknown aggregate {name!r}; known: argmax, argmin, {', '.join(sorted(known))}")
    return known[name](value)


def rasterize(points: DataFrame, **channels: Column) -> DataFrame:
    """One row an occupied pixel; points outside the image (-1) are left out."""
    # The row decides as lidx does, whose expression holds that of the row twice where the test is pushed below it.
    return points.where(F.col("row") >= 0).groupBy(*PIXEL).agg(*[c.alias(k) for k, c in channels.items()])


def dense(raster: DataFrame, sizes: DataFrame, **fill) -> DataFrame:
    """All pixels of every scan's image (`sizes`: scan_id, height, width), empty ones filled."""
    rows = F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1))
    grid = spread(sizes).select("scan_id", "width", rows.alias("row")).select("scan_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("col"))
    joined = join_pixels(grid, raster, PIXEL, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def height_images(points: DataFrame, min_z: float | Column, res_z: float, top: int = 255) -> DataFrame:
    """Lowest and highest level, clipped count and label of the highest point of every pixel.

    Points below `min_z` do not count for the lowest level; pixels that hold no other get level 1.
    """
    rows = points.withColumn("level", quantize_z(F.col("z"), min_z, res_z))
    im_min = F.coalesce(F.min(F.when(F.col("z") >= min_z, F.col("level"))), F.lit(1).cast("long"))
    return rasterize(
        rows,
        im_min=im_min,
        im_max=F.max("level"),
        im_acc=F.least(F.count(F.lit(1)), F.lit(top)).cast("long"),
        im_class=aggregate("argmax", F.col("label"), F.col("level")),
    )


def back_project(points: DataFrame, raster: DataFrame, channel: str, into: str) -> DataFrame:
    """Pixel values on points; where the value is missing or not positive the point keeps what it had (0)."""
    had = F.col(into) if into in points.columns else F.lit(0)
    joined = join_pixels(points, raster.select(*PIXEL, F.col(channel).alias("__v")), PIXEL, "left")
    return joined.withColumn(into, F.when(F.col("__v") > 0, F.col("__v")).otherwise(had)).drop("__v")


def back_project_ground(points: DataFrame, raster: DataFrame, min_z: float | Column, res_z: float, delta: float) -> DataFrame:
    """Adds `ground`: whether a point is at most `delta` above the lowest level of a ground pixel.

    The raster has im_min, is_ground and optionally im_delta, a factor on `delta`.
    """
    factor = F.col("im_delta") if "im_delta" in raster.columns else F.lit(1.0)
    pixels = raster.select(*PIXEL, "im_min", "is_ground", factor.alias("__factor"))
    joined = join_pixels(points, pixels, PIXEL, "left")
    near = quantize_z(F.col("z"), min_z, res_z) - F.col("im_min") <= F.lit(delta * res_z) * F.col("__factor")
    return joined.withColumn("ground", F.coalesce(F.col("is_ground") & near, F.lit(False))).drop("im_min", "is_ground", "__factor")


def standardize(raster: DataFrame, channels: list[str]) -> DataFrame:
    """(value - mean) / population deviation of every channel of a scan's image."""
    stats = raster.groupBy("scan_id").agg(*[f(c).alias(f"__{n}_{c}") for c in channels for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = raster.join(stats, "scan_id")
    out = {c: (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) for c in channels}
    return joined.withColumns(out).select(*raster.columns)


# ---- regions -------------------------------------------------------------------------------------


def accumulate(df: DataFrame, index: str, value: str, how: str, size: int | None = None, fill=0) -> DataFrame:
    """Values combined by index; with `size` every index from 0 on, untouched ones filled.

    plus, minus (zero less the sum), times, max, min, and, or.
    """
    v = F.col(value)
    known = {
        "plus": F.sum(v), "minus": F.lit(0) - F.sum(v), "times": F.product(v), "max": F.max(v), "min": F.min(v),
        "and": F.bool_and(v.cast("boolean")), "or": F.bool_or(v.cast("boolean")),
    }
    if how not in known:
        raise ValueError(f"unknown combination {how!r}; known: {', '.join(sorted(known))}")
    out = df.groupBy(index).agg(known[how].alias(value))
    if size is None:
        return out
    every = df.sparkSession.range(size).select(F.col("id").alias(index))
    return every.join(out, index, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def region_mean(raster: DataFrame, label: str, value: str) -> DataFrame:
    """Every pixel with the mean of its region, joined back from one row a region."""
    means = raster.groupBy("scan_id", label).agg(F.avg(value).alias(f"{value}_mean"))
    return join_pixels(raster, means, ["scan_id", label])


MEASURES = {
    "mean": lambda v: F.floor(F.avg(v)),
    "max": F.max,
    "min": F.min,
    "mode": lambda v: F.min_by("__v", F.struct(-F.col("__n"), F.col("__v"))),
    "median": lambda v: F.percentile(v, F.lit(0.5)),
    "nb": lambda v: F.count_if(v != 0),
    "nbLab": F.countDistinct,
}


def region_measure(raster: DataFrame, label: str, value: str, measure: str) -> DataFrame:
    """One measure of a value image on every region of a label image, given back to its pixels."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known: {', '.join(sorted(MEASURES))}")
    keys = ["scan_id", label]
    if measure == "mode":
        counted = raster.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        out = counted.groupBy(*keys).agg(MEASURES["mode"](None).alias("measure"))
    else:
        out = raster.groupBy(*keys).agg(MEASURES[measure](F.col(value)).alias("measure"))
    return join_pixels(raster, out.withColumn("measure", F.col("measure").cast("double")), keys)


def bounding_boxes(raster: DataFrame, label: str, margin: int = 12) -> DataFrame:
    """Bounding box and centroid of every region, widened by a margin and cut at 0."""
    return raster.groupBy("scan_id", label).agg(
        F.greatest(F.min("row") - margin, F.lit(0)).alias("row0"), (F.max("row") + margin).alias("row1"),
        F.greatest(F.min("col") - margin, F.lit(0)).alias("col0"), (F.max("col") + margin).alias("col1"),
        F.avg("row").alias("row_mean"), F.avg("col").alias("col_mean"),
    )


def stick(first: DataFrame, second: DataFrame, height: int, width: int, overlap: int, across: bool = True) -> DataFrame:
    """Two images side by side (or one above the other); in the overlap the second wins."""
    shift, axis = (width, "col") if across else (height, "row")
    moved = second.withColumn(axis, F.col(axis) + (shift - overlap))
    return join_pixels(first, moved.select(*PIXEL), PIXEL, "left_anti").unionByName(moved)


def shifted(raster: DataFrame, value: str, by: int, axis: str = "row", fill=0) -> DataFrame:
    """A dense image's values moved `by` pixels down (or right, by `col`); what comes in from outside is `fill`."""
    if axis not in ("row", "col"):
        raise ValueError("an image is shifted along row or col")
    line = Window.partitionBy("scan_id", "col" if axis == "row" else "row").orderBy(axis)
    moved = F.lag(value, by).over(line) if by >= 0 else F.lead(value, -by).over(line)
    return raster.withColumn(value, F.coalesce(moved, F.lit(fill)))


def shifted_on_torus(raster: DataFrame, by: int, size: int | Column, axis: str = "row") -> DataFrame:
    """An image moved `by` pixels up (or left, by `col`), around its edge: pixels get new numbers and no row moves."""
    if axis not in ("row", "col"):
        raise ValueError("an image is shifted along row or col")
    return raster.withColumn(axis, F.pmod(F.col(axis) - F.lit(by), size if isinstance(size, Column) else F.lit(size)))


# ---- morphology ----------------------------------------------------------------------------------


def _separable(raster: DataFrame, value: str, f: Callable, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A square filter as a filter along rows and one along columns: two windows, no copies of pixels."""
    along = Window.partitionBy("scan_id", "row").orderBy("col").rangeBetween(*cols)
    down = Window.partitionBy("scan_id", "col").orderBy("row").rangeBetween(*rows)
    return raster.withColumn(value, f(value).over(along)).withColumn(value, f(value).over(down))


def filter_rectangle(raster: DataFrame, value: str, how: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Greatest (`dilate`) or least (`erode`) value within the given row and column offsets, also of lines and even sizes."""
    known = {"dilate": F.max, "erode": F.min}
    if how not in known:
        raise ValueError(f"unknown filter {how!r}; known: dilate, erode")
    return _separable(raster, value, known[how], rows, cols)


def opened_rectangle(raster: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """Opening by a rectangle of pixels: what no whole rectangle fits into goes."""
    low = filter_rectangle(raster, value, "erode", (0, height - 1), (0, width - 1))
    return filter_rectangle(low, value, "dilate", (1 - height, 0), (1 - width, 0))


def dilate(raster: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """Largest value within `radius` rows and columns, on the pixels that the raster has."""
    return _separable(raster, value, F.max, (-radius, radius), (-radius, radius))


def erode(raster: DataFrame, value: str, radius: int = 1) -> DataFrame:
    return _separable(raster, value, F.min, (-radius, radius), (-radius, radius))


def filter_hexagon(raster: DataFrame, value: str, how: str, radius: int = 1) -> DataFrame:
    """Largest or smallest (`max`, `min`) value within a hexagon of a dense image, whose odd rows lie half a pixel to the right.

    A hexagon of a radius is the smallest one, a pixel and its six neighbours, applied as often.
    """
    if how not in ("max", "min"):
        raise ValueError("how is max or min")
    f, most = (F.max, F.greatest) if how == "max" else (F.min, F.least)
    across, down = Window.partitionBy("scan_id", "row").orderBy("col"), Window.partitionBy("scan_id", "col").orderBy("row")
    for _ in range(radius):
        # A row's two pixels that touch each pixel of the rows above and below it.
        side = F.when(F.col("row") % 2 == 0, f(value).over(across.rangeBetween(0, 1))).otherwise(f(value).over(across.rangeBetween(-1, 0)))
        raster = raster.withColumn("__own", f(value).over(across.rangeBetween(-1, 1))).withColumn("__side", side)
        near = [f("__side").over(down.rangeBetween(k, k)) for k in (-1, 1)]
        raster = raster.withColumn(value, most("__own", *near)).drop("__own", "__side")
    return raster


def opened_hexagon(raster: DataFrame, value: str, radius: int = 1) -> DataFrame:
    return filter_hexagon(filter_hexagon(raster, value, "min", radius), value, "max", radius)


def opened(raster: DataFrame, value: str, radius: int = 1) -> DataFrame:
    return dilate(erode(raster, value, radius), value, radius)


def opened_square(raster: DataFrame, value: str, size: int = 2) -> DataFrame:
    """Opening by a square of `size` pixels, which may be even: what no whole square fits into goes."""
    return opened_rectangle(raster, value, size, size)


def closed(raster: DataFrame, value: str, radius: int = 1) -> DataFrame:
    return erode(dilate(raster, value, radius), value, radius)


def fill_holes(raster: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """Pixels of value 0 take the closing's value."""
    kept = raster.withColumn("__own", F.col(value))
    return closed(kept, value, radius).withColumn(value, F.when(F.col("__own") == 0, F.col(value)).otherwise(F.col("__own"))).drop("__own")


# ---- normals -------------------------------------------------------------------------------------


def spherical_normals(raster: DataFrame, rho: str, height: int, width: int, pitch=(85 * pi / 180, 115 * pi / 180), yaw=(0.0, 2 * pi), res_rho: float = 1.0) -> DataFrame:
    """Adds nx, ny, nz of a dense range image: the cross product of the surface's derivatives along pitch and yaw.

    Central differences; along pitch the first row has the opposite sign and the last is one-sided,
    along yaw the image wraps.  Zero where there is no range.  One task works on one scan's image.
    """
    d_pitch, d_yaw = (pitch[1] - pitch[0]) / (height - 1), (yaw[1] - yaw[0]) / (width - 1)
    a, b = pitch[0] + np.arange(height)[:, None] * d_pitch, yaw[0] + np.arange(width)[None, :] * d_yaw
    sp, cp, sy, cy = np.sin(a), np.cos(a), np.sin(b), np.cos(b)

    def run(table: pa.Table) -> pa.Table:
        row, col = (np.asarray(table.column(c)) for c in ("row", "col"))
        r = np.zeros((height, width))
        r[row, col] = np.asarray(table.column(rho), float) / res_rho
        rp = np.empty_like(r)
        rp[1:-1] = (r[2:] - r[:-2]) / 2
        rp[0], rp[-1] = r[0] - r[1], r[-1] - r[-2]
        ry = (np.roll(r, -1, 1) - np.roll(r, 1, 1)) / 2
        p = (rp * sp * cy + r * d_pitch * cp * cy, rp * sp * sy + r * d_pitch * cp * sy, rp * cp - r * d_pitch * sp)
        t = (ry * sp * cy - r * d_yaw * sp * sy, ry * sp * sy + r * d_yaw * sp * cy, ry * cp)
        n = np.stack([p[1] * t[2] - p[2] * t[1], p[2] * t[0] - p[0] * t[2], p[0] * t[1] - p[1] * t[0]])
        length = np.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
        seen = (r != 0) & (length != 0)
        n *= np.where(seen, 1.0 / np.where(seen, length, 1.0), 0.0)
        for name, values in zip(("nx", "ny", "nz"), n):
            table = table.append_column(name, pa.array(values[row, col]))
        return table

    rows = raster.drop("nx", "ny", "nz")
    schema = StructType([*rows.schema.fields, *[StructField(c, DoubleType()) for c in ("nx", "ny", "nz")]])
    return rows.groupBy("scan_id").applyInArrow(run, schema)
