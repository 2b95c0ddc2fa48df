"""Flat zones of label images under any neighbourhood, and measures of other images on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators import raster as R

#: More than any image has columns: zones are named by row times this plus column.
WIDTH = 1 << 20


def zones(raster: DataFrame, label: str, neighbours: int = 6, background: int | None = 0) -> DataFrame:
    """Adds `zone` to the pixels: the first pixel, in rows, of those of one label that it touches through its like.

    Pixels of the background label or of none are left out.
    """
    fore = raster.where(F.col(label).isNotNull() if background is None else F.col(label) != background)
    found = G.flat_zones(fore, label, 0.0, WIDTH, neighbours).withColumnRenamed("cc", "zone")
    number = (F.col("row") * WIDTH + F.col("col")).cast("long")
    return R.join_pixels(fore.withColumn("node_id", number), found, ["scan_id", "node_id"]).drop("node_id")


def zone_measure(raster: DataFrame, label: str, value: str, measure: str, neighbours: int = 6, background: int | None = 0) -> DataFrame:
    """Every pixel with a measure of the value image on its own zone; 0 on the background.

    Unlike `region_measure`, which takes all pixels of a label together, parts of a label that do not
    touch are measured apart.  Measures are those of `region_measure`.
    """
    measured = R.region_measure(zones(raster, label, neighbours, background), "zone", value, measure)
    back = R.join_pixels(raster, measured.select(*R.PIXEL, "measure"), R.PIXEL, "left")
    return back.withColumn("measure", F.coalesce("measure", F.lit(0.0)))
