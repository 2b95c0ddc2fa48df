"""Convolutions, pooling and enlargement of rasters, and the encoder-decoder that scores range images.

An image of a task is a scan's raster, whose size is a parameter; its layers come from the table of
`talus.operators.networks`.  Kernels take images as (channels, height, width).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators import points as P
from talus.operators import raster as R
from talus.operators.networks import Layer

Image = np.ndarray


def convolve(image: Image, layer: Layer) -> Image:
    """A square kernel of odd size over the image with a border of zeros, then the layer's bias, scale, shift and rectifier.

    A row of weights holds, channel by channel, the kernel row by row.
    """
    channels, height, width = image.shape
    side = round((layer.weight[0].size / channels) ** 0.5)
    if side % 2 == 0 or side * side * channels != layer.weight[0].size:
        raise ValueError(f"{layer.weight[0].size} weights a filter fit no square of {channels} channels")
    kernel = layer.weight.reshape(-1, channels, side, side)
    wide = np.pad(image, ((0, 0), (side // 2,) * 2, (side // 2,) * 2))
    out = np.zeros((len(kernel), height * width))
    for r in range(side):
        for c in range(side):
            out += kernel[:, :, r, c] @ wide[:, r : r + height, c : c + width].reshape(channels, -1)
    return np.moveaxis(layer.finish(out.T), 1, 0).reshape(-1, height, width)


def pool(image: Image, scale: tuple[int, int] = (2, 2)) -> Image:
    """The greatest value of every block; rows and columns that fill no block are left out."""
    sh, sw = scale
    channels, height, width = image.shape[0], image.shape[1] // sh, image.shape[2] // sw
    return image[:, : height * sh, : width * sw].reshape(channels, height, sh, width, sw).max((2, 4))


def enlarge(image: Image, scale: tuple[int, int] = (2, 2)) -> Image:
    """Bilinear between pixels, whose outermost stay at the corners of the larger image."""
    for axis, times in ((1, scale[0]), (2, scale[1])):
        n = image.shape[axis]
        at = np.arange(n * times) * ((n - 1) / max(n * times - 1, 1))
        low = np.minimum(at.astype(np.int64), n - 1)
        share = at - low
        share = share[:, None] if axis == 1 else share
        image = np.take(image, low, axis) * (1 - share) + np.take(image, np.minimum(low + 1, n - 1), axis) * share
    return image


def _beside(image: Image, like: Image) -> Image:
    """`like` above the image, which is brought to its size by zeros, the odd one at the end."""
    more = [b - a for a, b in zip(image.shape[1:], like.shape[1:])]
    return np.concatenate([like, np.pad(image, ((0, 0), *[(m // 2, m - m // 2) for m in more]))])


def encoder_decoder(layers: dict[str, Layer], scale: tuple[int, int] = (2, 2)) -> Callable[[Image], Image]:
    """An image's scores by halving and doubling it as often as there are layers `down<level>.<step>` and `up<level>.<step>`.

    `in.<step>` come first; each level down pools by `scale` and convolves, each level up enlarges, sets what the
    way down had at that size beside it, and convolves; `out` ends it.
    """

    def steps(image: Image, prefix: str) -> Image:
        step = 0
        while f"{prefix}.{step}" in layers:
            image, step = convolve(image, layers[f"{prefix}.{step}"]), step + 1
        return image

    levels = 0
    while f"down{levels}.0" in layers:
        levels += 1

    def run(image: Image) -> Image:
        seen = [steps(image, "in")]
        for level in range(levels):
            seen.append(steps(pool(seen[-1], scale), f"down{level}"))
        image = seen.pop()
        for level in range(levels):
            image = steps(_beside(enlarge(image, scale), seen.pop()), f"up{level}")
        return convolve(image, layers["out"])

    return run


# ---- rasters -------------------------------------------------------------------------------------


def map_images(raster: DataFrame, channels: list[str], image: Callable[[Image], Image], outputs: list[str]) -> DataFrame:
    """`scan_id, row, col, <outputs>`: a function from image to image on every scan's raster; pixels without a row, and nulls, are 0.

    Each task holds one image as high and wide as its largest row and column.
    """

    def run(table: pa.Table) -> pa.Table:
        row, col = (table.column(c).to_numpy() for c in ("row", "col"))
        whole = np.zeros((len(channels), row.max() + 1, col.max() + 1))
        for i, name in enumerate(channels):
            whole[i, row, col] = np.nan_to_num(table.column(name).to_numpy(zero_copy_only=False))
        found = np.asarray(image(whole), float)
        if len(found) != len(outputs):
            raise ValueError(f"{len(found)} channels for {len(outputs)} names")
        r, c = (x.ravel() for x in np.indices(found.shape[1:]))
        scan = pa.array(np.full(len(r), table.column("scan_id")[0].as_py()), pa.int64())
        return pa.table({"scan_id": scan, "row": r, "col": c} | {name: np.ascontiguousarray(found[i]).ravel() for i, name in enumerate(outputs)})

    rows = raster.select(*[F.col(c).cast("long").alias(c) for c in R.PIXEL], *[F.col(c).cast("double").alias(c) for c in channels])
    return rows.groupBy("scan_id").applyInArrow(run, "scan_id long, row long, col long, " + ", ".join(f"{c} double" for c in outputs))


#: Channels of a range image in order: range, height, intensity, and the normal's parts.
CHANNELS, NORMALS = ("rho", "low", "i"), ("nx", "ny", "nz")


def range_image(points: DataFrame, means: list[float], deviations: list[float], res_yaw: int, res_pitch: int, fov_pitch: tuple[float, float], normals: bool = False) -> DataFrame:
    """Every pixel's greatest range, lowest height and mean intensity, empty ones 0, less `means` and over `deviations`.

    With `normals` the normals of the range image follow as they are.  Rows scan_id, row, col and the channels.
    """
    px = P.spherical_pixels(points, res_yaw, res_pitch, fov_pitch=fov_pitch)
    rho = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    held = R.rasterize(px, rho=F.max(rho), low=F.min("z"), i=F.avg("i"))
    sizes = points.select("scan_id").distinct().select("scan_id", F.lit(res_pitch).cast("long").alias("height"), F.lit(res_yaw).cast("long").alias("width"))
    image = R.dense(held, sizes, rho=0.0, low=0.0, i=0.0).select(*R.PIXEL, *CHANNELS)
    if normals:
        image = R.spherical_normals(image, "rho", res_pitch, res_yaw, pitch=fov_pitch)
    standard = {c: (F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(CHANNELS, means, deviations, strict=True)}
    return image.withColumns(standard)


def network_ground(
    points: DataFrame, layers: dict[str, Layer], means: list[float], deviations: list[float], res_yaw: int, res_pitch: int,
    fov_pitch: tuple[float, float], normals: bool = False, scale: tuple[int, int] = (2, 2), above: float = 0.5,
) -> DataFrame:
    """Adds `score` and `ground` (a score above `above`): an encoder-decoder on standardised range images, taken back to points.

    Points that share a pixel get the mean score of their three nearest points that do not; points outside the image score 0.
    """
    from talus.operators.detection import transfer_labels

    channels = [*CHANNELS, *(NORMALS if normals else ())]
    image = range_image(points, means, deviations, res_yaw, res_pitch, fov_pitch, normals)
    scored = map_images(image, channels, encoder_decoder(layers, scale), ["logit"])
    share: Column = 1.0 / (1.0 + F.exp(-F.col("logit")))
    px = P.spherical_pixels(points, res_yaw, res_pitch, fov_pitch=fov_pitch)
    own = px.join(scored.select(*R.PIXEL, share.alias("__pixel")), R.PIXEL, "left")
    shared = transfer_labels(own.where(F.col("row") >= 0), "__pixel").withColumnRenamed("score", "__near")
    out = own.join(shared, ["scan_id", "point_id"], "left").withColumn("score", F.coalesce("__near", "__pixel", F.lit(0.0)))
    return out.withColumn("ground", F.col("score") > above).select(*points.columns, "score", "ground")
