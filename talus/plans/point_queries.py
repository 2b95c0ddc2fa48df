"""Queries on points, projections, labels and rasters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions.geometry import logistic
from talus.operators import points as P
from talus.operators import raster as R
from talus.plans.fixtures import POINTS, points, r6
from talus.storage import stored

PI = "3.141592653589793e0"
QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _pts(sql: str) -> str:
    return f"with {POINTS} {sql}" if sql.lstrip().startswith("select") else f"with {POINTS}, {sql}"


# ---- filters -------------------------------------------------------------------------------------


@register(
    "filter_points",
    _pts(
        "select scan_id, point_id, x, y, z, i from points where y > -20e0 and y < 20e0 and x > -10e0 and x < 35e0 "
        "and z > -2e0 and z < -0.5e0 and i > 0.05e0 and i < 0.9e0"
    ),
)
def filter_points(spark, d):
    rows = P.filter_points(points(spark, d), side_range=(-20.0, 20.0), fwd_range=(-10.0, 35.0), height_range=(-2.0, -0.5), intensity_range=(0.05, 0.9))
    return rows.select("scan_id", "point_id", "x", "y", "z", "i")


@register("horizontal_fov", _pts(f"select scan_id, point_id from points where atan2(y, x) > -50e0*{PI}/180 and atan2(y, x) < 30e0*{PI}/180"))
def horizontal_fov(spark, d):
    return P.filter_points(points(spark, d), horizontal_fov=(-30.0, 50.0)).select("scan_id", "point_id")


@register("vertical_fov", _pts(f"select scan_id, point_id from points where atan2(z, sqrt(x*x+y*y+z*z)) < 2e0*{PI}/180 and atan2(z, sqrt(x*x+y*y+z*z)) > -5e0*{PI}/180"))
def vertical_fov(spark, d):
    return P.filter_points(points(spark, d), vertical_fov=(-5.0, 2.0)).select("scan_id", "point_id")


@register("sub_cloud", _pts("select scan_id, point_id, x, y, z from points where z < -1.5e0"))
def sub_cloud(spark, d):
    return P.sub_cloud(points(spark, d), F.col("z") < -1.5)


@register(
    "bounding_box",
    _pts("select scan_id, min(x) as xmin, max(x) as xmax, min(y) as ymin, max(y) as ymax, ceil((max(x)-min(x))*5)::bigint as height, ceil((max(y)-min(y))*5)::bigint as width from points group by 1"),
)
def bounding_box(spark, d):
    return P.bounding_box(points(spark, d), 5.0, 5.0)


# ---- projections ---------------------------------------------------------------------------------


def pixels_sql(res: float = 0.5) -> str:
    """CTE px: points with row, col, lidx, height and width of the linear image."""
    return f"""box as (
  select scan_id, min(x) as xmin, min(y) as ymin, ceil((max(x)-min(x))*{res}e0)::bigint as height, ceil((max(y)-min(y))*{res}e0)::bigint as width from points group by 1
), placed as (
  select p.*, height, width, greatest(least(floor((x-xmin)*{res}e0)::bigint, height-1), 0) as row, greatest(least(floor((y-ymin)*{res}e0)::bigint, width-1), 0) as col
  from points p join box using (scan_id)
), px as (select *, row*width+col as lidx from placed)"""


def pixels(spark, d, res: float = 0.5):
    return P.linear_pixels(points(spark, d), res, res)


@register("linear_projection", _pts(pixels_sql(5.0) + "select scan_id, point_id, row, col, lidx from px"))
def linear_projection(spark, d):
    return pixels(spark, d, 5.0).select("scan_id", "point_id", "row", "col", "lidx")


def spherical_sql(res_yaw: int = 64, res_pitch: int = 16, low: float = 1.2, high: float = 1.9) -> str:
    return f"""ang as (
  select *, atan2(y, x) + {PI} as yaw, acos(least(greatest(z / sqrt(x*x+y*y+z*z), -1e0), 1e0)) as pitch from points
), sph as (
  select *, yaw between 0e0 and 2e0*{PI} and pitch between {low}e0 and {high}e0 as inside,
    greatest(least(floor((pitch - {low}e0) / abs({high}e0 - {low}e0) * {res_pitch})::bigint, {res_pitch}-1), 0) as r,
    greatest(least(floor(yaw / (2e0*{PI}) * {res_yaw})::bigint, {res_yaw}-1), 0) as c from ang
), sp as (
  select * exclude (r, c), case when inside then r else -1 end as row, case when inside then c else -1 end as col,
    case when inside then r*{res_yaw}+c else -1 end as lidx from sph
)"""


def spherical(spark, d, res_yaw: int = 64, res_pitch: int = 16, low: float = 1.2, high: float = 1.9):
    return P.spherical_pixels(points(spark, d), res_yaw, res_pitch, fov_pitch=(low, high))


@register("spherical_projection", _pts(spherical_sql() + "select scan_id, point_id, row, col, lidx from sp"))
def spherical_projection(spark, d):
    return spherical(spark, d).select("scan_id", "point_id", "row", "col", "lidx")


@register("outside_fov", _pts(spherical_sql() + "select scan_id, point_id from sp where not inside"))
def outside_fov(spark, d):
    return points(spark, d).where(P.outside_fov(fov_pitch=(1.2, 1.9))).select("scan_id", "point_id")


LAYER_SQL = f"select scan_id, point_id, (point_id % 64)::bigint as row, greatest(least(floor((atan2(0e0 - y, x)/{PI} + 1e0)*0.5e0*1024)::bigint, 1023), 0) as col"


@register("layer_projection", _pts(f"lay as ({LAYER_SQL} from points) select *, row*1024+col as lidx from lay"))
def layer_projection(spark, d):
    rows = P.project(points(spark, d).withColumn("layer", F.col("point_id") % 64), "layers")
    return rows.select("scan_id", "point_id", "row", "col", "lidx")


@register("rigid_transform", _pts("select scan_id, point_id, 0.8e0*x + -0.6e0*y + 0e0*z + 1.5e0 as x, 0.6e0*x + 0.8e0*y + 0e0*z + -2e0 as y, 0e0*x + 0e0*y + 1e0*z + 0.25e0 as z from points"))
def rigid_transform(spark, d):
    moved = P.rigid_transform(points(spark, d), [[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1]], [1.5, -2.0, 0.25])
    return moved.select("scan_id", "point_id", "x", "y", "z")


@register("quantize_z", _pts("select scan_id, point_id, floor(greatest(z - -1.7e0, 0e0)*10)::bigint + 1 as level from points"))
def quantize_z(spark, d):
    return points(spark, d).select("scan_id", "point_id", P.quantize_z(F.col("z"), -1.7, 10.0).alias("level"))


@register("logistic", _pts("select scan_id, point_id, round(1e0/(1e0+exp(-32e0*(i-0.7e0))), 6) + 0e0 as v from points"))
def logistic_query(spark, d):
    return points(spark, d).select("scan_id", "point_id", r6(logistic(F.col("i"), 0.7, 1.0, 32.0)).alias("v"))


@register("point_norms", _pts("select scan_id, point_id, sqrt(x*x+y*y+z*z) as l2, abs(x)+abs(y)+abs(z) as l1, greatest(abs(x), abs(y), abs(z)) as linf, y*1e0 - z*0e0 as cx, z*2e0 - x*1e0 as cy, x*0e0 - y*2e0 as cz from points"))
def point_norms(spark, d):
    from talus.functions import geometry as G

    v = [F.col(c) for c in "xyz"]
    c = G.cross(v, [F.lit(2.0), F.lit(0.0), F.lit(1.0)])
    return points(spark, d).select("scan_id", "point_id", G.norm(*v).alias("l2"), G.norm1(*v).alias("l1"), G.norm_inf(*v).alias("linf"), c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"))


@register("las_quantize", _pts("o as (select scan_id, min(x) ox, min(y) oy, min(z) oz from points group by 1) select scan_id, point_id, floor((x-ox)/0.001e0+0.5e0)::bigint as x_level, floor((y-oy)/0.001e0+0.5e0)::bigint as y_level, floor((z-oz)/0.001e0+0.5e0)::bigint as z_level from points join o using (scan_id)"))
def las_quantize(spark, d):
    return P.las_levels(points(spark, d)).select("scan_id", "point_id", "x_level", "y_level", "z_level")


#: Lines as intervals of positions: of a scan's changes, and of the falls before the first of them.
LAYER_INTERVALS = """
lows as (
  select scan_id, point_id, row_number() over (partition by scan_id order by point_id) - 1 as pos,
         min(atan2(y, x)) over (partition by scan_id order by point_id rows between 10 preceding and 9 following) as lo
  from points
), opened as (
  select scan_id, point_id, pos, max(lo) over (partition by scan_id order by point_id rows between 9 preceding and 10 following) as op from lows
), sizes as (
  select scan_id, count(*) as n from opened group by 1
), changes as (
  select scan_id, pos, row_number() over (partition by scan_id order by pos) as k
  from (select *, lag(op) over (partition by scan_id order by pos) as before from opened) where op >= 0 and before < 0
), counted as (
  select scan_id, n, count(c.pos) as n_changes, min(c.pos) as first_change from sizes left join changes c using (scan_id) group by 1, 2
), falls as (
  select scan_id, pos, row_number() over (partition by scan_id order by pos) - 1 as i
  from (select scan_id, pos, op, lead(op) over (partition by scan_id order by pos) as after from opened join counted using (scan_id) where pos < first_change)
  where after < op
), budgets as (
  select scan_id, first_change, least(count(f.pos), 64 - n_changes) as m from counted left join falls f using (scan_id)
  where n_changes between 1 and 62 group by scan_id, first_change, n_changes
), intervals as (
  select c.scan_id, c.pos as a, coalesce(d.pos, n) as b from changes c join counted using (scan_id) left join changes d on d.scan_id = c.scan_id and d.k = c.k + 1
  union all
  select scan_id, 0, coalesce(first_change, n) from counted where n_changes = 0 or n_changes >= 63
  union all
  select f.scan_id, case when f.i = 0 then 0 else f.pos end, case when f.i = 0 then f.pos when f.i = m - 1 then first_change else g.pos end
  from falls f join budgets using (scan_id) left join falls g on g.scan_id = f.scan_id and g.i = f.i + 1 where f.i < m
), numbered as (
  select *, 64 - row_number() over (partition by scan_id order by a desc, b desc) as layer from intervals
)
select o.scan_id, o.point_id, cast(coalesce(max(layer), 0) as bigint) as layer
from opened o left join numbered v on v.scan_id = o.scan_id and o.pos >= v.a and o.pos < v.b group by 1, 2"""


@register("scan_layers", _pts(LAYER_INTERVALS))
def scan_layers(spark, d):
    return P.scan_layers(points(spark, d)).select("scan_id", "point_id", "layer")


@register("layer_subsample", _pts("select scan_id, point_id, point_id % 64 as layer from points where (point_id % 64) % 4 = 0"))
def layer_subsample(spark, d):
    return P.subsample_layers(points(spark, d).withColumn("layer", F.col("point_id") % 64), 4).select("scan_id", "point_id", "layer")


# ---- labels --------------------------------------------------------------------------------------

#: Label, learning class, ground flag, group and colour of the labels in the fixture.
LABELS = [(0, 0, 0, 0, 0, 0, 0), (10, 1, 0, 1, 245, 150, 100), (40, 9, 1, 4, 255, 0, 255), (50, 13, 0, 5, 0, 200, 255), (72, 17, 1, 4, 80, 240, 150)]
LABEL_SQL = "dim(label, learn_id, ground, grp, r, g, b) as (values " + ", ".join(str(x) for x in LABELS if x[0] != 50) + ")"


def label_table(spark):
    return spark.createDataFrame([x for x in LABELS if x[0] != 50], "label int, learn_id int, ground int, grp int, r int, g int, b int")


@register("label_remap", _pts(LABEL_SQL + " select scan_id, point_id, coalesce(learn_id, 0) as learn_id, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b from points left join dim using (label)"))
def label_remap(spark, d):
    rows = P.look_up(points(spark, d), "label", label_table(spark), ["learn_id", "r", "g", "b"])
    return rows.select("scan_id", "point_id", "learn_id", "r", "g", "b")


@register("label_ground_flag", _pts("select scan_id, point_id, (label in (40,44,48,49,60,72))::int as ground from points"))
def label_ground_flag(spark, d):
    return points(spark, d).select("scan_id", "point_id", P.is_ground(F.col("label")).alias("ground"))


@register("label_unpack", _pts("pk as (select scan_id, point_id, label + (point_id % 7)*65536 as v from points) select scan_id, point_id, v & 65535 as semantic, v >> 16 as instance from pk"))
def label_unpack(spark, d):
    rows = points(spark, d)
    packed = rows.withColumn("v", P.pack_label(F.col("label"), F.col("point_id") % 7))
    s, i = P.unpack_label(F.col("v"))
    return packed.select("scan_id", "point_id", s.alias("semantic"), i.alias("instance"))


@register("bool_coloring", _pts("q as (select scan_id, point_id, label in (40,44,48,49,60,72) as t, z < -1.55e0 as p from points) select scan_id, point_id, case when t and p then 225 when not t and not p then 0 when not t and p then 75 else 150 end as grey from q"))
def bool_coloring(spark, d):
    rows = points(spark, d)
    return rows.select("scan_id", "point_id", P.agreement_colour(P.is_ground(F.col("label")) == 1, F.col("z") < -1.55).alias("grey"))


@register("stratified_sample", _pts("n as (select label, count(*) as n from points group by 1), k as (select *, row_number() over (partition by label order by (point_id*7919) % 10007, point_id) as rk from points) select scan_id, point_id, label from k join n using (label) where rk <= greatest(floor(n*0.1e0)::bigint, 1)"))
def stratified_sample(spark, d):
    rows = points(spark, d).withColumn("h", (F.col("point_id") * 7919) % 10007)
    return P.quota_sample(rows, "label", ["h", "point_id"], F.greatest(F.floor(F.col("n") * 0.1), F.lit(1)), stored).select("scan_id", "point_id", "label")


# ---- raster aggregates ---------------------------------------------------------------------------


def _pixel_query(name: str, sql: str, channel):
    @register(name, _pts(pixels_sql() + f"select scan_id, row, col, {sql} from px group by 1, 2, 3"))
    def run(spark, d):
        return R.rasterize(pixels(spark, d), **channel())

    return run


_pixel_query("raster_max", "max(z) as v", lambda: {"v": R.aggregate("max", F.col("z"))})
_pixel_query("raster_min", "min(z) as v", lambda: {"v": R.aggregate("min", F.col("z"))})
_pixel_query("raster_sum", "round(sum(i), 6) + 0e0 as v", lambda: {"v": r6(R.aggregate("sum", F.col("i")))})
_pixel_query("raster_mean", "round(avg(i), 6) + 0e0 as v", lambda: {"v": r6(R.aggregate("mean", F.col("i")))})
_pixel_query("raster_argmin_label", "arg_min(label, (z, point_id)) as label", lambda: {"label": R.aggregate("argmin", F.col("label"), F.col("z"))})
_pixel_query("raster_argmax_label", "arg_min(label, (-z, point_id)) as label", lambda: {"label": R.aggregate("argmax", F.col("label"), F.col("z"))})
_pixel_query("nearest_label", "arg_min(label, (sqrt(x*x+y*y+z*z), point_id)) as label", lambda: {"label": R.aggregate("argmin", F.col("label"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))})

FILL_SQL = "gr as (select scan_id, r.row, c.col from box, unnest(range(0, height)) r(row), unnest(range(0, width)) c(col)), occ as (select scan_id, row, col, max(z) as zmax, count(*) as n from px group by 1,2,3), full_ as (select gr.scan_id, gr.row, gr.col, coalesce(zmax, 0e0) as zmax, coalesce(n, 0) as n from gr left join occ using (scan_id, row, col))"


def filled(spark, d):
    px = pixels(spark, d)
    return R.dense(R.rasterize(px, zmax=F.max("z"), n=F.count(F.lit(1))), P.bounding_box(points(spark, d), 0.5, 0.5), zmax=0.0, n=0)


@register("raster_dense_fill", _pts(pixels_sql() + ", " + FILL_SQL + " select scan_id, row, col, zmax, n from full_"))
def raster_dense_fill(spark, d):
    return filled(spark, d)


IMAGES_SQL = "lv as (select *, floor(greatest(z - -1.7e0, 0e0)*10)::bigint + 1 as level from px), im as (select scan_id, row, col, coalesce(min(level) filter (z >= -1.7e0), 1) as im_min, max(level) as im_max, least(count(*), 255) as im_acc, arg_min(label, (-level, point_id)) as im_class from lv group by 1,2,3)"


def images(spark, d):
    return R.height_images(pixels(spark, d), -1.7, 10.0)


@register("project_img", _pts(pixels_sql() + ", " + IMAGES_SQL + " select * from im"))
def project_img(spark, d):
    return images(spark, d)


@register("range_image", _pts(spherical_sql() + "select scan_id, row, col, max(sqrt(x*x+y*y+z*z)) as rho, min(z) as z, round(avg(i), 6) + 0e0 as i from sp where lidx >= 0 group by 1,2,3"))
def range_image(spark, d):
    rows = spherical(spark, d)
    rho = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return R.rasterize(rows, rho=F.max(rho), z=F.min("z"), i=r6(F.avg("i")))


@register("image_standardize", _pts(pixels_sql() + ", im as (select scan_id, row, col, max(z) as v from px group by 1,2,3) select scan_id, row, col, round((v - avg(v) over (partition by scan_id)) / stddev_pop(v) over (partition by scan_id), 6) + 0e0 as v from im"))
def image_standardize(spark, d):
    out = R.standardize(R.rasterize(pixels(spark, d), v=F.max("z")), ["v"])
    return out.withColumn("v", r6("v"))


@register("back_projection", _pts(pixels_sql() + ", im as (select scan_id, row, col, max(label) - 40 as v from px group by 1,2,3) select scan_id, point_id, case when v > 0 then v else 0 end as pred from px left join im using (scan_id, row, col)"))
def back_projection(spark, d):
    px = pixels(spark, d)
    return R.back_project(px, R.rasterize(px, v=F.max("label") - 40), "v", "pred").select("scan_id", "point_id", "pred")


GROUND_SQL = "gi as (select *, im_max <= 3 as is_ground from im), gp as (select p.scan_id, p.point_id, is_ground and floor(greatest(z - -1.7e0, 0e0)*10)::bigint + 1 - im_min <= 0.2e0*10 as ground from px p join gi using (scan_id, row, col))"


@register("back_projection_ground", _pts(pixels_sql() + ", " + IMAGES_SQL + ", " + GROUND_SQL + " select scan_id, point_id, ground from gp"))
def back_projection_ground(spark, d):
    im = images(spark, d).withColumn("is_ground", F.col("im_max") <= 3)
    return R.back_project_ground(pixels(spark, d), im, -1.7, 10.0, 0.2).select("scan_id", "point_id", "ground")


# ---- regions and morphology ----------------------------------------------------------------------


@register("accumarray", _pts("select label as idx, sum(point_id % 5)::bigint as v, (0 - sum(point_id % 5))::bigint as minus, bool_and(point_id % 5 > 0) as every from points group by 1"))
def accumarray(spark, d):
    rows = points(spark, d).select(F.col("label").alias("idx"), (F.col("point_id") % 5).alias("v"))
    one = R.accumulate(rows, "idx", "v", "plus")
    two = R.accumulate(rows, "idx", "v", "minus").withColumnRenamed("v", "minus")
    return one.join(two, "idx").join(R.accumulate(rows, "idx", "v", "and").withColumnRenamed("v", "every"), "idx")


@register("label_image", _pts(pixels_sql() + ", im as (select scan_id, row, col, max(floor((z+2)*100000))::bigint as v, max(label) as region from px group by 1,2,3) select scan_id, row, col, avg(v) over (partition by scan_id, region) as v_mean from im"))
def label_image(spark, d):
    # Whole levels: their sums are exact, whatever the order.
    im = R.rasterize(pixels(spark, d), v=F.max(F.floor((F.col("z") + 2) * 100000)), region=F.max("label"))
    return R.region_mean(im, "region", "v").select("scan_id", "row", "col", "v_mean")


def _measure(name: str, sql: str):
    key = "blob_measure" if name == "mean" else f"blob_measure_{name.lower()}"

    @register(key, _pts(pixels_sql() + f", im as (select scan_id, row, col, max(floor((z+2)*10))::bigint as v, max(label) as region from px group by 1,2,3), ms as (select scan_id, region, ({sql})::double as measure from im group by 1,2) select scan_id, row, col, measure from im join ms using (scan_id, region)"))
    def run(spark, d):
        im = R.rasterize(pixels(spark, d), v=F.max(F.floor((F.col("z") + 2) * 10)), region=F.max("label"))
        return R.region_measure(im, "region", "v", name).select("scan_id", "row", "col", "measure")


for _name, _sql in {"mean": "floor(avg(v))", "max": "max(v)", "min": "min(v)", "median": "quantile_cont(v, 0.5)", "nb": "count(*) filter (v <> 0)", "nbLab": "count(distinct v)"}.items():
    _measure(_name, _sql)


@register("blob_measure_mode", _pts(pixels_sql() + ", im as (select scan_id, row, col, max(floor((z+2)*10))::bigint as v, max(label) as region from px group by 1,2,3), ct as (select scan_id, region, v, count(*) as n from im group by 1,2,3), ms as (select scan_id, region, arg_min(v, (-n, v))::double as measure from ct group by 1,2) select scan_id, row, col, measure from im join ms using (scan_id, region)"))
def blob_measure_mode(spark, d):
    im = R.rasterize(pixels(spark, d), v=F.max(F.floor((F.col("z") + 2) * 10)), region=F.max("label"))
    return R.region_measure(im, "region", "v", "mode").select("scan_id", "row", "col", "measure")


@register("region_boxes", _pts(pixels_sql() + ", im as (select scan_id, row, col, max(label) as region from px group by 1,2,3) select scan_id, region, greatest(min(row)-12, 0) as row0, max(row)+12 as row1, greatest(min(col)-12, 0) as col0, max(col)+12 as col1, round(avg(row), 6) + 0e0 as row_mean, round(avg(col), 6) + 0e0 as col_mean from im group by 1,2"))
def region_boxes(spark, d):
    out = R.bounding_boxes(R.rasterize(pixels(spark, d), region=F.max("label")), "region")
    return out.withColumns({"row_mean": r6("row_mean"), "col_mean": r6("col_mean")})


def _near(value: str, source: str, f: str, out: str) -> str:
    return f"{out} as (select a.scan_id, a.row, a.col, {f}(b.{value}) as {value} from {source} a join {source} b on a.scan_id = b.scan_id and b.row between a.row - 1 and a.row + 1 and b.col between a.col - 1 and a.col + 1 group by 1,2,3)"


def _morph(name: str, op, *steps: str):
    ctes, source = [], "full_"
    for k, f in enumerate(steps):
        ctes.append(_near("zmax", source, f, f"m{k}"))
        source = f"m{k}"

    @register(name, _pts(pixels_sql() + ", " + FILL_SQL + ", " + ", ".join(ctes) + f" select scan_id, row, col, zmax from {source}"))
    def run(spark, d):
        return op(filled(spark, d), "zmax").select("scan_id", "row", "col", "zmax")


_morph("dilate", R.dilate, "max")
_morph("erode", R.erode, "min")
_morph("open", R.opened, "min", "max")
_morph("close", R.closed, "max", "min")


@register("hole_fill", _pts(pixels_sql() + ", " + FILL_SQL + ", " + _near("zmax", "full_", "max", "m0") + ", " + _near("zmax", "m0", "min", "m1") + " select scan_id, row, col, case when f.zmax = 0 then m1.zmax else f.zmax end as zmax from full_ f join m1 using (scan_id, row, col)"))
def hole_fill(spark, d):
    return R.fill_holes(filled(spark, d), "zmax").select("scan_id", "row", "col", "zmax")


@register("stick_images", _pts(pixels_sql() + ", im as (select scan_id, row, col, max(z) as v from px group by 1,2,3), mv as (select scan_id, row, col + 30 as col, v + 1 as v from im) select scan_id, row, col, v from im anti join mv using (scan_id, row, col) union all select scan_id, row, col, v from mv"))
def stick_images(spark, d):
    im = R.rasterize(pixels(spark, d), v=F.max("z"))
    return R.stick(im, im.withColumn("v", F.col("v") + 1), 40, 40, 10)


@register("misclassified_pixels", _pts(pixels_sql() + ", im as (select scan_id, row, col, max(label) as cls, min(z) < -1.55e0 as pred from px group by 1,2,3) select scan_id, row, col, case when cls in (10, 50) then case when pred then 128 else cls end else 0 end as mark from im"))
def misclassified_pixels(spark, d):
    im = R.rasterize(pixels(spark, d), cls=F.max("label"), pred=F.min("z") < -1.55)
    mark = F.when(F.col("cls").isin(10, 50), F.when(F.col("pred"), 128).otherwise(F.col("cls"))).otherwise(0)
    return im.select("scan_id", "row", "col", mark.alias("mark"))


NORMALS_SQL = f"""im as (select scan_id, row, col, max(sqrt(x*x+y*y+z*z)) as rho from sp where lidx >= 0 group by 1,2,3),
sc as (select distinct scan_id from points),
de as (select sc.scan_id, r.row, c.col, coalesce(rho, 0e0) as r from sc cross join range(0, 16) r(row) cross join range(0, 64) c(col) left join im on im.scan_id = sc.scan_id and im.row = r.row and im.col = c.col),
df as (select a.*, case when a.row = 0 then a.r - dn.r when a.row = 15 then a.r - up.r else (dn.r - up.r)/2 end as rp, (ri.r - le.r)/2 as ry
  from de a left join de dn on dn.scan_id = a.scan_id and dn.col = a.col and dn.row = a.row + 1
  left join de up on up.scan_id = a.scan_id and up.col = a.col and up.row = a.row - 1
  join de ri on ri.scan_id = a.scan_id and ri.row = a.row and ri.col = (a.col + 1) % 64
  join de le on le.scan_id = a.scan_id and le.row = a.row and le.col = (a.col + 63) % 64),
g as (select *, 1.2e0 + row*(0.7e0/15) as ph, col*(2e0*{PI}/63) as th, 0.7e0/15 as dp, 2e0*{PI}/63 as dy from df),
v as (select *, rp*sin(ph)*cos(th) + r*dp*cos(ph)*cos(th) as p0, rp*sin(ph)*sin(th) + r*dp*cos(ph)*sin(th) as p1, rp*cos(ph) - r*dp*sin(ph) as p2,
  ry*sin(ph)*cos(th) - r*dy*sin(ph)*sin(th) as t0, ry*sin(ph)*sin(th) + r*dy*sin(ph)*cos(th) as t1, ry*cos(ph) as t2 from g),
n as (select *, p1*t2-p2*t1 as nx, p2*t0-p0*t2 as ny, p0*t1-p1*t0 as nz from v),
o as (select *, sqrt(nx*nx+ny*ny+nz*nz) as len from n)
select scan_id, row, col, {{}} from o"""
_n = ", ".join(f"case when r = 0 or len = 0 then 0e0 else round({c}/len, 4) + 0e0 end as {c}" for c in ("nx", "ny", "nz"))


@register("spherical_normals", _pts(spherical_sql() + ", " + NORMALS_SQL.format(_n)))
def spherical_normals(spark, d):
    rows = spherical(spark, d)
    rho = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    sizes = points(spark, d).select("scan_id").distinct().select("scan_id", F.lit(16).cast("long").alias("height"), F.lit(64).cast("long").alias("width"))
    image = R.dense(R.rasterize(rows, rho=F.max(rho)), sizes, rho=0.0)
    out = R.spherical_normals(image, "rho", 16, 64, pitch=(1.2, 1.9))
    return out.select("scan_id", "row", "col", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


def flagship(spark, d):
    """Points in front of the scanner, projected to a raster with collision aggregates."""
    kept = P.filter_points(points(spark, d), fwd_range=(-35.0, 35.0), height_range=(-2.0, 2.0))
    return R.rasterize(
        P.linear_pixels(kept, 0.5, 0.5), z_min=F.min("z"), z_max=F.max("z"), i_sum=r6(F.sum("i")), label=R.aggregate("argmax", F.col("label"), F.col("z"))
    )


QUERIES["flagship_raster"] = flagship
ORACLES["flagship_raster"] = _pts(
    pixels_sql().replace("from points group by 1", "from kept group by 1").replace("from points p join", "from kept p join").replace("box as (", "kept as (select * from points where x > -35e0 and x < 35e0 and z > -2e0 and z < 2e0), box as (", 1)
    + " select scan_id, row, col, min(z) as z_min, max(z) as z_max, round(sum(i), 6) + 0e0 as i_sum, arg_min(label, (-z, point_id)) as label from px group by 1,2,3"
)
