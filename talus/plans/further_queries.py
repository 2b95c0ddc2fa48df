"""Queries on image shifts, windows and zones, neighbour votes, max-plus layers, combined losses and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import hyperbolic as H
from talus.operators import detection as D
from talus.operators import gnn as N
from talus.operators import graph as G
from talus.operators import hierarchy as T
from talus.operators import metrics as M
from talus.operators import points as P
from talus.operators import raster as R
from talus.plans.fixtures import disc, points, r6
from talus.plans.graph_queries import IMG, knn_sql
from talus.plans.model_queries import HEAP, LEAVES, U, _met, _vec, heap
from talus.plans.point_queries import FILL_SQL, IMAGES_SQL, _pts, filled, images, pixels, pixels_sql

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- images --------------------------------------------------------------------------------------

FULL = pixels_sql() + ", " + FILL_SQL


@register("first_difference", _pts("select scan_id, point_id, x - lag(x) over (partition by scan_id order by point_id) as dx from points"))
def first_difference(spark, d):
    return points(spark, d).select("scan_id", "point_id", P.first_difference(F.col("x"), "scan_id", "point_id").alias("dx"))


@register(
    "image_shift",
    _pts(
        FULL
        + """ select scan_id, row, col,
  lag(zmax, 2, 0e0) over (partition by scan_id, col order by row) as down,
  lead(zmax, 3, 0e0) over (partition by scan_id, row order by col) as left_
from full_"""
    ),
)
def image_shift(spark, d):
    im = filled(spark, d).select("scan_id", "row", "col", F.col("zmax").alias("down"), F.col("zmax").alias("left_"))
    return R.shifted(R.shifted(im, "down", 2, fill=0.0), "left_", -3, "col", 0.0)


@register("image_shift_torus", _pts(FULL + " select scan_id, (row + height - 2) % height as row, (col + 3) % width as col, zmax from full_ join box using (scan_id)"))
def image_shift_torus(spark, d):
    sizes = P.bounding_box(points(spark, d), 0.5, 0.5).select("scan_id", "height", "width")
    im = filled(spark, d).select("scan_id", "row", "col", "zmax").join(sizes, "scan_id")
    moved = R.shifted_on_torus(R.shifted_on_torus(im, 2, F.col("height")), -3, F.col("width"), "col")
    return moved.select("scan_id", "row", "col", "zmax")


@register(
    "opening_rectangle",
    _pts(
        FULL
        + """, lo as (
  select a.scan_id, a.row, a.col, min(b.n) as n from full_ a
  join full_ b on b.scan_id = a.scan_id and b.row between a.row and a.row + 1 and b.col between a.col and a.col + 2 group by all
)
select a.scan_id, a.row, a.col, max(b.n) as n from lo a
join lo b on b.scan_id = a.scan_id and b.row between a.row - 1 and a.row and b.col between a.col - 2 and a.col group by all"""
    ),
)
def opening_rectangle(spark, d):
    return R.opened_rectangle(filled(spark, d).select("scan_id", "row", "col", "n"), "n", 2, 3)


@register("image_window_edges", _pts(FULL + ", " + IMG.format(beside="a.col + 1") + " select * from ig where row >= 5 and row < 12 and row2 < 12 and col >= 3 and col < 20 and col2 < 20"))
def image_window_edges(spark, d):
    return G.window_subgraph(G.image_graph(filled(spark, d), ["zmax", "n"]), (5, 12), (3, 20))


@register("image_graph_metric", _pts(FULL + ", " + IMG.format(beside="a.col + 1") + """
select ig.scan_id, ig.row, ig.col, ig.row2, ig.col2, a.n * b.n + abs(a.zmax - b.zmax) as w
from ig join full_ a using (scan_id, row, col) join full_ b on b.scan_id = ig.scan_id and b.row = ig.row2 and b.col = ig.col2
where a.n > 0 and b.n > 0"""))
def image_graph_metric(spark, d):
    im = filled(spark, d).withColumn("held", F.col("n") > 0)
    return G.image_graph(im, ["n", "zmax"], metric=lambda a, b: a[0] * b[0] + F.abs(a[1] - b[1]), mask="held")


@register("pixel_numbers", _pts(pixels_sql() + " select scan_id, point_id, (row - 1) * width + (col - 2) as c_order, (col - 2) * height + (row - 1) as f_order from px"))
def pixel_numbers(spark, d):
    px = pixels(spark, d)
    number = lambda order: G.pixel_number(F.col("row"), F.col("col"), F.col("height"), F.col("width"), order, 1, 2)
    return px.select("scan_id", "point_id", number("C").alias("c_order"), number("F").alias("f_order"))


# Zones that agree in occupancy and in the stripe of four columns.
STRIP = FULL + """, st as (select scan_id, row, col, (n > 0)::int as held, (col // 4) % 2 as stripe from full_),
nb as (
  select a.scan_id, a.row * 1048576 + a.col as s, b.row * 1048576 + b.col as t from st a
  join st b on b.scan_id = a.scan_id and a.held = b.held and a.stripe = b.stripe and abs(a.row - b.row) + abs(a.col - b.col) = 1
),
rz as (select scan_id, row * 1048576 + col as node_id, row * 1048576 + col as seen from st union select rz.scan_id, rz.node_id, nb.t from rz join nb on nb.scan_id = rz.scan_id and nb.s = rz.seen)"""


@register("two_partition_zones", _pts(STRIP + " select scan_id, node_id, min(seen) as cc from rz group by all").replace("with ", "with recursive ", 1))
def two_partition_zones(spark, d):
    strip = filled(spark, d).withColumn("held", (F.col("n") > 0).cast("int")).withColumn("stripe", F.floor(F.col("col") / 4) % 2)
    return G.two_partition_zones(strip, "held", "stripe", 1 << 20)


# ---- subsets and graphs --------------------------------------------------------------------------


@register("subset_map", _pts("select scan_id, point_id, row_number() over (partition by scan_id order by point_id) - 1 as place from points where label = 10"))
def subset_map(spark, d):
    return P.subset(points(spark, d), F.col("label") == 10, "scan_id", "point_id").select("scan_id", "point_id", "place")


@register(
    "subgraph_renumbered",
    _pts(
        knn_sql(4)
        + """, nm as (select scan_id, point_id, row_number() over (partition by scan_id order by point_id) - 1 as number from points where label in (40, 72))
select k.scan_id, a.number as src, b.number as dst, d as w from kn k
join nm a on a.scan_id = k.scan_id and a.point_id = k.src join nm b on b.scan_id = k.scan_id and b.point_id = k.dst"""
    ),
)
def subgraph_renumbered(spark, d):
    p = points(spark, d)
    edges = G.knn(p, 4).select("scan_id", "src", "dst", F.col("d").alias("w"))
    return G.renumbered(edges, p.where("label in (40, 72)").select("scan_id", F.col("point_id").alias("node_id")))[0]


@register("nth_smallest", _pts("select scan_id, z from (select scan_id, z, row_number() over (partition by scan_id order by z, point_id) as r from points) where r = 25"))
def nth_smallest(spark, d):
    return P.nth_smallest(points(spark, d), "z", 25, "scan_id", "point_id")


@register("label_grid", _pts("ls as (select distinct label from points) select a.label as a, b.label as b from ls a, ls b"))
def label_grid(spark, d):
    """All pairs of the labels that occur: each side has at most one row a label."""
    labels = points(spark, d).groupBy().agg(F.collect_set("label").alias("a"))
    return labels.select(F.explode("a").alias("a"), F.col("a").alias("all")).select("a", F.explode("all").alias("b"))


# ---- votes, scores, reports ----------------------------------------------------------------------

VOTE = pixels_sql() + """, al as (select *, count(*) over (partition by scan_id, lidx) as n from px),
tr as (select * from al where n = 1), te as (select * from al where n > 1),
nn as (
  select * from (
    select te.scan_id, te.point_id, tr.label, row_number() over (
      partition by te.scan_id, te.point_id
      order by sqrt((te.x-tr.x)*(te.x-tr.x)+(te.y-tr.y)*(te.y-tr.y)+(te.z-tr.z)*(te.z-tr.z)), tr.point_id
    ) as r from te join tr using (scan_id)
  ) where r <= 3
),
vt as (select scan_id, point_id, label, count(*) as n from nn group by all)"""


@register("label_vote", _pts(VOTE + " select scan_id, point_id, arg_min(label, (-n, label))::double as score from vt group by all"))
def label_vote(spark, d):
    return D.transfer_labels(pixels(spark, d), "label", how="vote")


@register(
    "raster_confusion",
    _pts(
        pixels_sql()
        + ", "
        + IMAGES_SQL
        + """, jd as (select im_class as truth, case when im_max <= 3 then 40 else 50 end as pred from im),
gg(label, grp) as (values (0,0),(10,1),(40,4),(50,5),(72,4)),
gr as (select distinct t.grp as truth, p.grp as pred from gg t, gg p),
ct as (select t.grp as truth, p.grp as pred, count(*) as n from jd join gg t on t.label = jd.truth join gg p on p.label = jd.pred group by all),
cm as (select truth, pred, coalesce(n, 0)::bigint as n from gr left join ct using (truth, pred))
select truth, pred, n, round(coalesce(100e0*n/nullif(sum(n) over (partition by truth),0),0), 2) + 0e0 as share from cm"""
    ),
)
def raster_confusion(spark, d):
    judged = images(spark, d).select(F.col("im_class").alias("truth"), F.when(F.col("im_max") <= 3, 40).otherwise(50).alias("pred"))
    groups = spark.createDataFrame([(0, 0), (10, 1), (40, 4), (50, 5), (72, 4)], "label int, grp int")
    return M.normalized(M.condense(M.confusion(judged, "truth", "pred", [0, 10, 40, 50, 72]), groups))


@register(
    "kl_discrete",
    _pts(
        """ct as (select scan_id, floor((z+2)*4)::bigint as bin, count(*) filter (label in (40, 72)) + 1e0 as p, count(*) filter (label not in (40, 72)) + 1e0 as q from points group by all),
sh as (select scan_id, p / sum(p) over (partition by scan_id) as p, q / sum(q) over (partition by scan_id) as q from ct)
select scan_id, round(sum(p*ln(p/q)), 6) + 0e0 as kl from sh group by all"""
    ),
)
def kl_discrete(spark, d):
    ground = F.col("label").isin(40, 72)
    bins = points(spark, d).groupBy("scan_id", F.floor((F.col("z") + 2) * 4).alias("bin")).agg((F.count_if(ground) + 1.0).alias("p"), (F.count_if(~ground) + 1.0).alias("q"))
    sums = bins.groupBy("scan_id").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    shares = bins.join(sums, "scan_id")
    return shares.groupBy("scan_id").agg(r6(H.kl_discrete(F.col("p") / F.col("sp"), F.col("q") / F.col("sq"))).alias("kl"))


# ---- max-plus layers -----------------------------------------------------------------------------

ENDS3 = knn_sql(3) + """, ee as (
  select k.scan_id, k.src, k.rank, s.z as sz, t.z as tz, s.i as si, t.i as ti from kn k
  join points s on s.scan_id = k.scan_id and s.point_id = k.src join points t on t.scan_id = k.scan_id and t.point_id = k.dst
)"""


@register(
    "layered_morphological_conv",
    _pts(
        ENDS3
        + """, hh as (
  select scan_id, src, rank, greatest(0.5e0*sz + -1e0*si + 2e0*(tz-sz) + 0.25e0*(ti-si), 0e0) as a, greatest(-0.5e0*sz + 0.75e0*si + -1e0*(tz-sz) + 1e0*(ti-si), 0e0) as b from ee
)
select scan_id, src as point_id,
  round(max(a - case rank when 1 then 0e0 when 2 then 0.5e0 else 1e0 end), 9) + 0e0 as h0,
  round(max(b - case rank when 1 then 0.25e0 when 2 then 0e0 else 0.125e0 end), 9) + 0e0 as h1
from hh group by all"""
    ),
)
def layered_morphological_conv(spark, d):
    p = points(spark, d)
    out = N.layered_morphological_conv(G.knn(p, 3), p, ["z", "i"], [[0.5, -1.0, 2.0, 0.25], [-0.5, 0.75, -1.0, 1.0]], [[-1.0, 0.25], [0.5, -2.0], [1.0, 0.125]])
    return out.select("scan_id", "point_id", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("h0", "h1")])


@register("max_plus", _pts("select scan_id, point_id, greatest(x - 0.5e0, y, z - 1e0) as h0, greatest(x, y - 2e0, z) as h1 from points"))
def max_plus(spark, d):
    h0, h1 = N.max_plus([F.col(c) for c in "xyz"], [[0.5, 0.0], [-3.0, 2.0], [1.0, -1.0]])
    return points(spark, d).select("scan_id", "point_id", h0.alias("h0"), h1.alias("h1"))


# ---- losses and linkages -------------------------------------------------------------------------

LOSSES = HEAP + ", " + LEAVES + f""", lu as (
  select lc.tree_id, lc.a, lc.b, lc.same, w, {U} as u, least(l.size, r.size) as area
  from lc join sz on sz.tree_id = lc.tree_id and sz.node_id = lc.lca
  left join sz l on l.tree_id = lc.tree_id and l.node_id = lc.lca*2 left join sz r on r.tree_id = lc.tree_id and r.node_id = lc.lca*2+1
),
l1 as (select tree_id, avg((u-w)*(u-w)) as closest, max(u/area) filter (area > 0) as cluster from lu group by all),
bi as (select tree_id, a, b, same, u from lu union all select tree_id, b, a, same, u from lu),
l3 as (select p.tree_id, avg(greatest(0e0, p.u - n.u + 0.1e0)) as triplet from lu p join bi n on n.tree_id = p.tree_id and n.a = p.a and not n.same where p.same group by all)
select tree_id, round(cluster + 0.5e0*triplet, 6) + 0e0 as cluster_and_triplet, round(closest + 0.5e0*cluster, 6) + 0e0 as closest_and_cluster,
  round(closest + 0.5e0*triplet, 6) + 0e0 as closest_and_triplet, round(closest + 0.5e0*triplet + 0.5e0*cluster, 6) + 0e0 as closest_cluster_and_triplet
from l1 join l3 using (tree_id)"""


@register("combined_losses", _vec(LOSSES))
def combined_losses(spark, d):
    met = _met(spark, d).withColumn("u", F.col("size").cast("double") / 28.0)
    sizes = heap(spark, d).select("tree_id", "node_id", F.col("size").alias("s"))
    for k, name in ((0, "l"), (1, "r")):
        met = met.withColumn("node_id", F.col("lca") * 2 + k).join(sizes.withColumnRenamed("s", name), ["tree_id", "node_id"], "left").drop("node_id")
    area = F.when((F.col("l") > 0) & (F.col("r") > 0), F.least("l", "r"))
    one = met.groupBy("tree_id").agg(T.closest_loss(F.col("u"), F.col("w")).alias("closest"), T.cluster_size_loss(F.col("u"), area).alias("cluster"))
    al = met.select("tree_id", "a", "b", "same", "u")
    back = al.select("tree_id", F.col("b").alias("a"), F.col("a").alias("b"), "same", "u")
    away = al.unionByName(back).where(~F.col("same")).select("tree_id", "a", F.col("u").alias("nu"))
    three = al.where("same").join(away, ["tree_id", "a"]).groupBy("tree_id").agg(T.triplet_loss(F.col("u"), F.col("nu"), 0.1).alias("triplet"))
    closest, cluster, triplet = (F.col(c) for c in ("closest", "cluster", "triplet"))
    mix = lambda first, *others: r6(T.combined_loss(first, *others, gamma=0.5))
    return one.join(three, "tree_id").select(
        "tree_id",
        mix(cluster, triplet).alias("cluster_and_triplet"),
        mix(closest, cluster).alias("closest_and_cluster"),
        mix(closest, triplet).alias("closest_and_triplet"),
        mix(closest, triplet, cluster).alias("closest_cluster_and_triplet"),
    )


ANGLES = """an as (
  select a.tree_id, a.id as a, b.id as b,
    acos(least(greatest((a.x*b.x + a.y*b.y) / (sqrt(a.x*a.x + a.y*a.y) * sqrt(b.x*b.x + b.y*b.y)), -1e0), 1e0)) as w
  from disc a join disc b on a.tree_id = b.tree_id and a.id < b.id
), sv as (select tree_id, a as s, b as t from an where w < 0.1e0 union all select tree_id, b, a from an where w < 0.1e0),
rc as (select tree_id, id as node, id as seen from disc union select rc.tree_id, rc.node, sv.t from rc join sv on sv.tree_id = rc.tree_id and sv.s = rc.seen)
select tree_id, node as id, min(seen) as cc from rc group by all"""


def angle_pairs(spark, d):
    rows = T.pairs(disc(spark, d), ["x", "y"])
    return rows.select("tree_id", "a", "b", T.angle([F.col("a_x"), F.col("a_y")], [F.col("b_x"), F.col("b_y")]).alias("w"))


@register("angle_linkage_cut", _vec(ANGLES))
def angle_linkage_cut(spark, d):
    """The linkage by angles, cut below 0.1: its merges up to there, as components."""
    e = angle_pairs(spark, d).where(F.col("w") < 0.1).select(F.col("tree_id").alias("scan_id"), F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    nodes = disc(spark, d).select(F.col("tree_id").alias("scan_id"), F.col("id").alias("node_id"))
    forest = G.spanning_forest(e)
    return G.connected_components(forest, nodes).select(F.col("scan_id").alias("tree_id"), F.col("node_id").alias("id"), "cc")


@register("angle_linkage")
def angle_linkage(spark, d):
    return T.single_linkage(angle_pairs(spark, d))
