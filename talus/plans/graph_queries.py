"""Queries on graphs, components and image graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators import raster as R
from talus.plans.fixtures import POINTS, SUPPLY, points, r6, supply
from talus.plans.point_queries import FILL_SQL, _pts, filled, pixels, pixels_sql, spherical, spherical_sql
from talus.storage import stored

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def knn_sql(k: int, source: str = "points", name: str = "kn") -> str:
    return f"{name} as (select * from (select a.scan_id, a.point_id as src, b.point_id as dst, {DIST} as d, row_number() over (partition by a.scan_id, a.point_id order by {DIST}, b.point_id) as rank from {source} a join {source} b on a.scan_id = b.scan_id and a.point_id <> b.point_id) where rank <= {k})"


def sym_sql(source: str, out: str) -> str:
    return f"{out} as (select scan_id, src, dst, max(w) as w from (select scan_id, src, dst, w from {source} union all select scan_id, dst, src, w from {source}) group by 1,2,3)"


@register("knn_graph", _pts(knn_sql(10) + " select scan_id, src, dst, round(d, 9) + 0e0 as d, rank from kn"))
def knn_graph(spark, d):
    return G.knn(points(spark, d), 10).withColumn("d", F.round("d", 9) + F.lit(0.0))


@register("knn_batch_loop", _pts("s as (select * from points) select * from (select a.scan_id, a.point_id as src, b.point_id as dst, row_number() over (partition by a.scan_id, a.point_id order by " + DIST + ", b.point_id) as rank from s a join s b on a.scan_id = b.scan_id) where rank <= 5"))
def knn_batch_loop(spark, d):
    return G.knn(points(spark, d), 5, loop=True).select("scan_id", "src", "dst", "rank")


@register("knn_graph_symmetric", _pts(knn_sql(10) + ", e as (select scan_id, src, dst, 1e0 as w from kn), " + sym_sql("e", "s") + " select * from s"))
def knn_graph_symmetric(spark, d):
    return G.knn_graph(points(spark, d), 10)


SPH_EDGES = f"""dn as (select a.scan_id, a.point_id as src, b.point_id as dst, {DIST} as w from sp a join sp b on a.scan_id = b.scan_id and b.row = a.row + 1 and b.col = a.col and a.row >= 0 and b.row >= 0 where abs(a.z-b.z) < 2e0 and {DIST} < 15e0),
rt0 as (select a.scan_id, a.point_id as src, b.point_id as dst, {DIST} as w, s.s as st from sp a cross join range(1, 6) s(s) join sp b on a.scan_id = b.scan_id and b.row = a.row and b.col = (a.col + s.s) % 64 and a.row >= 0 where abs(a.z-b.z) < 2e0 and {DIST} < 10e0),
rt as (select * exclude (r, st) from (select *, rank() over (partition by scan_id, src order by st) as r from rt0) where r = 1),
sm as (select a.scan_id, a.point_id as src, b.point_id as dst, {DIST} as w from sp a join sp b on a.scan_id = b.scan_id and b.row = a.row and b.col = a.col and a.row >= 0 and a.point_id < b.point_id where abs(a.z-b.z) < 2e0 and {DIST} < 8e0),
al as (select * from dn union all select * from rt union all select * from sm), """ + sym_sql("al", "sy")


def sphere_edges(spark, d):
    return G.spherical_edges(spherical(spark, d), 64, far=15.0, near=10.0, same=8.0, dz=2.0)


@register("spherical_edges", _pts(spherical_sql() + ", " + SPH_EDGES + " select scan_id, src, dst, round(w, 9) + 0e0 as w from sy"))
def spherical_edges(spark, d):
    return sphere_edges(spark, d).withColumn("w", F.round("w", 9) + F.lit(0.0))


@register("merge_graphs", f"with {SUPPLY}, u as (select scan_id, src, dst, w from supply union all select scan_id, src, dst, 3e0 - 2*w from supply where src % 2 = 0) select scan_id, src, dst, max(greatest(w, 0e0)) + min(least(w, 0e0)) as w from u group by 1,2,3")
def merge_graphs(spark, d):
    g = supply(spark, d)
    return G.merge_graphs(g, g.where(F.col("src") % 2 == 0).withColumn("w", F.lit(3.0) - 2 * F.col("w")))


@register("cloud_3d_graph", _pts(spherical_sql() + ", " + SPH_EDGES + ", " + knn_sql(5) + ", e as (select scan_id, src, dst, d as w from kn), " + sym_sql("e", "ks") + ", u as (select * from sy union all select * from ks) select scan_id, src, dst, round(max(greatest(w, 0e0)) + min(least(w, 0e0)), 9) + 0e0 as w from u group by 1,2,3"))
def cloud_3d_graph(spark, d):
    both = G.merge_graphs(sphere_edges(spark, d), G.knn_graph(points(spark, d), 5, weighted=True))
    return both.withColumn("w", F.round("w", 9) + F.lit(0.0))


ZN = "nn as (select scan_id, point_id, (z - min(z) over (partition by scan_id)) / (1e0/(1e0+exp(-32e0*(abs(i)-0.7e0)))) as r from points)"


def _znz(how: str, sql: str):
    @register(f"znz_weights_{how}" if how != "diff" else "znz_weights", _pts(knn_sql(5) + f", {ZN} select k.scan_id, k.src, k.dst, round({sql}, 4) + 0e0 as w from kn k join nn s on s.scan_id = k.scan_id and s.point_id = k.src join nn t on t.scan_id = k.scan_id and t.point_id = k.dst where s.r < 1e4 and t.r < 1e4"))
    def run(spark, d):
        p = points(spark, d)
        ratio_ok = p.withColumn("nz", F.col("i"))
        w = G.height_weights(G.knn(p, 5), p, ratio_ok, how)
        big = G.height_weights(G.knn(p, 5), p, ratio_ok, "max")
        return w.join(big.where(F.col("w") < 1e4).select("scan_id", "src", "dst"), ["scan_id", "src", "dst"]).withColumn("w", F.round("w", 4) + F.lit(0.0))


_znz("diff", "abs(s.r - t.r)")
_znz("max", "greatest(s.r, t.r)")
_znz("min", "least(s.r, t.r)")


@register("threshold_distance", f"with {SUPPLY} select * from supply where w < 3")
def threshold_distance(spark, d):
    return G.threshold_edges(supply(spark, d), 3.0)


@register("threshold_similarity", f"with {SUPPLY} select * from supply where w >= 3")
def threshold_similarity(spark, d):
    return G.threshold_edges(supply(spark, d), 3.0, "similarity")


@register("edge_length_filter", _pts(knn_sql(10) + " select scan_id, src, dst from kn where d < 2e0"))
def edge_length_filter(spark, d):
    return G.knn(points(spark, d), 10).where(F.col("d") < 2.0).select("scan_id", "src", "dst")


def two_sided(g):
    """Parts get even ids and suppliers odd ones: in larger tables both have numbers above a million."""
    return g.select("scan_id", F.shiftleft("src", 1).alias("src"), (F.shiftleft("dst", 1) + 1).alias("dst"), "w")


def two_sided_nodes(g):
    return two_sided(g).select("scan_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()


@register("subgraph", f"with {SUPPLY} select * from supply where src % 3 = 0 and dst % 2 = 0")
def subgraph(spark, d):
    g = supply(spark, d)
    number = F.shiftright("node_id", 1)
    keep = two_sided_nodes(g).where(F.when(F.col("node_id") % 2 == 0, number % 3 == 0).otherwise(number % 2 == 0))
    kept = G.subgraph(two_sided(g), keep)
    return kept.select("scan_id", F.shiftright("src", 1).alias("src"), F.shiftright("dst", 1).alias("dst"), "w")


@register("positive_degree_nodes", f"with {SUPPLY}, e as (select *, w - 1 as v from supply) select distinct scan_id, unnest([src, dst]) as node_id from e where v <> 0")
def positive_degree_nodes(spark, d):
    return G.positive_degree(supply(spark, d).withColumn("w", F.col("w") - 1))


@register("resize_graph", f"with {SUPPLY} select scan_id, src % 50 as src, dst % 7 as dst, sum(w) as w from supply group by 1,2,3")
def resize_graph(spark, d):
    g = supply(spark, d)
    number = F.shiftright("node_id", 1)
    cc = F.when(F.col("node_id") % 2 == 0, number % 50).otherwise(number % 7)
    return G.resize(two_sided(g), two_sided_nodes(g).withColumn("cc", cc))


@register("forest_level", f"with {SUPPLY} select scan_id, src, dst, sum(w) as w from (select scan_id, src, dst, w from supply union all select scan_id, src, dst, w*2 from supply where src % 4 <= 2) group by 1,2,3")
def forest_level(spark, d):
    g = supply(spark, d)
    return G.forest_level(g, g.withColumn("w", F.col("w") * 2).withColumn("level", F.col("src") % 4), 2)


@register("undirected_edges", _pts(knn_sql(5) + " select scan_id, least(src, dst) as src, greatest(src, dst) as dst, round(min(d), 9) + 0e0 as w from kn group by 1,2,3"))
def undirected_edges(spark, d):
    e = G.undirected(G.knn(points(spark, d), 5).withColumn("w", F.col("d")))
    return e.withColumn("w", F.round("w", 9) + F.lit(0.0))


CC = "rc as (with recursive r(scan_id, node_id, seen) as (select scan_id, point_id, point_id from points union select r.scan_id, r.node_id, e.dst from r join ce e on e.scan_id = r.scan_id and e.src = r.seen) select scan_id, node_id, min(seen) as cc from r group by 1,2)"
KCC = knn_sql(4) + ", e as (select scan_id, src, dst, d as w from kn where d < 1.6e0), " + sym_sql("e", "ce") + ", " + CC


def near_edges(spark, d):
    return G.knn(points(spark, d), 4).select("scan_id", "src", "dst", F.col("d").alias("w"))


def near_labels(spark, d):
    return G.quasi_flat_zones(near_edges(spark, d), 1.6, points(spark, d).select("scan_id", F.col("point_id").alias("node_id")))


@register("quasi_flat_zones", _pts(KCC + " select * from rc"))
def quasi_flat_zones(spark, d):
    return near_labels(spark, d)


@register("connected_components", _pts(KCC + " select distinct r.* from rc r join ce on r.scan_id = ce.scan_id and r.node_id = ce.src"))
def connected_components(spark, d):
    return G.connected_components(G.threshold_edges(near_edges(spark, d), 1.6))


@register("components_global", _pts(KCC + " select scan_id*1000000+node_id as node, scan_id*1000000+cc as component from rc where node_id in (select src from ce)"))
def components_global(spark, d):
    from talus.operators.components import star_components

    e = G.threshold_edges(near_edges(spark, d), 1.6).select((F.col("scan_id") * 1000000 + F.col("src")).alias("u"), (F.col("scan_id") * 1000000 + F.col("dst")).alias("v"))
    return star_components(e, stored)


@register("component_ranking", _pts(KCC + ", s as (select scan_id, cc, count(*) as n from rc group by 1,2) select *, row_number() over (partition by scan_id order by n desc, cc) as rank from s"))
def component_ranking(spark, d):
    return G.component_sizes(near_labels(spark, d))


@register("component_stats", _pts(KCC + " select r.scan_id, cc, count(*) as n, max(z) as z_max, min(z) as z_min, round(avg(z), 12) + 0e0 as z_mean, round(stddev_pop(z), 5) + 0e0 as z_std from rc r join points p on p.scan_id = r.scan_id and p.point_id = r.node_id group by 1,2"))
def component_stats(spark, d):
    rows = near_labels(spark, d).join(points(spark, d).select("scan_id", F.col("point_id").alias("node_id"), "z"), ["scan_id", "node_id"])
    return rows.groupBy("scan_id", "cc").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("z_max"), F.min("z").alias("z_min"), (F.round(F.avg("z"), 12) + F.lit(0.0)).alias("z_mean"), (F.round(F.stddev_pop("z"), 5) + F.lit(0.0)).alias("z_std"))


@register("select_cc", _pts(KCC + ", s as (select r.scan_id, cc, count(*) as n, avg(z) as zm from rc r join points p on p.scan_id = r.scan_id and p.point_id = r.node_id group by 1,2 having count(*) > 3), t as (select *, row_number() over (partition by scan_id order by round(zm, 9), cc) as rank from s) select scan_id, cc, n, round(zm, 6) + 0e0 as z_mean, rank from t where rank <= 5"))
def select_cc(spark, d):
    out = G.lowest_components(near_labels(spark, d), points(spark, d), 3, 5)
    return out.withColumn("z_mean", r6("z_mean"))


@register("set_distance", _pts(f"select a.scan_id, min({DIST}) as d, arg_min(a.point_id, ({DIST}, a.point_id, b.point_id)) as src, arg_min(b.point_id, ({DIST}, a.point_id, b.point_id)) as dst from points a join points b on a.scan_id = b.scan_id and a.label = 10 and b.label = 50 group by 1"))
def set_distance(spark, d):
    p = points(spark, d).where(F.col("label").isin(10, 50)).select("scan_id", F.col("point_id").alias("node_id"), F.col("label").cast("long").alias("cc"), "x", "y", "z")
    return G.closest_components(p).where(F.col("cc") == 10).select("scan_id", "d", "src", "dst")


LAB = "lb as (select scan_id, point_id, label::bigint as cc, x, y, z from points where label <> 0)"
PAIRS = f"pr as (select a.scan_id, a.cc, b.cc as other, min({DIST}) as d, arg_min(a.point_id, ({DIST}, a.point_id, b.point_id)) as src, arg_min(b.point_id, ({DIST}, a.point_id, b.point_id)) as dst from lb a join lb b on a.scan_id = b.scan_id and a.cc <> b.cc group by 1,2,3), ln as (select * from (select *, row_number() over (partition by scan_id, cc order by d, other) as rank from pr) where rank <= 2)"


def labelled(spark, d):
    return points(spark, d).where(F.col("label") != 0).select("scan_id", F.col("point_id").alias("node_id"), F.col("label").cast("long").alias("cc"), "x", "y", "z")


@register("closest_components", _pts(LAB + ", " + PAIRS + " select scan_id, cc, other, src, dst, d, rank from ln"))
def closest_components(spark, d):
    return G.closest_components(labelled(spark, d), 2)


CONNECT = LAB + ", " + PAIRS + """, sz as (select scan_id, cc, count(*) as n from lb group by 1,2),
sa as (select * from (select l.scan_id, l.cc as la, l.other as lo, a.point_id, a.x, a.y, a.z, n, row_number() over (partition by l.scan_id, l.cc, l.other order by """ + DIST + """, a.point_id) as r
  from ln l join lb b on b.scan_id = l.scan_id and b.point_id = l.dst join lb a on a.scan_id = l.scan_id and a.cc = l.cc join sz on sz.scan_id = l.scan_id and sz.cc = l.cc) where r <= greatest(least(5, n-1), 1)),
sb as (select * from (select l.scan_id, l.cc as la, l.other as lo, b.point_id, b.x, b.y, b.z, n, row_number() over (partition by l.scan_id, l.cc, l.other order by """ + DIST + """, b.point_id) as r
  from ln l join lb a on a.scan_id = l.scan_id and a.point_id = l.src join lb b on b.scan_id = l.scan_id and b.cc = l.other join sz on sz.scan_id = l.scan_id and sz.cc = l.other) where r <= greatest(least(5, n-1), 1)),
ed as (select a.scan_id, a.point_id as src, b.point_id as dst, """ + DIST + """ as w from sa a join sb b on a.scan_id = b.scan_id and a.la = b.la and a.lo = b.lo where """ + DIST + """ < 12e0), """ + sym_sql("ed", "sy")


@register("connect_components", _pts(CONNECT + " select scan_id, src, dst, round(w, 9) + 0e0 as w from sy"))
def connect_components(spark, d):
    return G.connect_components(labelled(spark, d), k=2, around=5).withColumn("w", F.round("w", 9) + F.lit(0.0))


@register("mst_total_weight")
def mst_total_weight(spark, d):
    t = G.spanning_forest(near_edges(spark, d))
    return t.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_edges"), r6(F.sum("w")).alias("weight"))


@register("mst_additive")
def mst_additive(spark, d):
    t = G.spanning_forest(near_edges(spark, d), additive=True)
    return t.select("scan_id", "src", "dst", "step", "n_src", "n_dst", r6("w").alias("w"))


# ---- image graphs --------------------------------------------------------------------------------

IMG = "ig as (select a.scan_id, a.row, a.col, b.row as row2, b.col as col2, greatest(abs(a.zmax-b.zmax), abs(a.n-b.n)) + 1e-10 as w from full_ a join full_ b on a.scan_id = b.scan_id and ((b.row = a.row and b.col = {beside}) or (b.row = a.row + 1 and b.col = a.col)))"


@register("image_graph", _pts(pixels_sql() + ", " + FILL_SQL + ", " + IMG.format(beside="a.col + 1") + " select * from ig"))
def image_graph(spark, d):
    return G.image_graph(filled(spark, d), ["zmax", "n"])


@register("image_graph_wrap", _pts(pixels_sql() + ", " + FILL_SQL + ", " + IMG.format(beside="(a.col + 1) % 40") + " select * from ig"))
def image_graph_wrap(spark, d):
    return G.image_graph(filled(spark, d), ["zmax", "n"], 40)


@register("pixel_nodes", _pts(pixels_sql() + "select scan_id, point_id, row*1000+col as node, (row*1000+col)//1000 as row, (row*1000+col)%1000 as col from px"))
def pixel_nodes(spark, d):
    node = F.col("row") * 1000 + F.col("col")
    return pixels(spark, d).select("scan_id", "point_id", node.alias("node"), F.floor(node / 1000).alias("row"), (node % 1000).alias("col"))


def _zones_sql(edge: str, where: str = "true") -> str:
    return f"zs as (select *, row*40+col as node from full_ where {where}), ze as (select a.scan_id, a.node as src, b.node as dst from zs a join zs b on a.scan_id = b.scan_id and (abs(a.row-b.row) + abs(a.col-b.col)) = 1 where {edge}), zr as (with recursive r(scan_id, node_id, seen) as (select scan_id, node, node from zs union select r.scan_id, r.node_id, e.dst from r join ze e on e.scan_id = r.scan_id and e.src = r.seen) select scan_id, node_id, min(seen) as cc from r group by 1,2)"


@register("lambda_flat_zones", _pts(pixels_sql() + ", " + FILL_SQL + ", " + _zones_sql("abs(a.zmax - b.zmax) + 1e-10 <= 0.02e0 + 1e-10", "n > 0") + " select * from zr"))
def lambda_flat_zones(spark, d):
    return G.flat_zones(filled(spark, d).where(F.col("n") > 0), "zmax", 0.02, 40)


@register("geodesic_fill", _pts(pixels_sql() + ", " + FILL_SQL + ", " + _zones_sql("true", "n = 0") + " select r.scan_id, r.node_id from zr r join (select scan_id, min(cc) as cc from (select scan_id, cc, count(*) as k, max(count(*)) over (partition by scan_id) as m from zr group by 1,2) where k = m group by 1) s on s.scan_id = r.scan_id and s.cc = r.cc"))
def geodesic_fill(spark, d):
    empty = filled(spark, d).where(F.col("n") == 0)
    zones = G.pixel_components(G.image_graph(empty, ["n"]), empty, 40)
    largest = G.component_sizes(zones).where(F.col("rank") == 1).select("scan_id", "cc")
    return zones.join(largest, ["scan_id", "cc"]).select("scan_id", "node_id")


@register("knn_label_transfer", _pts(pixels_sql(1.0) + ", c as (select *, count(*) over (partition by scan_id, lidx) as k from px), kk as (select * from (select a.scan_id, a.point_id, b.label as lab, row_number() over (partition by a.scan_id, a.point_id order by " + DIST + ", b.point_id) as r from c a join c b on a.scan_id = b.scan_id and a.k > 1 and b.k = 1) where r <= 3) select scan_id, point_id, round(avg((lab in (40,44,48,49,60,72))::int), 6) + 0e0 as score from kk group by 1,2"))
def knn_label_transfer(spark, d):
    from talus.operators.detection import transfer_labels
    from talus.operators.points import is_ground

    rows = pixels(spark, d, 1.0).withColumn("value", is_ground(F.col("label")).cast("double"))
    return transfer_labels(rows, "value", 3).select("scan_id", "point_id", r6("score").alias("score"))
