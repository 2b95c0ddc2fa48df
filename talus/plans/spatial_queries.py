"""Queries on clouds and graphs that no task need hold whole, and on zones and elements of other neighbourhoods, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import detection as D
from talus.operators import graph as G
from talus.operators import hierarchy as T
from talus.operators import kernels
from talus.operators import raster as R
from talus.operators import trees
from talus.operators.cells import cloud_parts, knn_cells
from talus.operators.components import global_spanning_forest
from talus.plans.fixtures import points, r6, supply
from talus.plans.graph_queries import DIST, knn_sql, near_edges
from talus.plans.point_queries import FILL_SQL, _pts, filled, pixels_sql
from talus.operators.zones import zone_measure
from talus.storage import stored

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- neighbours ----------------------------------------------------------------------------------


@register("knn_cells", _pts(knn_sql(10) + " select scan_id, src, dst, round(d, 9) + 0e0 as d, rank from kn"))
def knn_cells_of_scans(spark, d):
    """Small cells, so that scans of the fixture take many."""
    return knn_cells(points(spark, d), 10, stored, fill=64).withColumn("d", F.round("d", 9) + F.lit(0.0))


@register(
    "knn_cells_cloud",
    _pts(
        f"""pairs as (
  select a.point_id as src, b.point_id as dst, {DIST} as d from points a
  join points b on b.x between a.x - 14 and a.x + 14 and b.y between a.y - 14 and a.y + 14 and a.point_id <> b.point_id
), ranked as (
  select *, row_number() over (partition by src order by d, dst) as rank from pairs
)
select 0::bigint as scan_id, src, dst, round(d, 9) + 0e0 as d, rank from ranked where rank <= 5"""
    ),
)
def knn_cells_cloud(spark, d):
    """All scans as one cloud; in the fixture five neighbours lie within 14 m, which the SQL relies on."""
    return knn_cells(points(spark, d), 5, stored, group=None).withColumn("d", F.round("d", 9) + F.lit(0.0))


@register(
    "knn_cosine",
    _pts(
        """lengths as (select *, sqrt(x*x + y*y + z*z) as length from points), pairs as (
  select a.scan_id, a.point_id as src, b.point_id as dst, 1e0 - (a.x*b.x + a.y*b.y + a.z*b.z) / (a.length * b.length) as d
  from lengths a join lengths b on a.scan_id = b.scan_id and a.point_id <> b.point_id
), ranked as (
  select *, row_number() over (partition by scan_id, src order by d, dst) as rank from pairs
)
select scan_id, src, dst, round(d, 9) + 0e0 as d, rank from ranked where rank <= 4"""
    ),
)
def knn_cosine(spark, d):
    return G.knn(points(spark, d), 4, metric=kernels.cosine).withColumn("d", F.round("d", 9) + F.lit(0.0))


# ---- spanning forests ----------------------------------------------------------------------------


@register("spanning_forest_global")
def spanning_forest_global(spark, d):
    """Parts and suppliers as one graph; brute force in the tests."""
    return global_spanning_forest(supply(spark, d).select(F.col("src").alias("u"), F.col("dst").alias("v"), "w"), stored)


@register("spanning_forest_neighbours")
def spanning_forest_neighbours(spark, d):
    """The forest of the neighbour graph of all scans as one cloud."""
    cloud = points(spark, d)
    near = knn_cells(cloud, 4, stored, group=None)
    return global_spanning_forest(near.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("d").alias("w")), stored, cloud_parts(cloud))


# ---- zones and elements --------------------------------------------------------------------------

FULL = pixels_sql() + ", " + FILL_SQL
#: Whether two pixels touch, of six and of eight neighbours.
TOUCH = {
    6: "((b.row = a.row and abs(b.col - a.col) = 1) or (abs(b.row - a.row) = 1 and b.col - a.col between (a.row % 2) - 1 and a.row % 2))",
    8: "greatest(abs(b.row - a.row), abs(b.col - a.col)) = 1",
}


def zones_sql(same: str, source: str, touch: str) -> str:
    """Table `zn`: pixels with the least number that they reach through touching pixels of which `same` holds."""
    return f""", px_ as (select *, row * 1048576 + col as id from {source}), steps as (
  select a.scan_id, a.id, b.id as next from px_ a join px_ b on a.scan_id = b.scan_id and {touch} and {same}
), reach as (
  select scan_id, id, id as seen from px_ union select r.scan_id, r.id, s.next from reach r join steps s on s.scan_id = r.scan_id and s.id = r.seen
), zn as (
  select p.*, r.zone from px_ p join (select scan_id, id, min(seen) as zone from reach group by 1, 2) r using (scan_id, id)
)"""


def _zone_query(neighbours: int, measure: str, sql: str) -> None:
    labels = ", lab as (select scan_id, row, col, n, zmax, case when n > 0 then 1 + n % 2 else 0 end as held from full_), fore as (select * from lab where held > 0)"
    query = FULL + labels + zones_sql("a.held = b.held", "fore", TOUCH[neighbours])
    query += f""", ms as (select scan_id, zone, cast({sql} as double) as measure from zn group by 1, 2)
select l.scan_id, l.row, l.col, coalesce(m.measure, 0e0) as measure
from lab l left join zn using (scan_id, row, col) left join ms m on m.scan_id = l.scan_id and m.zone = zn.zone"""

    @register(f"zone_measure_{neighbours}", _pts(query).replace("with ", "with recursive ", 1))
    def run(spark, d):
        labels = filled(spark, d).withColumn("held", F.when(F.col("n") > 0, 1 + F.col("n") % 2).otherwise(0))
        return zone_measure(labels, "held", "n", measure, neighbours).select("scan_id", "row", "col", "measure")


_zone_query(6, "mean", "floor(avg(n))")
_zone_query(8, "max", "max(n)")


@register(
    "opening_hexagon",
    _pts(
        FULL
        + f""", near as (
  select a.scan_id, a.row, a.col, b.row as row2, b.col as col2, b.n from full_ a
  join full_ b on a.scan_id = b.scan_id and ({TOUCH[6]} or (a.row = b.row and a.col = b.col))
), low as (
  select scan_id, row, col, min(n) as n from near group by 1, 2, 3
)
select r.scan_id, r.row, r.col, max(l.n) as n from near r join low l on l.scan_id = r.scan_id and l.row = r.row2 and l.col = r.col2 group by 1, 2, 3"""
    ),
)
def opening_hexagon(spark, d):
    return R.opened_hexagon(filled(spark, d).select("scan_id", "row", "col", "n"), "n")


@register(
    "dart_board",
    _pts(
        FULL
        + """, place as (
  select scan_id, row, col, row - 20 as dr, col - 20 as dc, sqrt(((row - 20)*(row - 20) + (col - 20)*(col - 20))::double) as r from full_
), radii as (
  select k, abs(round(1.73e0 * tan(radians(90e0 + k * 26.9e0 / 64)) * 0.5e0)) as radius from range(64) t(k)
), ringed as (
  select p.scan_id, p.row, p.col, dr, dc, coalesce(min(k) + 1, 65) as ring
  from place p left join radii on k > 0 and radius < 40 and radius < floor(r) group by all
), board as (
  select scan_id, row, col, ring, case when dr = 0 and dc = 0 then 0
    else cast(round_even(180e0 + 180e0 * atan2(dr::double, dc::double) / (2 * pi()), 0) as int) end as sector from ringed
)"""
        + zones_sql("a.ring = b.ring and a.sector = b.sector", "board", "abs(a.row - b.row) + abs(a.col - b.col) = 1")
        + " select scan_id, row, col, cast(ring as int) as ring, sector, zone as cell from zn"
    ).replace("with ", "with recursive ", 1),
)
def dart_board(spark, d):
    """Rings, sectors and cells around a scanner in the middle of the fixture's images."""
    image = filled(spark, d).select("scan_id", "row", "col", *[F.lit(v).alias(c) for c, v in (("r0", 20), ("c0", 20), ("height", 40), ("width", 40))])
    return D.dart_board(image, 0.5).select("scan_id", "row", "col", "ring", "sector", "cell")


# ---- hierarchies of sparse graphs ----------------------------------------------------------------


def neighbour_pairs(spark, d):
    """The 4-NN graph of every scan, one row a pair, stored: trees and edges both come from it."""
    return stored(G.symmetric(near_edges(spark, d)).where("src < dst").select(F.col("scan_id").alias("tree_id"), F.col("src").alias("a"), F.col("dst").alias("b"), "w"))


@register("partition_tree")
def partition_tree(spark, d):
    """Forests, where a scan's graph falls apart; brute force in the tests."""
    return T.partition_tree(neighbour_pairs(spark, d)).withColumn("height", r6("height"))


@register("ultrametric_edges")
def ultrametric_edges(spark, d):
    edges = neighbour_pairs(spark, d)
    return T.ultrametric(edges, T.partition_tree(edges)).withColumns({"u": r6("u"), "w": r6("w")})


@register("ultrametric_losses")
def ultrametric_losses(spark, d):
    """Losses of the scans' own hierarchies: the edges' ultrametric against their weights, and cluster sizes."""
    edges = neighbour_pairs(spark, d)
    found = T.ultrametric(edges, T.partition_tree(edges))
    closest, size = T.closest_loss(F.col("u"), F.col("w")), T.cluster_size_loss(F.col("u"), F.col("least"))
    cost = F.sum(F.col("w") * F.col("size"))
    return found.groupBy("tree_id").agg(r6(closest).alias("closest"), r6(size).alias("cluster_size"), r6(T.combined_loss(closest, size, gamma=0.5)).alias("both"), r6(cost).alias("dasgupta"))


# ---- edits of trees ------------------------------------------------------------------------------

#: The parts of every order as a comb: of two lines of one order the later hangs below the earlier; every fourth line is missing.
COMB = """comb as (
  select distinct l_orderkey as tree_id, (10 * l_linenumber)::bigint as node_id, case when l_linenumber > 1 then (10 * (l_linenumber - case when l_linenumber % 2 = 0 then 1 else 2 end))::bigint else -1 end as parent
  from lineitem where l_linenumber <> 4
)"""


def comb(spark, d):
    line = F.col("l_linenumber").cast("long")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <> 4")
    parent = F.when(line > 1, 10 * (line - F.when(line % 2 == 0, 1).otherwise(2))).otherwise(-1)
    return rows.select(F.col("l_orderkey").alias("tree_id"), (10 * line).alias("node_id"), parent.cast("long").alias("parent")).distinct()


STEPS = """, up as (
  select tree_id, node_id, parent, 0::bigint as steps from grown
  union all select u.tree_id, u.node_id, g.parent, u.steps + 1 from up u join grown g on g.tree_id = u.tree_id and g.node_id = u.parent
), deep as (
  select tree_id, node_id, max(steps) as depth from up group by 1, 2
), placed as (
  select g.*, depth, row_number() over (partition by g.tree_id order by {order}) - 1 as place from grown g join deep using (tree_id, node_id)
)
select p.tree_id, p.place as node_id, coalesce(q.place, -1)::bigint as parent, p.depth from placed p left join placed q on q.tree_id = p.tree_id and q.node_id = p.parent"""
GROWN = ", grown as (select * from comb union all select tree_id, max(node_id) + 1, max(node_id) from comb group by 1)"


@register("renumber_tree", "with recursive " + COMB + ", grown as (select * from comb)" + STEPS.format(order="g.node_id"))
def renumber_tree(spark, d):
    """Ids without gaps in the order of the old ones, with depths."""
    return trees.renumber(comb(spark, d), stored).select("tree_id", "node_id", "parent", "depth")


@register("grow_tree", "with recursive " + COMB + GROWN + STEPS.format(order="depth, g.node_id"))
def grow_tree(spark, d):
    """A node more below the last of every tree, then ids level by level."""
    tree = stored(comb(spark, d))
    new = tree.groupBy("tree_id").agg(F.max("node_id").alias("parent"))
    return trees.renumber(trees.add_nodes(tree, new, stored), stored, levels=True).select("tree_id", "node_id", "parent", "depth")
