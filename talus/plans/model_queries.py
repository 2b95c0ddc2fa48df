"""Queries on scores, hierarchies, hyperbolic geometry, message passing and detection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import hyperbolic as H
from talus.operators import detection as D
from talus.operators import gnn as N
from talus.operators import graph as G
from talus.operators import hierarchy as T
from talus.operators import metrics as M
from talus.operators import points as P
from talus.plans.fixtures import VECTORS, disc, points, r6
from talus.plans.graph_queries import KCC, knn_sql, near_labels, sphere_edges
from talus.plans.point_queries import _pts, images, pixels_sql
from talus.storage import stored

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


GROUND = "label in (40,44,48,49,60,72)"

# ---- scores --------------------------------------------------------------------------------------


def judged(spark, d):
    return points(spark, d).withColumn("t", P.is_ground(F.col("label")) == 1).withColumn("p", F.col("z") < -1.55)


COUNTS = f"q as (select scan_id, {GROUND} as t, z < -1.55e0 as p from points where label <> 0), c as (select scan_id, (count(*) filter (t and p))::double as tp, (count(*) filter (not t and p))::double as fp, (count(*) filter (t and not p))::double as fn, (count(*) filter (not t and not p))::double as tn from q group by 1)"


@register("binary_scores", _pts(COUNTS + " select scan_id, (tp+tn)/(tp+tn+fp+fn) as acc, coalesce(tp/nullif(tp+fn,0),0) as recall, coalesce(tp/nullif(tp+fp,0),0) as precision, coalesce(2*tp/nullif(2*tp+fp+fn,0),0) as f1, coalesce(tp/nullif(tp+fp+fn,0),0) as jaccard from c"))
def binary_scores(spark, d):
    return M.binary_scores(judged(spark, d).where(F.col("label") != 0), F.col("t"), F.col("p"), ["scan_id"])


LABELS = [0, 10, 40, 50, 72]
PRED = "case when z < -1.55e0 then 40 when z < -1e0 then 10 else 50 end"
CM = "gr as (select t.v as truth, p.v as pred from (values (0),(10),(40),(50),(72)) t(v), (values (0),(10),(40),(50),(72)) p(v)), ct as (select label as truth, " + PRED + " as pred, count(*) as n from points group by 1,2), cm as (select gr.truth, gr.pred, coalesce(n, 0) as n from gr left join ct using (truth, pred))"


def matrix(spark, d):
    pred = F.when(F.col("z") < -1.55, 40).when(F.col("z") < -1.0, 10).otherwise(50)
    return M.confusion(points(spark, d).withColumn("pred", pred), "label", "pred", LABELS)


@register("confusion_matrix", _pts(CM + " select * from cm"))
def confusion_matrix(spark, d):
    return matrix(spark, d)


GRP = "gg(label, grp) as (values (0,0),(10,1),(40,4),(50,5),(72,4))"


@register("confusion_condensed", _pts(CM + ", " + GRP + " select t.grp as truth, p.grp as pred, sum(n)::bigint as n from cm join gg t on t.label = cm.truth join gg p on p.label = cm.pred group by 1,2"))
def confusion_condensed(spark, d):
    return M.condense(matrix(spark, d), spark.createDataFrame([(0, 0), (10, 1), (40, 4), (50, 5), (72, 4)], "label int, grp int"))


@register("confusion_normalized", _pts(CM + " select truth, pred, n, round(coalesce(100e0*n/nullif(sum(n) over (partition by truth),0),0), 2) + 0e0 as share from cm"))
def confusion_normalized(spark, d):
    return M.normalized(matrix(spark, d))


@register("pr_curve", _pts(f"q as (select round(-z, 2) as s, {GROUND} as t from points where label <> 0), c as (select s, (count(*) filter (t))::double as p, count(*)::double as n from q group by 1) select s as threshold, round(sum(p) over (order by s desc rows unbounded preceding)/sum(n) over (order by s desc rows unbounded preceding), 6) + 0e0 as precision, round(sum(p) over (order by s desc rows unbounded preceding)/sum(p) over (), 6) + 0e0 as recall from c"))
def pr_curve(spark, d):
    out = M.precision_recall(judged(spark, d).where(F.col("label") != 0), F.col("t"), F.round(-F.col("z"), 2), stored)
    return out.withColumns({"precision": r6("precision"), "recall": r6("recall")})


@register("multiclass_iou", _pts("ct as (select label as t, " + PRED + " as p, count(*) as n from points group by 1,2), c as (select distinct unnest([t, p]) as cls, t, p, n from ct) select cls, (sum(case when t = p and t = cls then n else 0 end)::double/sum(n)) as iou from c group by 1"))
def multiclass_iou(spark, d):
    pred = F.when(F.col("z") < -1.55, 40).when(F.col("z") < -1.0, 10).otherwise(50)
    return M.multiclass_iou(points(spark, d).withColumn("pred", pred), "label", "pred")


CONT = "q as (select scan_id, label as t, " + PRED + " as c from points), ct as (select scan_id, t, c, count(*)::double as n from q group by 1,2,3)"


def clustered(spark, d):
    return points(spark, d).withColumn("c", F.when(F.col("z") < -1.55, 40).when(F.col("z") < -1.0, 10).otherwise(50))


@register("purity", _pts(CONT + ", b as (select scan_id, c, max(n) as top, sum(n) as n from ct group by 1,2) select scan_id, sum(top)/sum(n) as purity from b group by 1"))
def purity(spark, d):
    return M.purity(clustered(spark, d), "label", "c", ["scan_id"])


@register("nmi", _pts(CONT + ", m as (select *, sum(n) over (partition by scan_id, t) as nt, sum(n) over (partition by scan_id, c) as nc, sum(n) over (partition by scan_id) as al from ct) select scan_id, round(sum(n/al*ln(n*al/(nt*nc)))/sqrt(sum(-n/al*ln(nt/al))*sum(-n/al*ln(nc/al))), 6) + 0e0 as nmi from m group by 1"))
def nmi(spark, d):
    return M.mutual_information(clustered(spark, d), "label", "c", ["scan_id"]).withColumn("nmi", r6("nmi"))


ARI = "bo as (select scan_id, sum(n*(n-1)/2) as b, sum(n) as n from ct group by 1), pt as (select scan_id, sum(n*(n-1)/2) as p from (select scan_id, t, sum(n) as n from ct group by 1,2) group by 1), pc as (select scan_id, sum(n*(n-1)/2) as p from (select scan_id, c, sum(n) as n from ct group by 1,2) group by 1)"


@register("adjusted_rand", _pts(CONT + ", " + ARI + " select scan_id, round((b - pt.p*pc.p/(n*(n-1)/2))/((pt.p+pc.p)/2 - pt.p*pc.p/(n*(n-1)/2)), 6) + 0e0 as ari from bo join pt using (scan_id) join pc using (scan_id)"))
def adjusted_rand(spark, d):
    return M.adjusted_rand(clustered(spark, d), "label", "c", ["scan_id"]).withColumn("ari", r6("ari"))


@register("assignment_accuracy")
def assignment_accuracy(spark, d):
    return M.best_assignment_accuracy(clustered(spark, d), "label", "c", "scan_id")


@register("metric_summary", _pts(COUNTS + ", a as (select (tp+tn)/(tp+tn+fp+fn) as acc from c) select round(avg(acc), 6) + 0e0 as mean, round(stddev_samp(acc), 6) + 0e0 as std, round(stddev_pop(acc), 6) + 0e0 as std_pop from a"))
def metric_summary(spark, d):
    s = M.binary_scores(judged(spark, d).where(F.col("label") != 0), F.col("t"), F.col("p"), ["scan_id"])
    return s.agg(r6(F.avg("acc")).alias("mean"), r6(F.stddev_samp("acc")).alias("std"), r6(F.stddev_pop("acc")).alias("std_pop"))


@register("noise_robustness", _pts(f"n as (select unnest(range(0, 17)) as k), q as (select k, scan_id, avg(({GROUND} = (z + k*0.02e0 < -1.55e0))::int) as acc from points, n where label <> 0 group by 1,2) select k::int as k, round(avg(acc), 6) + 0e0 as mean, round(stddev_pop(acc), 6) + 0e0 as std from q group by 1"))
def noise_robustness(spark, d):
    rows = judged(spark, d).where(F.col("label") != 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(16))))
    acc = rows.groupBy("k", "scan_id").agg(F.avg((F.col("t") == (F.col("z") + F.col("k") * F.lit(0.02) < -1.55)).cast("int")).alias("acc"))
    return acc.groupBy("k").agg(r6(F.avg("acc")).alias("mean"), r6(F.stddev_pop("acc")).alias("std"))


@register("kl_gauss", _pts("s as (select label, avg(z) as m, stddev_pop(z) as s from points group by 1) select a.label as a, b.label as b, round(ln(b.s/a.s)+(a.s*a.s+(a.m-b.m)*(a.m-b.m))/(2*b.s*b.s)-0.5e0, 6) + 0e0 as kl from s a join s b on a.label < b.label"))
def kl_gauss(spark, d):
    s = points(spark, d).groupBy("label").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"))
    a, b = (s.select(F.col("label").alias(k), F.col("m").alias(f"m_{k}"), F.col("s").alias(f"s_{k}")) for k in "ab")
    both = a.join(b, F.col("a") < F.col("b"))
    return both.select("a", "b", r6(H.kl_gauss(F.col("m_a"), F.col("s_a"), F.col("m_b"), F.col("s_b"))).alias("kl"))


@register("percentile_min_z", _pts("select scan_id, round(quantile_cont(z, 0.005e0), 9) + 0e0 as min_z from points group by 1"))
def percentile_min_z(spark, d):
    return points(spark, d).groupBy("scan_id").agg((F.round(F.percentile("z", F.lit(0.005)), 9) + F.lit(0.0)).alias("min_z"))


@register("histogram_min_z", _pts("b as (select scan_id, min(z) as z0, max(z) as z1 from points group by 1), c as (select p.scan_id, z0, floor((z-z0)/0.1e0)::bigint as bin from points p join b using (scan_id) where floor((z-z0)/0.1e0) < ceil((z1-z0)/0.1e0) - 1), n as (select scan_id, z0, bin, count(*) as n from c group by 1,2,3 having count(*) > 50) select scan_id, round(z0 + min(bin)*0.1e0, 9) + 0e0 as min_z from n group by scan_id, z0"))
def histogram_min_z(spark, d):
    return D.histogram_floor(points(spark, d), 0.1, 50).withColumn("min_z", F.round("min_z", 9) + F.lit(0.0))


# ---- hierarchies ---------------------------------------------------------------------------------


def _vec(sql: str) -> str:
    return f"with recursive {VECTORS}, {sql}" if not sql.lstrip().startswith("select") else f"with {VECTORS} {sql}"


PAIR = "pr as (select a.tree_id, a.id as a, b.id as b, a.cls as ca, b.cls as cb, a.x as ax, a.y as ay, b.x as bx, b.y as \"by\", sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as w from disc a join disc b on a.tree_id = b.tree_id and a.id < b.id)"


def disc_pairs(spark, d):
    rows = T.pairs(disc(spark, d), ["cls", "x", "y"])
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    return rows.withColumn("w", F.sqrt(dx * dx + dy * dy))


@register("pairs_upper", _vec(PAIR + " select tree_id, a, b, ca = cb as same from pr"))
def pairs_upper(spark, d):
    return disc_pairs(spark, d).select("tree_id", "a", "b", (F.col("a_cls") == F.col("b_cls")).alias("same"))


@register("triplets", _vec(PAIR + " select pr.tree_id, a, b as p, n.id as n from pr join disc n on n.tree_id = pr.tree_id and n.cls <> ca where ca = cb"))
def triplets(spark, d):
    return T.triplets(disc(spark, d), ["x", "y"]).select("tree_id", "a", "p", "n")


@register("cosine_pairs", _vec(PAIR + " select tree_id, a, b, round((ax*bx + ay*\"by\")/(sqrt(ax*ax+ay*ay)*sqrt(bx*bx+\"by\"*\"by\")), 6) + 0e0 as cosine from pr"))
def cosine_pairs(spark, d):
    from talus.functions.geometry import dot, norm

    a, b = [F.col("a_x"), F.col("a_y")], [F.col("b_x"), F.col("b_y")]
    return disc_pairs(spark, d).select("tree_id", "a", "b", r6(dot(a, b) / (norm(*a) * norm(*b))).alias("cosine"))


@register("single_linkage")
def single_linkage(spark, d):
    return T.single_linkage(disc_pairs(spark, d))


CUT = PAIR + ", sv as (select tree_id, a, b from pr where w < 0.06e0), be as (select tree_id, a as s, b as t from sv union all select tree_id, b, a from sv), rc as (select tree_id, id as node, id as seen from disc union select rc.tree_id, rc.node, be.t from rc join be on be.tree_id = rc.tree_id and be.s = rc.seen)"


@register("single_linkage_cut", _vec(CUT + " select tree_id, node as id, min(seen) as cc from rc group by 1,2"))
def single_linkage_cut(spark, d):
    e = disc_pairs(spark, d).where(F.col("w") < 0.06).select(F.col("tree_id").alias("scan_id"), F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    nodes = disc(spark, d).select(F.col("tree_id").alias("scan_id"), F.col("id").alias("node_id"))
    return G.connected_components(e, nodes).select(F.col("scan_id").alias("tree_id"), F.col("node_id").alias("id"), "cc")


@register("best_k")
def best_k(spark, d):
    # As many clusters as classes, numbered from 0, and up to four more.
    most = disc(spark, d).groupBy("tree_id").agg((F.max("cls") + 5).alias("most"))
    cuts = T.linkage_cuts(disc_pairs(spark, d).join(most, "tree_id"), "most")
    rows = cuts.join(disc(spark, d).select("tree_id", "id", "cls"), ["tree_id", "id"])
    ari = M.adjusted_rand(rows, "cls", "cc", ["tree_id", "k"])
    return ari.groupBy("tree_id").agg(F.max_by("k", F.struct(F.round("ari", 9), -F.col("k"))).alias("k"), r6(F.max("ari")).alias("ari"))


# A binary tree over the ids of each disc: the parent of heap node v is v // 2, leaves are 32 to 56.
HEAP = "hp as (select tree_id, v::bigint as node_id, case when v > 1 then v // 2 else -1 end::bigint as parent from (select distinct tree_id from disc), range(1, 57) r(v)), an as (select tree_id, node_id, node_id as ancestor, 0 as steps from hp union all select an.tree_id, an.node_id, an.ancestor // 2, steps + 1 from an where an.ancestor > 1), sz as (select tree_id, ancestor as node_id, count(*) filter (node_id >= 29) as size from an group by 1,2)"


def heap(spark, d):
    trees = disc(spark, d).select("tree_id").distinct()
    nodes = trees.withColumn("node_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(56).cast("long"))))
    tree = nodes.withColumn("parent", F.when(F.col("node_id") > 1, F.floor(F.col("node_id") / 2)).otherwise(F.lit(-1)).cast("long"))
    sizes = T.ancestors(tree).groupBy("tree_id", F.col("ancestor").alias("v")).agg(F.count_if(F.col("node_id") >= 29).alias("size"))
    return tree.join(sizes.withColumnRenamed("v", "node_id"), ["tree_id", "node_id"])


@register("tree_depth", _vec(HEAP + " select tree_id, node_id, max(steps)::bigint as depth from an group by 1,2"))
def tree_depth(spark, d):
    return T.depths(heap(spark, d))


LEAVES = "lf as (select a.tree_id, 29 + (a.id % 25) as a, 29 + (b.id % 25) as b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as w, a.cls = b.cls as same from disc a join disc b on a.tree_id = b.tree_id and a.id < b.id), lc as (select lf.tree_id, lf.a, lf.b, w, same, arg_min(x.ancestor, x.steps) as lca from lf join an x on x.tree_id = lf.tree_id and x.node_id = lf.a join an y on y.tree_id = lf.tree_id and y.node_id = lf.b and y.ancestor = x.ancestor group by 1,2,3,4,5)"


def leaf_pairs(spark, d):
    rows = disc_pairs(spark, d)
    leaf = lambda c: (F.lit(29) + F.col(c) % 25).cast("long")
    return rows.select("tree_id", leaf("a").alias("a"), leaf("b").alias("b"), "w", (F.col("a_cls") == F.col("b_cls")).alias("same"))


@register("lca", _vec(HEAP + ", " + LEAVES + " select tree_id, a, b, lca from lc"))
def lca(spark, d):
    return T.lowest_common(leaf_pairs(spark, d).select("tree_id", "a", "b"), heap(spark, d))


@register("dasgupta_cost", _vec(HEAP + ", " + LEAVES + " select lc.tree_id, round(sum(w*size), 5) + 0e0 as cost from lc join sz on sz.tree_id = lc.tree_id and sz.node_id = lc.lca group by 1"))
def dasgupta_cost(spark, d):
    cost = T.dasgupta_cost(leaf_pairs(spark, d).select("tree_id", "a", "b", "w"), heap(spark, d))
    return cost.withColumn("cost", F.round("cost", 5) + F.lit(0.0))


def _met(spark, d):
    tree = heap(spark, d)
    return T.lowest_common(leaf_pairs(spark, d), tree).join(tree.select("tree_id", F.col("node_id").alias("lca"), "size"), ["tree_id", "lca"])


U = "(sz.size::double / 28e0)"


@register("closest_loss", _vec(HEAP + ", " + LEAVES + f" select lc.tree_id, round(avg(({U}-w)*({U}-w)), 6) + 0e0 as loss from lc join sz on sz.tree_id = lc.tree_id and sz.node_id = lc.lca group by 1"))
def closest_loss(spark, d):
    return _met(spark, d).groupBy("tree_id").agg(r6(T.closest_loss(F.col("size").cast("double") / 28.0, F.col("w"))).alias("loss"))


@register("cluster_size_loss", _vec(HEAP + ", " + LEAVES + f" select lc.tree_id, round(max({U}/least(l.size, r.size)), 6) + 0e0 as loss from lc join sz on sz.tree_id = lc.tree_id and sz.node_id = lc.lca join sz l on l.tree_id = lc.tree_id and l.node_id = lc.lca*2 join sz r on r.tree_id = lc.tree_id and r.node_id = lc.lca*2+1 where l.size > 0 and r.size > 0 group by 1"))
def cluster_size_loss(spark, d):
    sizes = heap(spark, d).select("tree_id", F.col("node_id"), F.col("size").alias("s"))
    met = _met(spark, d)
    for k, name in ((0, "l"), (1, "r")):
        met = met.withColumn("node_id", F.col("lca") * 2 + k).join(sizes.withColumnRenamed("s", name), ["tree_id", "node_id"]).drop("node_id")
    met = met.where((F.col("l") > 0) & (F.col("r") > 0))
    return met.groupBy("tree_id").agg(r6(T.cluster_size_loss(F.col("size").cast("double") / 28.0, F.least("l", "r"))).alias("loss"))


@register("ultrametric_triplet", _vec(HEAP + ", " + LEAVES + f" , al as (select lc.tree_id, a, b, same, {U} as u from lc join sz on sz.tree_id = lc.tree_id and sz.node_id = lc.lca), bi as (select * from al union all select tree_id, b, a, same, u from al) select p.tree_id, round(avg(greatest(0e0, p.u - n.u + 0.1e0)), 6) + 0e0 as loss from al p join bi n on n.tree_id = p.tree_id and n.a = p.a and not n.same where p.same group by 1"))
def ultrametric_triplet(spark, d):
    al = _met(spark, d).select("tree_id", "a", "b", "same", (F.col("size").cast("double") / 28.0).alias("u"))
    back = al.select("tree_id", F.col("b").alias("a"), F.col("a").alias("b"), "same", "u")
    neg = al.unionByName(back).where(~F.col("same")).select("tree_id", "a", F.col("u").alias("nu"))
    rows = al.where("same").join(neg, ["tree_id", "a"])
    return rows.groupBy("tree_id").agg(r6(T.triplet_loss(F.col("u"), F.col("nu"), 0.1)).alias("loss"))


@register("delete_tree_node", _vec(HEAP + " select tree_id, node_id, case when parent = 5 then 2 else parent end as parent from hp where node_id <> 5"))
def delete_tree_node(spark, d):
    return T.delete_node(heap(spark, d).select("tree_id", "node_id", "parent"), 5)


# ---- hyperbolic geometry -------------------------------------------------------------------------




def _ab():
    return [F.col("a_x"), F.col("a_y")], [F.col("b_x"), F.col("b_y")]


#: The same algebra on plain numbers for the oracle: macros of one statement each.
ATANH = "atanh(least(greatest({0}, -1e0+1e-5), 1e0-1e-5))"
DO = "2*" + ATANH


@register("hyperbolic_distance", _vec(PAIR + " select tree_id, a, b, round(acosh(greatest(1e0 + 2*w*w/((1e0-(ax*ax+ay*ay))*(1e0-(bx*bx+\"by\"*\"by\"))), 1e0+1e-7)), 6) + 0e0 as d from pr"))
def hyperbolic_distance(spark, d):
    a, b = _ab()
    return disc_pairs(spark, d).select("tree_id", "a", "b", r6(H.distance(a, b)).alias("d"))


MID = PAIR + """, m1 as (select *, "by" as by_, 1e0 - (ax*bx + ay*"by") as dr, -(ax*"by" - ay*bx) as di, bx-ax as nr, "by"-ay as ni from pr),
m2 as (select *, (nr*dr + ni*di)/greatest(dr*dr+di*di, 1e-15) as mr, (ni*dr - nr*di)/greatest(dr*dr+di*di, 1e-15) as mi from m1),
m3 as (select *, greatest(sqrt(mr*mr+mi*mi), 1e-15) as mn from m2),
m4 as (select *, tanh(""" + ATANH.format("mn") + """/2)/mn*mr as hr, tanh(""" + ATANH.format("mn") + """/2)/mn*mi as hi from m3),
m5 as (select *, 1e0 + (ax*hr + ay*hi) as er, ax*hi - ay*hr as ei from m4),
m6 as (select *, ((hr+ax)*er + (hi+ay)*ei)/greatest(er*er+ei*ei, 1e-15) as px, ((hi+ay)*er - (hr+ax)*ei)/greatest(er*er+ei*ei, 1e-15) as py from m5)"""


@register("hyperbolic_lca", _vec(MID + " select tree_id, a, b, round(least(" + DO.format("sqrt(ax*ax+ay*ay)") + ", " + DO.format("sqrt(bx*bx+by_*by_)") + ", " + DO.format("sqrt(px*px+py*py)") + "), 6) + 0e0 as d from m6"))
def hyperbolic_lca(spark, d):
    a, b = _ab()
    return disc_pairs(spark, d).select("tree_id", "a", "b", r6(H.lca_depth(a, b)).alias("d"))


@register("mobius_transform", _vec(MID + " select tree_id, a, b, round(mr, 6) + 0e0 as mx, round(mi, 6) + 0e0 as my from m6"))
def mobius_transform(spark, d):
    m = H.mobius(*_ab())
    return disc_pairs(spark, d).select("tree_id", "a", "b", r6(m[0]).alias("mx"), r6(m[1]).alias("my"))


@register("mobius_add", _vec(PAIR + ", k as (select *, ax*bx+ay*\"by\" as xy, ax*ax+ay*ay as xx, bx*bx+\"by\"*\"by\" as yy from pr) select tree_id, a, b, round(((1+2*xy+yy)*ax+(1-xx)*bx)/greatest(1+2*xy+xx*yy, 1e-15), 6) + 0e0 as sx, round(((1+2*xy+yy)*ay+(1-xx)*\"by\")/greatest(1+2*xy+xx*yy, 1e-15), 6) + 0e0 as sy from k"))
def mobius_add(spark, d):
    s = H.mobius_add(*_ab())
    return disc_pairs(spark, d).select("tree_id", "a", "b", r6(s[0]).alias("sx"), r6(s[1]).alias("sy"))


@register("gyration", _vec(PAIR + ", k as (select *, ax*ax+ay*ay as uu, bx*bx+\"by\"*\"by\" as vv, ax*bx+ay*\"by\" as uv, ax*0.3e0+ay*0.1e0 as uw, bx*0.3e0+\"by\"*0.1e0 as vw from pr), c as (select *, -uw*vv+vw+2*uv*vw as p, -vw*uu-uw as q, greatest(1+2*uv+uu*vv, 1e-15) as dd from k) select tree_id, a, b, round(0.3e0 + 2*(p*ax+q*bx)/dd, 6) + 0e0 as gx, round(0.1e0 + 2*(p*ay+q*\"by\")/dd, 6) + 0e0 as gy from c"))
def gyration(spark, d):
    a, b = _ab()
    g = H.gyration(a, b, [F.lit(0.3), F.lit(0.1)])
    return disc_pairs(spark, d).select("tree_id", "a", "b", r6(g[0]).alias("gx"), r6(g[1]).alias("gy"))


@register("expmap", _vec("k as (select *, greatest(sqrt(x*x+y*y), 1e-15) as n, 2e0/greatest(1e0-(0.2e0*0.2e0+0.1e0*0.1e0), 1e-15) as l from disc), u as (select *, tanh(l*n/2)/n*x as ux, tanh(l*n/2)/n*y as uy from k), v as (select *, 0.2e0*ux+0.1e0*uy as xy, 0.2e0*0.2e0+0.1e0*0.1e0 as xx, ux*ux+uy*uy as yy from u) select tree_id, id, round(((1+2*xy+yy)*0.2e0+(1-xx)*ux)/greatest(1+2*xy+xx*yy, 1e-15), 6) + 0e0 as ex, round(((1+2*xy+yy)*0.1e0+(1-xx)*uy)/greatest(1+2*xy+xx*yy, 1e-15), 6) + 0e0 as ey from v"))
def expmap(spark, d):
    e = H.exp_map([F.col("x"), F.col("y")], [F.lit(0.2), F.lit(0.1)])
    return disc(spark, d).select("tree_id", "id", r6(e[0]).alias("ex"), r6(e[1]).alias("ey"))


@register("poincare_project", _vec("select tree_id, id, round(case when sqrt(4*x*x+4*y*y) > 1e0-1e-5 then 2*x/sqrt(4*x*x+4*y*y)*(1e0-1e-5) else 2*x end, 6) + 0e0 as px, round(case when sqrt(4*x*x+4*y*y) > 1e0-1e-5 then 2*y/sqrt(4*x*x+4*y*y)*(1e0-1e-5) else 2*y end, 6) + 0e0 as py, round(0.5e0*x/greatest(sqrt(x*x+y*y), 1e-15), 6) + 0e0 as rx, round(0.5e0*y/greatest(sqrt(x*x+y*y), 1e-15), 6) + 0e0 as ry from disc"))
def poincare_project(spark, d):
    x = [F.col("x"), F.col("y")]
    p, r = H.project([2 * c for c in x]), H.rescale(x, 0.5)
    return disc(spark, d).select("tree_id", "id", r6(p[0]).alias("px"), r6(p[1]).alias("py"), r6(r[0]).alias("rx"), r6(r[1]).alias("ry"))


@register("hyp_lca_projection", _vec(PAIR + """, k as (select *, "by" as by_, ax/greatest(ax*ax+ay*ay, 1e-15) as cx, ay/greatest(ax*ax+ay*ay, 1e-15) as cy from pr),
l as (select *, (cx*cx+cy*cy-1)/greatest((bx-cx)*(bx-cx)+(by_-cy)*(by_-cy), 1e-15) as f from k), m as (select *, f*(bx-cx)+cx as ix, f*(by_-cy)+cy as iy from l),
n as (select *, (ax*ix+ay*iy)/greatest(ix*ix+iy*iy, 1e-15) as g from m), o as (select *, 2*g*ix-ax as qx, 2*g*iy-ay as qy from n),
p as (select *, (cx*cx+cy*cy-1)/greatest((qx-cx)*(qx-cx)+(qy-cy)*(qy-cy), 1e-15) as h from o), q as (select *, h*(qx-cx)+cx as ox, h*(qy-cy)+cy as oy from p)
select tree_id, a, b, round(ox/(1+sqrt(greatest(1-(ox*ox+oy*oy), 0))), 5) + 0e0 as lx, round(oy/(1+sqrt(greatest(1-(ox*ox+oy*oy), 0))), 5) + 0e0 as ly from q"""))
def hyp_lca_projection(spark, d):
    p = H.lca_point(*_ab())
    return disc_pairs(spark, d).select("tree_id", "a", "b", (F.round(p[0], 5) + F.lit(0.0)).alias("lx"), (F.round(p[1], 5) + F.lit(0.0)).alias("ly"))


@register("focal_loss", _pts(f"q as (select scan_id, least(greatest(1e0/(1e0+exp(10e0*(z+1.4e0))), 1e-7), 1e0-1e-7) as p, {GROUND} as y from points) select scan_id, round(avg(case when y then 0.25e0*pow(1-p, 2)*-ln(p) else 0.75e0*pow(p, 2)*-ln(1-p) end), 6) + 0e0 as loss from q group by 1"))
def focal_loss(spark, d):
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(10.0) * (F.col("z") + 1.4)))
    return points(spark, d).groupBy("scan_id").agg(r6(F.avg(H.focal_loss(p, P.is_ground(F.col("label"))))).alias("loss"))


HL = "dd as (select tree_id, a, b, least(" + DO.format("sqrt(ax*ax+ay*ay)") + ", " + DO.format("sqrt(bx*bx+by_*by_)") + ", " + DO.format("sqrt(px*px+py*py)") + ") as l, exp(-w) as s from m6), bi as (select * from dd union all select tree_id, b, a, l, s from dd), tr as (select p.tree_id, p.s as s1, n.s as s2, o.s as s3, p.l as l1, n.l as l2, o.l as l3 from pr q join dd p on p.tree_id = q.tree_id and p.a = q.a and p.b = q.b join disc z on z.tree_id = q.tree_id and z.cls <> q.ca join bi n on n.tree_id = q.tree_id and n.a = q.a and n.b = z.id join bi o on o.tree_id = q.tree_id and o.a = q.b and o.b = z.id where q.ca = q.cb)"


@register("hyphc_loss", _vec(MID + ", " + HL + ", e as (select tree_id, s1+s2+s3 - (s1*exp(l1/0.5e0)+s2*exp(l2/0.5e0)+s3*exp(l3/0.5e0))/(exp(l1/0.5e0)+exp(l2/0.5e0)+exp(l3/0.5e0)) as t from tr), m as (select tree_id, avg(s) as ms from dd group by 1) select e.tree_id, round(avg(t) + any_value(ms), 5) + 0e0 as loss from e join m using (tree_id) group by 1"))
def hyphc_loss(spark, d):
    rows = T.triplets(disc(spark, d), ["x", "y"])
    v = {k: [F.col(f"{k}_x"), F.col(f"{k}_y")] for k in "abn"}

    def s_and_l(p, q):
        dx, dy = v[p][0] - v[q][0], v[p][1] - v[q][1]
        return F.exp(-F.sqrt(dx * dx + dy * dy)), H.lca_depth(v[p], v[q])

    (s1, l1), (s2, l2), (s3, l3) = s_and_l("a", "b"), s_and_l("a", "n"), s_and_l("b", "n")
    e = [F.exp(x / 0.5) for x in (l1, l2, l3)]
    t = s1 + s2 + s3 - (s1 * e[0] + s2 * e[1] + s3 * e[2]) / (e[0] + e[1] + e[2])
    pair = disc_pairs(spark, d).groupBy("tree_id").agg(F.avg(F.exp(-F.col("w"))).alias("ms"))
    return rows.groupBy("tree_id").agg(F.avg(t).alias("t")).join(pair, "tree_id").select("tree_id", (F.round(F.col("t") + F.col("ms"), 5) + F.lit(0.0)).alias("loss"))


# ---- message passing -----------------------------------------------------------------------------

W = [[0.5, -0.25, 1.0, 0.75], [-1.0, 0.5, 0.25, 2.0]]


def few_edges(spark, d):
    return G.knn(points(spark, d), 5)


ENDS = knn_sql(5) + ", ee as (select k.*, s.x as sx, s.z as sz, s.i as si, t.x as tx, t.z as tz, t.i as ti from kn k join points s on s.scan_id = k.scan_id and s.point_id = k.src join points t on t.scan_id = k.scan_id and t.point_id = k.dst)"


def _conv(how: str, sql: str):
    h = ", ".join(f"round({sql}(greatest({w[0]}e0*sz + {w[1]}e0*si + {w[2]}e0*(tz-sz) + {w[3]}e0*(ti-si), 0e0)), 6) + 0e0 as h{k}" for k, w in enumerate(W))

    @register("edge_conv" if how == "max" else f"edge_conv_{how}", _pts(ENDS + f" select scan_id, src as point_id, {h} from ee group by 1,2"))
    def run(spark, d):
        out = N.edge_conv(few_edges(spark, d), points(spark, d), ["z", "i"], W, how)
        return out.select("scan_id", "point_id", r6("h0").alias("h0"), r6("h1").alias("h1"))


_conv("max", "max")
_conv("mean", "avg")
_conv("add", "sum")

MW = [[0.1, 0.4], [0.2, -1.0], [0.3, 0.3], [0.4, 0.2], [0.5, 0.1]]


def _morph(name: str, erode: bool, negative: bool, f: str, sign: str):
    table = ["[" + ", ".join(f"{max(r[k], 0.0)}e0" for r in MW) + "]" for k in range(2)]
    h = ", ".join(f"round({f}(t{c} {sign} {table[k]}[rank]), 6) + 0e0 as h{k}_{c}" for k in range(2) for c in ("z", "i"))

    @register(name, _pts(ENDS + f" select scan_id, src as point_id, {h} from ee group by 1,2"))
    def run(spark, d):
        out = N.morphological_conv(few_edges(spark, d), points(spark, d), ["z", "i"], MW, erode, negative)
        return out.select("scan_id", "point_id", *[r6(c).alias(c) for c in out.columns[2:]])


_morph("dilate_conv", False, True, "max", "-")
_morph("erode_conv", True, False, "min", "+")
_morph("erode_flat_conv", True, True, "min", "-")


@register("bilateral_conv", _pts(ENDS + ", ww as (select *, exp(-sqrt((sz-tz)*(sz-tz)+(si-ti)*(si-ti))/(1e0+1e-16) - sqrt((sx-tx)*(sx-tx))/(4e0+1e-16)) as w from ee) select scan_id, src as point_id, round(sum((sz-tz)*w)/(sum(w)+1e-16), 6) + 0e0 as h_z, round(sum((si-ti)*w)/(sum(w)+1e-16), 6) + 0e0 as h_i from ww group by 1,2"))
def bilateral_conv(spark, d):
    out = N.bilateral_conv(few_edges(spark, d), points(spark, d), ["z", "i"], ["x"], 1.0, 2.0)
    return out.select("scan_id", "point_id", r6("h_z").alias("h_z"), r6("h_i").alias("h_i"))


@register("attention_conv", _pts(ENDS + ", aa as (select *, exp(sz-tz - max(sz-tz) over (partition by scan_id, src)) as e from ee), pp as (select *, e/sum(e) over (partition by scan_id, src) as p from aa) select scan_id, src as point_id, round(sum(tz*(p/(abs(p-0.1e0)+1e-5)*greatest(p-0.1e0, 0e0))), 5) + 0e0 as h from pp group by 1,2"))
def attention_conv(spark, d):
    out = N.attention_conv(few_edges(spark, d), points(spark, d), "z", 0.1)
    return out.select("scan_id", "point_id", (F.round("h", 5) + F.lit(0.0)).alias("h"))


RRI = knn_sql(5) + """, e as (select k.scan_id, k.src, k.dst, s.x as px, s.y as py, s.z as pz, t.x as qx, t.y as qy, t.z as qz from kn k join points s on s.scan_id = k.scan_id and s.point_id = k.src join points t on t.scan_id = k.scan_id and t.point_id = k.dst),
f as (select *, sqrt(px*px+py*py+pz*pz) as ri, sqrt(qx*qx+qy*qy+qz*qz) as rj from e),
g as (select *, acos(least(greatest((px/ri)*(qx/rj)+(py/ri)*(qy/rj)+(pz/ri)*(qz/rj), -1e0), 1e0)) as th, (px/ri)*qx+(py/ri)*qy+(pz/ri)*qz as al from f),
h as (select *, qx-al*(px/ri) as ux, qy-al*(py/ri) as uy, qz-al*(pz/ri) as uz from g), i as (select *, sqrt(ux*ux+uy*uy+uz*uz) as un from h),
j as (select a.scan_id, a.src, a.dst, a.ri, a.rj, a.th, (a.ux/a.un)*(b.ux/b.un)+(a.uy/a.un)*(b.uy/b.un)+(a.uz/a.un)*(b.uz/b.un) as c from i a join i b on a.scan_id = b.scan_id and a.src = b.src and a.dst <> b.dst)"""


@register("rri", _pts(RRI + " select scan_id, src, dst, round(ri, 6) + 0e0 as rho_i, round(rj, 6) + 0e0 as rho_j, round(th, 5) + 0e0 as theta, round(min(atan2(sqrt(least(greatest(1-c*c, 0e0), 1e0)), c)), 4) + 0e0 as phi from j group by scan_id, src, dst, ri, rj, th"))
def rri(spark, d):
    out = N.invariant_features(points(spark, d), 5)
    return out.select("scan_id", "src", "dst", r6("rho_i").alias("rho_i"), r6("rho_j").alias("rho_j"), (F.round("theta", 5) + F.lit(0.0)).alias("theta"), (F.round("phi", 4) + F.lit(0.0)).alias("phi"))


# ---- detection -----------------------------------------------------------------------------------

#: Rounds of the search over a whole cloud and over two components.
ROUNDS, MERGE_ROUNDS = 500, 100
LCG = "((({s})*1103515245 + 12345) % 2147483648)"


def _ransac_sql(iterations: int, source: str, dist: float, group: str = "scan_id") -> str:
    """Planes of groups of points; the last column of the group seeds the choice."""
    seed = group.split(", ")[-1]
    pick = lambda k: LCG.format(s=f"t*3 + {k} + {seed}*7919") + " % n"
    corner = lambda x: f"join (select {group}, r as {x}, x as {x}1, y as {x}2, z as {x}3 from rk) using ({group}, {x})"
    return f"""pp as ({source}),
rk as (select *, row_number() over (partition by {group} order by point_id) - 1 as r from pp),
nn as (select {group}, count(*) as n from pp group by all having count(*) >= 3),
tt as (select {group}, n, t, {pick(0)} as a, {pick(1)} as b, {pick(2)} as c from nn, range(0, {iterations}) q(t)),
tu as (select * from tt where a <> b and b <> c and a <> c),
ab as (
  select {group}, t, a1 as px, a2 as py, a3 as pz, b1-a1 as ux, b2-a2 as uy, b3-a3 as uz, c1-a1 as vx, c2-a2 as vy, c3-a3 as vz
  from tu {corner("a")} {corner("b")} {corner("c")}
),
pl as (select *, uy*vz-uz*vy as nx, uz*vx-ux*vz as ny, ux*vy-uy*vx as nz from ab),
pk as (select *, sqrt(nx*nx+ny*ny+nz*nz) as nl from pl where sqrt(nx*nx+ny*ny+nz*nz) >= 1e-12),
ct as (
  select {group}, t, count(*) filter (abs(nx*(x-px)+ny*(y-py)+nz*(z-pz))/nl < {dist}e0) as n_inliers
  from pp join pk using ({group}) group by all
),
bs as (select {group}, arg_min(t, (-n_inliers, t)) as t, max(n_inliers) as n_inliers from ct group by all)"""


@register("ransac_plane", _pts(_ransac_sql(ROUNDS, "select * from points", 0.2) + " select scan_id, t, n_inliers from bs"))
def ransac_plane(spark, d):
    return D.ransac_plane(points(spark, d), 0.2, ROUNDS).select("scan_id", "t", "n_inliers")


@register("naive_ransac", _pts(_ransac_sql(ROUNDS, "select * from points where z > -4e0 and z < -1e0", 0.2) + " select p.scan_id, p.point_id, p.z > -4e0 and p.z < -1e0 and abs(nx*(x-px)+ny*(y-py)+nz*(z-pz))/nl < 0.2e0 as ground from points p join bs on bs.scan_id = p.scan_id join pk k on k.scan_id = bs.scan_id and k.t = bs.t"))
def naive_ransac(spark, d):
    return D.ransac_ground(points(spark, d), -4.0, -1.0, 0.2, ROUNDS).select("scan_id", "point_id", "ground")


MERGE = (
    KCC
    + """, lp as (select p.*, cc from points p join rc r on r.scan_id = p.scan_id and r.node_id = p.point_id),
cs as (select *, row_number() over (partition by scan_id order by n desc, cc) as rank from (select scan_id, cc, count(*) as n from rc group by all)),
pq as (select f.scan_id, f.cc as big, o.cc as other from cs f join cs o on o.scan_id = f.scan_id and f.rank = 1 and o.rank > 1 and o.n > 3), """
    + _ransac_sql(MERGE_ROUNDS, "select q.other, a.* from pq q join lp a on a.scan_id = q.scan_id and a.cc in (q.big, q.other)", 0.3, "scan_id, other")
    + """, js as (
  select scan_id, other as cc from pp join bs using (scan_id, other) join pk using (scan_id, other, t) where cc = other
  group by all having avg((abs(nx*(x-px)+ny*(y-py)+nz*(z-pz))/nl < 0.3e0)::int) > 0.5e0
)
select a.scan_id, point_id, rank = 1 or js.cc is not null as ground
from lp a join cs on cs.scan_id = a.scan_id and cs.cc = a.cc left join js on js.scan_id = a.scan_id and js.cc = a.cc"""
)


@register("merge_labels", _pts(MERGE))
def merge_labels(spark, d):
    return D.merge_labels(points(spark, d), stored(near_labels(spark, d)), 3, 0.3, MERGE_ROUNDS, 0.5, stored)


@register("pca_normals")
def pca_normals(spark, d):
    return D.pca_normals(points(spark, d), 10)


@register("eigenentropy")
def eigenentropy(spark, d):
    n = D.pca_normals(points(spark, d), 10)
    return n.select("scan_id", "point_id", D.eigenentropy(F.col("e0"), F.col("e0") + F.col("e1") + F.col("e2")).alias("entropy"))


@register("hybrid_ground")
def hybrid_ground(spark, d):
    """Flat zones on the range image's graph and the neighbour graph together."""
    p = points(spark, d)
    graph = stored(G.merge_graphs(sphere_edges(spark, d), G.knn_graph(p, 8)))
    return D.hybrid_ground(p, graph, 0.5, 10, 3, 0.3, MERGE_ROUNDS, 0.5, stored)


@register("iterative_ground")
def iterative_ground(spark, d):
    return D.iterative_ground(points(spark, d), sphere_edges(spark, d), 0.2, 20, 20, stored)


@register("csf_ground")
def csf_ground(spark, d):
    return D.cloth_ground(points(spark, d), res=0.5, local_rigidness=0.5).select("scan_id", "point_id", "ground")


@register("csf_ground_mask")
def csf_ground_mask(spark, d):
    return D.cloth_ground(points(spark, d), res=0.5, avg_mode="mask").select("scan_id", "point_id", "ground")


@register("dart_ground")
def dart_ground(spark, d):
    return D.dart_ground(points(spark, d), stored, res=0.5).select("scan_id", "point_id", "ground")


@register("image_model_ground")
def image_model_ground(spark, d):
    return D.image_model_ground(points(spark, d), _low_pixels, 64, 16, (1.2, 1.9)).select("scan_id", "point_id", "ground")


def _low_pixels(image):
    """The model shipped for tests: pixels whose lowest point is near the ground."""
    return (image[:, :, 1] < -1.5).astype(float)
