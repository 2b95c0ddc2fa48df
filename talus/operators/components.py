"""Components and spanning forests of graphs that span many tasks.

Forests of graphs whose nodes lie in space start inside parts of it.  Components come from alternating large and small stars.  Both steps relink every node to the least id that it sees; a round costs a few
shuffles of the remaining edges and the rounds grow with the logarithm of the
component size.  Edges are aggregated to one minimum per node before anything
is joined, so a node of very many neighbours costs no more than its rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators import kernels


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of a set of edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def star_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], most_rounds: int = 60) -> DataFrame:
    """`node, component` for every node of `edges(u, v)`; component is its least node id.

    `cut` materialises a DataFrame where all executors can read it (a checkpoint
    or a stored table): each round starts from there.  Loops and repeated edges
    are harmless, an empty input gives no row.
    """
    # Read twice: edges may be the result of long work.
    edges = cut(edges.select("u", "v"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
        now = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = _mark(now)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )


def _contracted(chosen: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`node, root` of every node of `chosen(c, p)`, where each node c points to p and two may point to each other.

    Of such a pair the lower one becomes the root; every node then points to where its target points,
    which halves its way in each round.
    """
    back = chosen.select(F.col("c").alias("p"), F.col("p").alias("c"), F.lit(True).alias("mutual"))
    target = F.when(F.col("mutual") & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p"))
    now = cut(chosen.join(back, ["c", "p"], "left").select("c", target.alias("p")))
    while True:
        ahead = now.select(F.col("c").alias("p"), F.col("p").alias("q"))
        after = cut(now.join(ahead, "p").select("c", "p", "q"))
        if not after.where("p <> q").limit(1).count():
            return after.select(F.col("c").alias("node"), F.col("q").alias("root"))
        now = after.select("c", F.col("q").alias("p"))


def _local_forest(table: pa.Table) -> pa.Table:
    """Kind 0: edges of the forest that a part finds by itself; 1: edges between its components; 2: edges that leave it.

    `a` and `b` are the components, `b` null where an edge leaves the part.
    """
    own, other, w, inner = (table.column(c).to_numpy(zero_copy_only=False) for c in ("own", "other", "w", "inner"))
    order = np.lexsort((np.maximum(own, other), np.minimum(own, other), w))
    own, other, w, inner = own[order], other[order], w[order], inner[order].astype(bool)
    nodes = np.unique(np.concatenate([own, other[inner]]))
    src, dst = np.searchsorted(nodes, own), np.where(inner, np.searchsorted(nodes, other), -1)
    won, label = kernels.local_forest(len(nodes), src, dst)
    a = nodes[label[src]]
    b = np.where(inner, nodes[label[dst]], 0)
    rest = np.flatnonzero(~inner | (a != b))
    row = np.concatenate([won, rest])
    kind = np.concatenate([np.zeros(len(won), np.int32), np.where(inner[rest], 1, 2).astype(np.int32)])
    u, v = np.minimum(own, other)[row], np.maximum(own, other)[row]
    return pa.table({"kind": kind, "u": u, "v": v, "w": w[row], "a": a[row], "b": pa.array(b[row], mask=~inner[row])})


def _contracted_parts(plain: DataFrame, parts: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Forest edges that parts find by themselves, and the edges `a, b, e` between what they have contracted."""
    pu, pv = (parts.select(F.col("node").cast("long").alias(c), F.col("part").alias(f"p{c}")).hint("merge") for c in "uv")
    # A node without a part is one of its own.
    alone = lambda c: F.coalesce(f"p{c}", -1 - F.col(c))
    at = plain.join(pu, "u", "left").join(pv, "v", "left").select("u", "v", "w", alone("u").alias("pu"), alone("v").alias("pv"))
    there = F.struct(F.col("pu").alias("part"), F.col("u").alias("own"), F.col("v").alias("other"))
    back = F.struct(F.col("pv").alias("part"), F.col("v").alias("own"), F.col("u").alias("other"))
    inner = F.col("pu") == F.col("pv")
    rows = at.select("w", inner.alias("inner"), F.explode(F.when(inner, F.array(there)).otherwise(F.array(there, back))).alias("r"))
    rows = rows.select("r.part", "r.own", "r.other", F.col("w").cast("double").alias("w"), "inner")
    found = cut(rows.groupBy("part").applyInArrow(_local_forest, "kind int, u long, v long, w double, a long, b long"))
    # Both parts of an edge between them give its end's component.
    across = found.where("kind = 2").groupBy("u", "v", "w").agg(F.min("a").alias("a"), F.max("a").alias("b"))
    rest = found.where("kind = 1").select("u", "v", "w", "a", "b").unionByName(across)
    least = rest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
    return found.where("kind = 0").select("u", "v", "w"), cut(least)


def global_spanning_forest(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], parts: DataFrame | None = None) -> DataFrame:
    """`u, v, w` (u < v) of the minimum spanning forest of one graph that spans many tasks.

    Ids are integers; of equal weights the edge of the lower ends goes first, so the forest is the one
    that takes edges by weight and ends.  Each round every component picks its least outward edge by
    one aggregate, the picks join the forest, components are contracted, and of parallel edges the least
    stays; the number of components at least halves.  Loops, repeated edges and edges of null weight
    are harmless, a node without an edge is in no row, an empty input gives none.

    With `parts(node, part)`, where nodes of a part fit a task, every part first does these rounds by itself until the
    least outward edge of each of its components leaves it; only what is left is shuffled round by round.  The forest
    is the same whatever the parts; near nodes in one part leave least.
    """
    ends = [F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")]
    plain = edges.where((F.col("u") != F.col("v")) & F.col("w").isNotNull()).select(*ends, "w")
    least = plain.groupBy("u", "v").agg(F.min("w").alias("w"))
    if parts is None:
        forest, now = None, cut(least.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e")))
    else:
        forest, now = _contracted_parts(least, parts, cut)
    while now.limit(1).count():
        both = now.select(F.col("a").alias("c"), F.col("b").alias("p"), "e").unionByName(now.select(F.col("b").alias("c"), F.col("a").alias("p"), "e"))
        picked = cut(both.groupBy("c").agg(F.min(F.struct("e", "p")).alias("least")).select("c", "least.p", "least.e"))
        # Both ends may have picked one edge; no other edge is picked twice.
        won = picked.select("e.u", "e.v", "e.w").distinct()
        forest = won if forest is None else forest.unionByName(won)
        roots = _contracted(picked.select("c", "p"), cut)
        a = now.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        ab = a.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        now = cut(ab.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e")))
    return plain.limit(0) if forest is None else forest
