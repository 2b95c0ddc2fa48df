"""Cluster hierarchies: linkage, cuts, ancestors, costs and losses.

A tree is (tree_id, node_id, parent, height, size); leaves are the items, parents come by merges.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators import kernels


def pairs(items: DataFrame, columns: list[str], tree: str = "tree_id", node: str = "id") -> DataFrame:
    """Every pair a < b of a tree's items, with the given columns as a_ and b_; trees are small, pairs stay inside one."""
    a = items.select(tree, F.col(node).alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = items.select(tree, F.col(node).alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, tree).where(F.col("a") < F.col("b"))


def triplets(items: DataFrame, columns: list[str], tree: str = "tree_id", node: str = "id", cls: str = "cls") -> DataFrame:
    """Anchor a < positive p of one class with every negative n of another class of the tree."""
    same = pairs(items, [cls, *columns], tree, node).where(F.col(f"a_{cls}") == F.col(f"b_{cls}")).withColumnRenamed("b", "p")
    n = items.select(tree, F.col(node).alias("n"), F.col(cls).alias("n_cls"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return same.join(n, tree).where(F.col("n_cls") != F.col(f"a_{cls}"))


def single_linkage(weighted: DataFrame, tree: str = "tree_id") -> DataFrame:
    """`tree_id, step, left, right, dist, cnt` from pair distances (tree_id, a, b, w); merge k makes node n + k.

    Items are numbered by rank of id inside their tree.
    """

    def run(table: pa.Table) -> pa.Table:
        a, b, w = np.asarray(table.column("a")), np.asarray(table.column("b")), np.asarray(table.column("w"))
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        z = kernels.merge_tree(len(nodes), flat[: len(a)], flat[len(a) :], w)
        n = len(z)
        return pa.table(
            {
                "tree_id": pa.array(np.full(n, np.asarray(table.column("tree_id"))[0]), pa.int64()), "step": pa.array(np.arange(n), pa.int32()),
                "left": pa.array(z[:, 0].astype(np.int64)), "right": pa.array(z[:, 1].astype(np.int64)), "dist": pa.array(z[:, 2].copy()), "cnt": pa.array(z[:, 3].astype(np.int64)),
            }
        )

    rows = weighted.select(F.col(tree).cast("long").alias("tree_id"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w"))
    return rows.groupBy("tree_id").applyInArrow(run, "tree_id long, step int, left long, right long, dist double, cnt long")


def linkage_cuts(weighted: DataFrame, ks: list[int] | str) -> DataFrame:
    """`tree_id, k, id, cc`: the clusters left when the k - 1 last merges are dropped, named by their least id.

    `ks` are the numbers of clusters, or the column with the greatest of each tree, from 1 on.
    """

    def run(table: pa.Table) -> pa.Table:
        a, b, w = np.asarray(table.column("a")), np.asarray(table.column("b")), np.asarray(table.column("w"))
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        n, src, dst = len(nodes), flat[: len(a)], flat[len(a) :]
        kept, _ = kernels.spanning_tree(n, src, dst, w)
        tried = list(range(1, table.column("most")[0].as_py() + 1)) if isinstance(ks, str) else ks
        out = []
        for k in tried:
            some = np.array(kept[: max(n - k, 0)], np.int64)
            out.append(nodes[kernels.components(n, src[some], dst[some])])
        return pa.table(
            {
                "tree_id": pa.array(np.full(n * len(tried), np.asarray(table.column("tree_id"))[0]), pa.int64()), "k": pa.array(np.repeat(tried, n), pa.int32()),
                "id": pa.array(np.tile(nodes, len(tried)), pa.int64()), "cc": pa.array(np.concatenate(out), pa.int64()),
            }
        )

    most = [F.col(ks).cast("int").alias("most")] if isinstance(ks, str) else []
    rows = weighted.select("tree_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w"), *most)
    return rows.groupBy("tree_id").applyInArrow(run, "tree_id long, k int, id long, cc long")


def linkage_tree(linkage: DataFrame, sizes: DataFrame) -> DataFrame:
    """The tree (tree_id, node_id, parent, height, size) of a linkage; `sizes`: tree_id, n items."""
    z = linkage.join(sizes, "tree_id").withColumn("node", F.col("n") + F.col("step"))
    children = z.select("tree_id", F.explode(F.array("left", "right")).alias("node_id"), F.col("node").alias("parent"))
    inner = z.select("tree_id", F.col("node").alias("node_id"), F.col("dist").alias("height"), F.col("cnt").alias("size"))
    leaves = sizes.select("tree_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("node_id"), F.lit(0.0).alias("height"), F.lit(1).cast("long").alias("size"))
    return inner.unionByName(leaves).join(children, ["tree_id", "node_id"], "left").select("tree_id", "node_id", F.coalesce("parent", F.lit(-1)).alias("parent"), "height", "size")


def ancestors(tree: DataFrame) -> DataFrame:
    """`tree_id, node_id, ancestor, steps` including the node itself; one task walks up one tree, all nodes at once."""

    def run(table: pa.Table) -> pa.Table:
        ids, parent = np.asarray(table.column("node_id")), np.asarray(table.column("parent"))
        order = np.argsort(ids)
        ids, parent = ids[order], parent[order]
        up = np.where(parent >= 0, np.searchsorted(ids, parent), -1)
        node, at, steps, out = np.arange(len(ids)), np.arange(len(ids)), 0, []
        while len(node):
            out.append((node, at, np.full(len(node), steps)))
            above = up[at]
            node, at, steps = node[above >= 0], above[above >= 0], steps + 1
            if steps > len(ids):
                raise ValueError("the parents run in a circle")
        node, at, far = (np.concatenate(x) for x in zip(*out))
        scan = np.full(len(node), np.asarray(table.column("tree_id"))[0])
        return pa.table({"tree_id": pa.array(scan, pa.int64()), "node_id": pa.array(ids[node]), "ancestor": pa.array(ids[at]), "steps": pa.array(far.astype(np.int64))})

    rows = tree.select(*[F.col(c).cast("long").alias(c) for c in ("tree_id", "node_id", "parent")])
    return rows.groupBy("tree_id").applyInArrow(run, "tree_id long, node_id long, ancestor long, steps long")


def _forest(table: pa.Table) -> tuple[np.ndarray, kernels.CommonAncestors]:
    """Ids of a tree's nodes in ascending order, and their ancestors by number."""
    ids, parent = table.column("node_id").to_numpy(), table.column("parent").to_numpy()
    order = np.argsort(ids)
    ids, parent = ids[order], parent[order]
    return ids, kernels.CommonAncestors(np.where(parent >= 0, np.searchsorted(ids, parent), -1))


def depths(tree: DataFrame) -> DataFrame:
    """Steps of every node to its root; one task a tree."""

    def run(table: pa.Table) -> pa.Table:
        ids, forest = _forest(table)
        return pa.table({"tree_id": pa.array(np.full(len(ids), table.column("tree_id")[0].as_py()), pa.int64()), "node_id": ids, "depth": forest.depth()})

    rows = tree.select(*[F.col(c).cast("long").alias(c) for c in ("tree_id", "node_id", "parent")])
    return rows.groupBy("tree_id").applyInArrow(run, "tree_id long, node_id long, depth long")


#: Questions on one tree that a task answers.
QUESTIONS = 1 << 20


def lowest_common(queries: DataFrame, tree: DataFrame) -> DataFrame:
    """`queries(tree_id, a, b, ...)` with their lowest common ancestor `lca`; those of nodes without one are left out.

    A task holds one tree with its table of stretches, n log n; a tree with very many questions goes to several.
    """
    load = queries.groupBy("tree_id").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("parts"))
    pairs = queries.select("tree_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    part = F.pmod(F.xxhash64("a", "b"), "parts").cast("int").alias("part")
    asked = pairs.join(load, "tree_id").select(F.col("tree_id").cast("long").alias("tree_id"), part, "a", "b")
    nodes = tree.join(load, "tree_id").select(
        F.col("tree_id").cast("long").alias("tree_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.col("node_id").cast("long").alias("node_id"), F.col("parent").cast("long").alias("parent"),
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        ids, forest = _forest(right)
        if not len(ids) or not len(a):
            return pa.table({c: pa.array([], pa.int64()) for c in ("tree_id", "a", "b", "lca")})
        at = [np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (a, b)]
        known = (ids[at[0]] == a) & (ids[at[1]] == b)
        a, b, at = a[known], b[known], [x[known] for x in at]
        lca = forest.of(*at)
        met = lca >= 0
        tree_id = pa.array(np.full(int(met.sum()), right.column("tree_id")[0].as_py()), pa.int64())
        return pa.table({"tree_id": tree_id, "a": a[met], "b": b[met], "lca": ids[lca[met]]})

    found = asked.groupBy("tree_id", "part").cogroup(nodes.groupBy("tree_id", "part")).applyInArrow(run, "tree_id long, a long, b long, lca long")
    return queries.join(found, ["tree_id", "a", "b"]).select(*queries.columns, "lca")


def partition_tree(edges: DataFrame) -> DataFrame:
    """The binary partition tree of each weighted graph (tree_id, a, b, w), sparse or whole: one row a node.

    `tree_id, node_id, parent, height, size, least, id`: leaves 0 to n - 1 are the ends in ascending order,
    with their `id`; merge k, by weight and ends, makes node n + k, whose height is the weight and whose `least`
    is the size of its smaller child.  A graph of several components gives a forest of as many roots.
    """

    def run(table: pa.Table) -> pa.Table:
        a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
        ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        n = len(ids)
        low, high = np.minimum(flat[: len(a)], flat[len(a) :]), np.maximum(flat[: len(a)], flat[len(a) :])
        order = np.lexsort((high, low, w))
        z = kernels.merge_tree(n, low[order], high[order], w[order])
        m = len(z)
        parent = np.full(n + m, -1, np.int64)
        pairs = z[:, :2].astype(np.int64)
        parent[pairs[:, 0]] = parent[pairs[:, 1]] = np.arange(n, n + m)
        size = np.concatenate([np.ones(n, np.int64), z[:, 3].astype(np.int64)])
        inner = np.arange(n + m) < n
        return pa.table(
            {
                "tree_id": pa.array(np.full(n + m, table.column("tree_id")[0].as_py()), pa.int64()), "node_id": np.arange(n + m), "parent": parent,
                "height": np.concatenate([np.zeros(n), z[:, 2]]), "size": size,
                "least": pa.array(np.concatenate([np.zeros(n, np.int64), size[pairs].min(1)]), mask=inner), "id": pa.array(np.append(ids, np.zeros(m, np.int64)), pa.int64(), mask=~inner),
            }
        )

    rows = edges.where("a <> b and w is not null").select(*[F.col(c).cast("long").alias(c) for c in ("tree_id", "a", "b")], F.col("w").cast("double").alias("w"))
    return rows.groupBy("tree_id").applyInArrow(run, "tree_id long, node_id long, parent long, height double, size long, least long, id long")


def ultrametric(queries: DataFrame, tree: DataFrame) -> DataFrame:
    """Pairs of items (tree_id, a, b, ...) with `u`, the height of their common ancestor in a `partition_tree`, its `size` and `least`.

    Pairs of different roots, or of items that no edge holds, are left out.
    """
    leaf = tree.where("id is not null").select("tree_id", "id", "node_id")
    placed = queries.join(leaf.withColumnsRenamed({"id": "a", "node_id": "__a"}), ["tree_id", "a"]).join(leaf.withColumnsRenamed({"id": "b", "node_id": "__b"}), ["tree_id", "b"])
    asked = placed.select("tree_id", F.col("__a").alias("a"), F.col("__b").alias("b")).distinct()
    met = lowest_common(asked, tree).withColumnsRenamed({"a": "__a", "b": "__b"})
    heights = tree.select("tree_id", F.col("node_id").alias("lca"), F.col("height").alias("u"), "size", "least")
    return placed.join(met, ["tree_id", "__a", "__b"]).join(heights, ["tree_id", "lca"]).select(*queries.columns, "u", "size", "least")


def dasgupta_cost(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Sum over edges (tree_id, a, b, w) of w times the number of leaves under the ends' common ancestor."""
    met = lowest_common(edges, tree).join(tree.select("tree_id", F.col("node_id").alias("lca"), "size"), ["tree_id", "lca"])
    return met.groupBy("tree_id").agg(F.sum(F.col("w") * F.col("size")).alias("cost"))


def closest_loss(u: Column, w: Column) -> Column:
    return F.avg((u - w) * (u - w))


def triplet_loss(d_pos: Column, d_neg: Column, margin: float) -> Column:
    return F.avg(F.greatest(F.lit(0.0), d_pos - d_neg + F.lit(margin)))


def cluster_size_loss(u: Column, least_area: Column) -> Column:
    return F.max(u / least_area)


def combined_loss(first: Column, *others: Column, gamma: float = 1.0) -> Column:
    """A loss plus `gamma` times each of the others: cluster size with triplets, closest with either or with both."""
    out = first
    for other in others:
        out = out + F.lit(float(gamma)) * other
    return out


def angle(a: list[Column], b: list[Column]) -> Column:
    """Angle between two vectors, as the metric of a linkage of unit vectors; null where one is zero."""
    product, square_a, square_b = (sum((x * y for x, y in zip(u[1:], v[1:])), u[0] * v[0]) for u, v in ((a, b), (a, a), (b, b)))
    length = F.sqrt(square_a) * F.sqrt(square_b)
    cosine = product / F.nullif(length, F.lit(0.0))
    return F.when(length != 0, F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def delete_node(tree: DataFrame, node: int) -> DataFrame:
    """The tree without a node, whose children move to its parent."""
    gone = tree.where(F.col("node_id") == node).select("tree_id", F.col("parent").alias("heir"))
    return tree.where(F.col("node_id") != node).join(gone, "tree_id", "left").withColumn(
        "parent", F.when(F.col("parent") == node, F.coalesce("heir", "parent")).otherwise(F.col("parent"))
    ).drop("heir")
