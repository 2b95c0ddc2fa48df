"""Edits of trees of any size: nodes added, renumbered, and their depths by doubled steps.

A tree is rows of tree_id, node_id and parent; a root's parent is null, negative or no node of the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.ordered import Cut, ranked


def add_nodes(tree: DataFrame, new: DataFrame, cut: Cut) -> DataFrame:
    """The tree with the nodes of `new` (tree_id, parent and any of the tree's other columns), numbered on from its largest id.

    New nodes of one tree are numbered by their parents (null first) and then by their other columns; a tree that was
    not there starts at 0.  Columns that `new` lacks are null.  A parent need not be there: the node is a root then.
    """
    top = tree.groupBy("tree_id").agg(F.max("node_id").alias("__top"))
    given = [c for c in tree.columns if c in new.columns and c not in ("tree_id", "node_id")]
    others = [F.col(c) for c in given if c != "parent" and "map" not in dict(new.dtypes)[c]]
    placed = ranked(new.select("tree_id", *given), ["tree_id"], [F.col("parent"), *others], cut, "__place")
    numbered = placed.join(top, "tree_id", "left").withColumn("node_id", F.coalesce("__top", F.lit(-1)) + F.col("__place"))
    return tree.unionByName(numbered.select("tree_id", "node_id", *given), allowMissingColumns=True)


def tree_depths(tree: DataFrame, cut: Cut) -> DataFrame:
    """`tree_id, node_id, depth`: steps from every node to its root, 0 for a root.

    Each round doubles the way that a node has climbed, so a chain of n nodes takes log2 n joins, no task holds a
    tree, and no table of all ancestors is made.  `cut` stores each round.  Parents that run in a circle are an error.
    """
    nodes = tree.select("tree_id", "node_id", F.col("parent").alias("up"))
    known = nodes.select("tree_id", F.col("node_id").alias("up"), F.lit(1).alias("held"))
    rows = nodes.where("up <> node_id").join(known, ["tree_id", "up"], "left_semi").select("tree_id", "node_id", "up", F.lit(1).cast("long").alias("depth"))
    roots = nodes.join(rows.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti").select("tree_id", "node_id", F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("depth"))
    rows = cut(rows.unionByName(roots))
    # What still climbs after as many steps as there are nodes runs in a circle.
    for _ in range(rows.count().bit_length() + 1):
        if rows.where("up is not null").isEmpty():
            return rows.select("tree_id", "node_id", "depth")
        above = rows.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"))
        joined = rows.join(above, ["tree_id", "up"], "left")
        rows = cut(joined.select("tree_id", "node_id", F.col("__up").alias("up"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth")))
    raise ValueError("the parents run in a circle")


def renumber(tree: DataFrame, cut: Cut, levels: bool = False) -> DataFrame:
    """The tree with ids from 0 without gaps, parents (-1 for roots) to match, and `depth`.

    Nodes keep the order of their old ids; with `levels` they go by depth first, so a root is 0 and every level follows
    the one above.  Other columns stay.  An id that occurs twice in a tree is an error.
    """
    tree = cut(tree)
    if not tree.groupBy("tree_id", "node_id").count().where("count > 1").isEmpty():
        raise ValueError("an id occurs twice in a tree")
    deep = tree.drop("depth").join(tree_depths(tree, cut), ["tree_id", "node_id"])
    order = [F.col("depth"), F.col("node_id")] if levels else [F.col("node_id")]
    placed = ranked(deep, ["tree_id"], order, cut, "__place")
    names = placed.select("tree_id", F.col("node_id").alias("parent"), (F.col("__place") - 1).alias("__parent"))
    joined = placed.join(names, ["tree_id", "parent"], "left")
    out = joined.withColumn("node_id", F.col("__place") - 1).withColumn("parent", F.when(F.col("depth") > 0, F.col("__parent")).otherwise(F.lit(-1)))
    return out.select(*[c for c in tree.columns if c != "depth"], "depth")
