"""Nearest neighbours of point clouds of any size: cells over two axes, and rings of cells around a point.

Points fall into square cells; a cell with too many of them is halved along both axes until its parts fit,
so that a task's share follows a parameter and not the cloud.  One task looks for the neighbours of a
cell's points inside the cell.  Points whose k-th distance reaches beyond the cell then visit the cells around
them, found by descending from a coarse cell through the boxes of cells that lie within that distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators import kernels

#: Points of a cell aimed at, how many times as many make a cell hot, halvings beyond which no cell is cut.
FILL, HOT, DEPTH = 512, 4, 24
#: Rows of a table of cells up to which it is sent to all executors; beyond, it is shuffled.
SMALL = 200_000

CELL = ["grp", "level", "ix", "iy"]


def _maybe_broadcast(cells: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(cells) if rows <= SMALL else cells


def _near(table: pa.Table, dims: int, k: int) -> tuple[np.ndarray, ...]:
    """Query numbers, neighbours' ids and distances of one cell, and its queries' columns."""
    table = table.combine_chunks()
    candidate = table["candidate"].to_numpy(zero_copy_only=False).astype(bool)
    ids = table["node"].to_numpy()
    at = np.stack([table[f"c{i}"].to_numpy() for i in range(dims)], axis=1)
    q, p = np.flatnonzero(~candidate), np.flatnonzero(candidate)
    bound = table["bound"].to_numpy()[q]
    row, who, far = kernels.nearest_of(at[q], ids[q], at[p], ids[p], k, bound)
    return q, row, who, far


class Cells:
    """A cloud dealt to cells: `placed` has every point with its cell, `nodes` all cells and their ancestors."""

    def __init__(self, points: DataFrame, k: int, cut: Callable[[DataFrame], DataFrame], coords, group: str | None, node: str, fill: int):
        self.k, self.cut, self.dims, self.most = k, cut, len(coords), HOT * fill
        self.c = [f"c{i}" for i in range(self.dims)]
        grp = F.col(group).cast("long") if group else F.lit(0).cast("long")
        rows = points.select(grp.alias("grp"), F.col(node).cast("long").alias("node"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(coords)])
        # Of points on one spot, k + 1 are enough as neighbours of any point: those of the least ids.
        spot = Window.partitionBy("grp", *self.c).orderBy("node")
        rows = rows.withColumn("first", F.row_number().over(spot) <= k + 1)
        self.frames = self._frames(rows, fill)
        frames = _maybe_broadcast(self.frames, self.frames.count())
        u = [((F.col(c) - F.col(f"low{i}")) / F.col("size")).alias(f"u{i}") for i, c in enumerate(self.c[:2])]
        placed = rows.join(frames, "grp").select("grp", "node", "first", "size", "up", *self.c, *u)
        self.placed = cut(self._halved(placed, fill))
        self.leaves = cut(self._leaves())
        self.nodes = cut(self._nodes())
        self.n_leaves, self.n_nodes = self.leaves.count(), self.nodes.count()

    def _frames(self, rows: DataFrame, fill: int) -> DataFrame:
        """Lower corner, cell size and number of coarser levels of each group."""
        ends = [f(c).alias(f"{name}{i}") for i, c in enumerate(self.c[:2]) for f, name in ((F.min, "low"), (F.max, "high"))]
        wide = F.greatest(F.col("high0") - F.col("low0"), F.col("high1") - F.col("low1"))
        size = F.when(wide > 0, wide * F.sqrt(F.lit(float(fill)) / F.col("n"))).otherwise(F.lit(1.0))
        boxes = rows.groupBy("grp").agg(F.count("*").alias("n"), *ends).withColumn("size", size)
        up = F.ceil(F.log2(F.floor(wide / F.col("size")) + 2)).cast("int")
        return self.cut(boxes.select("grp", "low0", "low1", "size", up.alias("up")))

    @staticmethod
    def _cell(level: Column | int) -> list[Column]:
        scale = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))
        return [F.floor(F.col(f"u{i}") * scale).cast("long").alias(name) for i, name in enumerate(("ix", "iy"))]

    def _halved(self, placed: DataFrame, fill: int) -> DataFrame:
        """Hot cells cut at once into as many as an even spread of their points would need, and again while some are hot."""
        placed = placed.select("*", F.lit(0).alias("level"), *self._cell(0), F.lit(True).alias("fresh"))
        for depth in range(DEPTH):
            at = placed.where(F.col("first") & F.col("fresh")).groupBy(*CELL).agg(F.count("*").alias("n"))
            step = F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / fill) / 2)).cast("int")
            hot = self.cut(at.where((F.col("n") > self.most) & (F.col("level") < DEPTH)).select(*CELL, step.alias("step")))
            n = hot.count()
            if not n:
                break
            joined = placed.join(_maybe_broadcast(hot, n), CELL, "left").withColumn("fresh", F.col("step").isNotNull())
            joined = joined.withColumn("level", F.col("level") + F.coalesce("step", F.lit(0))).drop("step", "ix", "iy")
            placed = joined.select("*", *self._cell(F.col("level")))
            if depth % 2:
                placed = self.cut(placed)
        return placed.drop("fresh")

    def _leaves(self) -> DataFrame:
        boxes = [f(F.when(F.col("first"), F.col(c))).alias(f"{name}{i}") for i, c in enumerate(self.c) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        n = F.count(F.when(F.col("first"), 1)).alias("n")
        return self.placed.groupBy(*CELL).agg(F.first("up").alias("up"), n, F.count("*").alias("queries"), *boxes)

    def _nodes(self) -> DataFrame:
        every = self.leaves.withColumn("at", F.explode(F.sequence(-F.col("up"), F.col("level"))))
        moved = [F.expr(f"shiftright({i}, level - at)").alias(i) for i in ("ix", "iy")]
        boxes = [f(f"{name}{i}").alias(f"{name}{i}") for i in range(self.dims) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        kept = every.select("grp", "at", *moved, (F.col("at") == F.col("level")).alias("leaf"), "n", *[f"{e}{i}" for i in range(self.dims) for e in ("lo", "hi")])
        return kept.groupBy("grp", F.col("at").alias("level"), "ix", "iy").agg(F.max("leaf").alias("leaf"), F.sum("n").alias("n"), *boxes)

    def _dealt(self, queries: DataFrame, load: DataFrame) -> DataFrame:
        """Queries and candidates of each cell; cells with many queries are several tasks' work.

        `queries` has the cell, node, coordinates and bound; `load(cell, queries)` counts them.
        """
        parts = load.select(*CELL, F.ceil(F.col("queries") / self.most).cast("int").alias("parts"))
        parts = _maybe_broadcast(parts, self.n_leaves)
        asked = queries.join(parts, CELL).select(*CELL, F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", *self.c, "bound", F.lit(False).alias("candidate"))
        offered = self.placed.where("first").join(parts, CELL)
        offered = offered.select(*CELL, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", *self.c, F.lit(0.0).alias("bound"), F.lit(True).alias("candidate"))
        return asked.unionByName(offered)

    def inside(self) -> DataFrame:
        """Neighbours of every point inside its cell, one row a point: `near` by distance, `bound`, and whether that is all.

        `bound` is the k-th distance, null where the cell has no k others.
        """
        dims, k = self.dims, self.k
        side = F.col("size") / F.pow(F.lit(2.0), F.col("level"))
        f = [F.col(f"u{i}") * F.pow(F.lit(2.0), F.col("level")) - F.col(name) for i, name in enumerate(("ix", "iy"))]
        # What lies nearer than the cell's border is inside; a hair less, against rounding.
        margin = (F.least(*f, *[1 - x for x in f]) - 1e-9) * side
        queries = self.placed.select(*CELL, "node", *self.c, margin.alias("bound"))

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            q, row, who, far = _near(table.set_column(table.schema.get_field_index("bound"), "bound", pa.array(np.full(len(table), np.inf))), dims, k)
            table = table.combine_chunks()
            counts = np.bincount(row, minlength=len(q))
            ends = np.cumsum(counts)
            full = counts == k
            kth = np.full(len(q), np.inf)
            kth[full] = far[ends[full] - 1]
            offsets = pa.array(np.append(0, ends), pa.int32())
            asked = table.take(pa.array(q))
            names = [x.as_py() for x in key]
            out = {c: pa.array(np.full(len(q), names[i]), t) for i, (c, t) in enumerate(zip(CELL, (pa.int64(), pa.int32(), pa.int64(), pa.int64())))}
            out |= {"node": asked["node"]} | {f"c{i}": asked[f"c{i}"] for i in range(dims)}
            out["settled"] = pa.array(full & (kth < asked["bound"].to_numpy()))
            out["bound"] = pa.array(kth, mask=~full)
            out["dst"] = pa.ListArray.from_arrays(offsets, pa.array(who, pa.int64()))
            out["d"] = pa.ListArray.from_arrays(offsets, pa.array(far, pa.float64()))
            return pa.table(out)

        schema = "grp long, level int, ix long, iy long, node long, " + ", ".join(f"{c} double" for c in self.c)
        schema += ", settled boolean, bound double, dst array<long>, d array<double>"
        return self._dealt(queries, self.leaves).groupBy(*CELL, "part").applyInArrow(run, schema)

    def _bounded(self, open_: DataFrame) -> DataFrame:
        """Open queries with a distance that k others surely lie within; infinite where the group has no k others."""
        up = self.frames.select("grp", "low0", "low1", "size", "up")
        open_ = open_.join(_maybe_broadcast(up, self.n_leaves), "grp")
        lacking = open_.where("bound is null").drop("bound")
        every = lacking.withColumn("at", F.explode(F.sequence(-F.col("up"), F.col("level"))))
        every = every.select("grp", "node", *self.c, "at", *[F.expr(f"shiftright({i}, level - at)").alias(f"{i}_at") for i in ("ix", "iy")])
        nodes = self.nodes.where(F.col("n") > self.k).select("grp", F.col("level").alias("at"), F.col("ix").alias("ix_at"), F.col("iy").alias("iy_at"), *[f"{e}{i}" for i in range(self.dims) for e in ("lo", "hi")])
        found = every.join(_maybe_broadcast(nodes, self.n_nodes), ["grp", "at", "ix_at", "iy_at"])
        corner = [F.greatest(F.abs(F.col(c) - F.col(f"lo{i}")), F.abs(F.col(c) - F.col(f"hi{i}"))) for i, c in enumerate(self.c)]
        far = F.sqrt(sum((x * x for x in corner[1:]), corner[0] * corner[0]))
        least = found.groupBy("grp", "node").agg(F.min(far).alias("bound"))
        lacking = lacking.join(least, ["grp", "node"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        return open_.where("bound is not null").unionByName(lacking)

    def _visits(self, open_: DataFrame) -> DataFrame:
        """Open queries with each other cell whose box lies within their bound."""
        # A hair more, against rounding.
        reach = F.col("bound") * (1 + 1e-9)
        start = F.greatest(-F.col("up"), F.least(F.lit(0), F.floor(F.log2(F.col("size") / (2 * reach))).cast("int")))
        start = F.when(F.col("bound") == float("inf"), -F.col("up")).when(F.col("bound") == 0, 0).otherwise(start)
        asked = open_.select("grp", "node", *self.c, "bound", "size", "low0", "low1", "up", *[F.col(c).alias(f"own_{c}") for c in CELL[1:]], start.alias("level"))

        def span(i: int) -> Column:
            side = F.col("size") / F.pow(F.lit(2.0), F.col("level"))
            ends = [F.floor((F.col(f"c{i}") + s * reach - F.col(f"low{i}")) / side).cast("long") for s in (-1, 1)]
            last = F.expr("shiftleft(1L, up + level) - 1")
            low, high = F.greatest(F.lit(0).cast("long"), ends[0] - 1), F.least(last, ends[1] + 1)
            return F.when(F.col("bound") == float("inf"), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.sequence(low, high))

        front = asked.withColumn("ix", F.explode(span(0))).withColumn("iy", F.explode(span(1))).drop("size", "low0", "low1", "up")
        nodes = _maybe_broadcast(self.nodes.drop("n"), self.n_nodes)
        gaps = [F.greatest(F.col(f"lo{i}") - F.col(c), F.col(c) - F.col(f"hi{i}"), F.lit(0.0)) for i, c in enumerate(self.c)]
        near = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= reach * reach
        visits = None
        while True:
            met = self.cut(front.join(nodes, CELL).where(near).drop(*[f"{e}{i}" for i in range(self.dims) for e in ("lo", "hi")]))
            own = (F.col("level") == F.col("own_level")) & (F.col("ix") == F.col("own_ix")) & (F.col("iy") == F.col("own_iy"))
            leaves = met.where(F.col("leaf") & ~own).select(*CELL, "node", *self.c, "bound")
            visits = leaves if visits is None else visits.unionByName(leaves)
            inner = met.where(~F.col("leaf")).drop("leaf")
            if not inner.limit(1).count():
                return visits
            halves = F.array(F.lit(0), F.lit(1))
            front = inner.withColumn("a", F.explode(halves)).withColumn("b", F.explode(halves))
            front = front.withColumn("level", F.col("level") + 1).withColumn("ix", 2 * F.col("ix") + F.col("a")).withColumn("iy", 2 * F.col("iy") + F.col("b")).drop("a", "b")

    def around(self, open_: DataFrame) -> DataFrame:
        """`grp, src, dst, d`: neighbours of open queries in other cells, at most k a cell, none beyond the bound."""
        dims, k = self.dims, self.k
        visits = self.cut(self._visits(self._bounded(open_)))
        load = visits.groupBy(*CELL).agg(F.count("*").alias("queries"))

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            q, row, who, far = _near(table, dims, k)
            src = table.combine_chunks()["node"].to_numpy()[q[row]]
            grp = pa.array(np.full(len(row), key[0].as_py()), pa.int64())
            return pa.table({"grp": grp, "src": pa.array(src, pa.int64()), "dst": pa.array(who, pa.int64()), "d": pa.array(far, pa.float64())})

        return self._dealt(visits, load).groupBy(*CELL, "part").applyInArrow(run, "grp long, src long, dst long, d double")


#: Points aimed at in a part of a cloud; four times as many are cut by hash.
PART = 1 << 15


def cloud_parts(points: DataFrame, coords=("x", "y"), node: str = "point_id") -> DataFrame:
    """`node, part`: the points of one cloud in squares of about `PART` over two axes, so near points share a part."""
    rows = points.select(F.col(node).cast("long").alias("node"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(coords)])
    ends = [f(f"c{i}").alias(f"{name}{i}") for i in range(2) for f, name in ((F.min, "low"), (F.max, "high"))]
    box = rows.agg(F.count("*").alias("n"), *ends)
    wide = F.greatest(F.col("high0") - F.col("low0"), F.col("high1") - F.col("low1"))
    side = F.when(wide > 0, wide * F.sqrt(F.lit(float(PART)) / F.col("n"))).otherwise(F.lit(1.0))
    box = box.select("low0", "low1", side.alias("side"))
    at = rows.crossJoin(F.broadcast(box)).select("node", *[F.floor((F.col(f"c{i}") - F.col(f"low{i}")) / F.col("side")).cast("long").alias(name) for i, name in enumerate(("ix", "iy"))])
    split = at.groupBy("ix", "iy").agg(F.ceil(F.count("*") / (4 * PART)).cast("int").alias("split"))
    part = F.xxhash64("ix", "iy", F.when(F.col("split") > 1, F.pmod(F.xxhash64("node"), "split")).otherwise(F.lit(0).cast("long")))
    return at.join(split, ["ix", "iy"]).select("node", part.alias("part"))


def knn_cells(
    points: DataFrame, k: int, cut: Callable[[DataFrame], DataFrame], coords=("x", "y", "z"), group: str | None = "scan_id", node: str = "point_id", fill: int = FILL
) -> DataFrame:
    """`group, src, dst, d, rank`: the k nearest others of every point, exactly, ties to the lower id; no group need fit a task.

    Cells lie over the first two coordinates.  Without `group` all points are one cloud, as group 0 under
    the name `scan_id`.  Ids are unique inside a group and coordinates finite; groups of k points or less
    give all others, an empty table gives none.  `cut` materialises a DataFrame where all executors can
    read it (a checkpoint or a stored table).
    """
    cells = Cells(points, k, cut, coords, group, node, fill)
    inside = cut(cells.inside())
    listed = inside.select("grp", F.col("node").alias("src"), "settled", F.posexplode(F.arrays_zip("dst", "d")).alias("rank", "n"))
    listed = listed.select("grp", "src", F.col("n.dst").alias("dst"), F.col("n.d").alias("d"), (F.col("rank") + 1).cast("long").alias("rank"), "settled")
    open_ = inside.where(~F.col("settled")).drop("dst", "d", "settled")
    # Only points with neighbours beyond their cell are ranked anew.
    found = listed.where(~F.col("settled")).drop("settled", "rank").unionByName(cells.around(open_))
    rank = F.row_number().over(Window.partitionBy("grp", "src").orderBy("d", "dst")).cast("long")
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    ranked = listed.where("settled").drop("settled").unionByName(found)
    return ranked.withColumnRenamed("grp", group or "scan_id")
