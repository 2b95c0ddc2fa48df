"""Weighted graphs: neighbour joins, unions, thresholds, components, spanning trees, image graphs.

Edges are (scan_id, src, dst, w); node ids are point ids or pixel numbers and keep their meaning.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.geometry import logistic
from talus.operators import kernels
from talus.operators.raster import join_pixels

EDGE = ["scan_id", "src", "dst"]
#: Distances of each row of one array to each row of another.
Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]

# ---- nearest neighbours --------------------------------------------------------------------------


def knn(points: DataFrame, k: int, coords=("x", "y", "z"), group: str = "scan_id", node: str = "point_id", loop: bool = False, metric: Metric | None = None) -> DataFrame:
    """`group, src, dst, d, rank`: the k nearest others of every point in its group, ties to the lower id.

    One task works on one group (a scan), with a sweep along the first axis instead of all pairs; groups of
    any size are for `talus.operators.cells`.
    With `loop` the point itself counts as one of the k, at distance 0.  Another `metric` than the
    Euclidean takes a block of points and all of them and returns their distances, all pairs by blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("node"))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        p = np.stack([np.asarray(table.column(f"c{i}")) for i in range(len(coords))], axis=1)[order]
        who, far = kernels.nearest(p, k) if metric is None else kernels.nearest_by(p, k, metric)
        if loop:
            who = np.concatenate([np.arange(len(p))[:, None], who], axis=1)
            far = np.concatenate([np.zeros((len(p), 1)), far], axis=1)
            # Other points at distance 0 may have lower ids.
            near = np.lexsort((who, far))[:, :k]
            who, far = np.take_along_axis(who, near, 1), np.take_along_axis(far, near, 1)
        n, m = who.shape
        return pa.table(
            {
                "grp": pa.array(np.full(n * m, np.asarray(table.column("grp"))[0] if n else 0), pa.int64()),
                "src": pa.array(np.repeat(ids, m), pa.int64()),
                "dst": pa.array(ids[who.ravel()], pa.int64()),
                "d": pa.array(far.ravel(), pa.float64()),
                "rank": pa.array(np.tile(np.arange(1, m + 1), n), pa.int64()),
            }
        )

    rows = points.select(F.col(group).cast("long").alias("grp"), F.col(node).cast("long").alias("node"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(coords)])
    out = rows.groupBy("grp").applyInArrow(run, "grp long, src long, dst long, d double, rank long")
    return out.withColumnRenamed("grp", group)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, with the larger weight where both were there."""
    back = edges.select("scan_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    # Shuffled first: edges hardly repeat, and a task that finds them would hold all of its own for nothing.
    return edges.select(*EDGE, "w").unionByName(back).repartition(*EDGE).groupBy(*EDGE).agg(F.max("w").alias("w"))


def knn_graph(points: DataFrame, k: int, weighted: bool = False) -> DataFrame:
    """The symmetric k-NN graph, of weight 1 or the distance."""
    w = F.col("d") if weighted else F.lit(1.0)
    return symmetric(knn(points, k).select(*EDGE, w.alias("w")))


def with_ends(edges: DataFrame, nodes: DataFrame, columns: list[str], node: str = "point_id") -> DataFrame:
    """Edges with the given node columns of both ends, as s_<column> and d_<column>."""
    s = nodes.select("scan_id", F.col(node).alias("src"), *[F.col(c).alias(f"s_{c}") for c in columns])
    d = nodes.select("scan_id", F.col(node).alias("dst"), *[F.col(c).alias(f"d_{c}") for c in columns])
    return edges.join(s, ["scan_id", "src"]).join(d, ["scan_id", "dst"])


def spherical_edges(
    pixels: DataFrame, width: int, far: float = 5.0, near: float = 1.0, same: float = 0.5, dz: float = 0.5, steps: int = 5,
    metric: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Edges between points of neighbouring pixels of a range image, both directions, weight the distance.

    Below: the pixel one row down, closer than `far`.  Right: up to `steps` columns on, around the
    image, closer than `near`, all matches of the first pixel that has any.  Same pixel: closer
    than `same`.  Always with a height difference below `dz`.  One task works on one scan; `metric`
    gives other weights than the distance from arrays of both ends' coordinates.
    """

    def run(table: pa.Table) -> pa.Table:
        scan = np.asarray(table.column("scan_id"))[0]
        ids, row, col = (np.asarray(table.column(c)).astype(np.int64) for c in ("point_id", "row", "col"))
        p = np.stack([np.asarray(table.column(c)) for c in "xyz"], axis=1)
        at, n, src, dst, w = kernels.pixel_edges(ids, row, col, p, width, far, near, same, dz, steps), len(ids), [], [], []
        for a, b, d in at:
            d = d if metric is None else metric(p[a], p[b])
            src += [a, b]
            dst += [b, a]
            w += [d, d]
        src, dst, w = (np.concatenate(x) for x in (src, dst, w))
        # An edge found in both directions keeps the larger weight.
        order = np.lexsort((-w, dst, src))
        src, dst, w = src[order], dst[order], w[order]
        first = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))[: len(src)]
        src, dst, w = src[first], dst[first], w[first]
        return pa.table({"scan_id": pa.array(np.full(len(src), scan), pa.int64()), "src": ids[src], "dst": ids[dst], "w": pa.array(w, pa.float64())})

    rows = pixels.where(F.col("row") >= 0).select(F.col("scan_id").cast("long").alias("scan_id"), "point_id", "row", "col", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return rows.groupBy("scan_id").applyInArrow(run, "scan_id long, src long, dst long, w double")


def merge_graphs(*graphs: DataFrame) -> DataFrame:
    """Union of weighted graphs: the greatest positive plus the least negative weight of every edge."""
    every = graphs[0].select(*EDGE, "w")
    for g in graphs[1:]:
        every = every.unionByName(g.select(*EDGE, "w"))
    w = F.max(F.greatest("w", F.lit(0.0))) + F.min(F.least("w", F.lit(0.0)))
    return every.repartition(*EDGE).groupBy(*EDGE).agg(w.alias("w"))


def height_ratio(low: Column) -> Column:
    """Height over the scan's lowest point, divided by a logistic of the normal's |nz|."""
    return (F.col("z") - low) / logistic(F.abs(F.col("nz")), 0.7, 1.0, 32.0)


def height_weights(edges: DataFrame, points: DataFrame, normals: DataFrame | None = None, how: str = "diff") -> DataFrame:
    """Weights from heights over the scan's lowest point, divided by a logistic of the normal's |nz|; diff, max or min."""
    low = points.groupBy("scan_id").agg(F.min("z").alias("__low"))
    nodes = points.join(low, "scan_id")
    if normals is not None:
        nodes = nodes.join(normals.select("scan_id", "point_id", "nz"), ["scan_id", "point_id"])
    ends = with_ends(edges.select(*EDGE), nodes.select("scan_id", "point_id", height_ratio(F.col("__low")).alias("r")), ["r"])
    s, d = F.col("s_r"), F.col("d_r")
    w = {"diff": F.abs(s - d), "max": F.greatest(s, d), "min": F.least(s, d)}[how]
    return ends.select(*EDGE, w.alias("w"))


# ---- subsets -------------------------------------------------------------------------------------


def threshold_edges(edges: DataFrame, threshold: float, metric: str = "distance") -> DataFrame:
    """Distances below the threshold, or similarities at or above it."""
    if metric not in ("distance", "similarity"):
        raise ValueError("metric is distance or similarity")
    return edges.where(F.col("w") < threshold if metric == "distance" else F.col("w") >= threshold)


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among `nodes(scan_id, node_id)`."""
    # Stored nodes pack so well that a row a point passes for a small side.
    keep = nodes.select("scan_id", "node_id").distinct().hint("merge")
    once = edges.join(keep.withColumnRenamed("node_id", "src"), ["scan_id", "src"], "left_semi")
    return once.join(keep.withColumnRenamed("node_id", "dst"), ["scan_id", "dst"], "left_semi").select(*EDGE, "w")


def renumbered(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph of `nodes(scan_id, node_id)` with nodes numbered from 0 in order of id, and the map
    `scan_id, node_id, number`."""
    order = Window.partitionBy("scan_id").orderBy("node_id")
    numbers = nodes.select("scan_id", "node_id").distinct().withColumn("number", (F.row_number().over(order) - 1).cast("long"))
    s = numbers.select("scan_id", F.col("node_id").alias("src"), F.col("number").alias("s"))
    d = numbers.select("scan_id", F.col("node_id").alias("dst"), F.col("number").alias("d"))
    inside = edges.join(s, ["scan_id", "src"]).join(d, ["scan_id", "dst"])
    return inside.select("scan_id", F.col("s").alias("src"), F.col("d").alias("dst"), "w"), numbers


def window_subgraph(edges: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Edges of an image graph (row, col, row2, col2) with both pixels in the rows and columns [from, to)."""
    inside = lambda r, c: (F.col(r) >= rows[0]) & (F.col(r) < rows[1]) & (F.col(c) >= cols[0]) & (F.col(c) < cols[1])
    return edges.where(inside("row", "col") & inside("row2", "col2"))


def positive_degree(edges: DataFrame) -> DataFrame:
    """Nodes with an edge of weight other than 0."""
    used = edges.where(F.col("w") != 0)
    return used.select("scan_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def resize(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the classes of their ends (`labels`: scan_id, node_id, cc), weights summed."""
    s = labels.select("scan_id", F.col("node_id").alias("src"), F.col("cc").alias("s"))
    d = labels.select("scan_id", F.col("node_id").alias("dst"), F.col("cc").alias("d"))
    joined = edges.join(s, ["scan_id", "src"]).join(d, ["scan_id", "dst"])
    return joined.groupBy("scan_id", F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w"))


def forest_level(stable: DataFrame, unstable: DataFrame, level: int) -> DataFrame:
    """Stable edges and unstable ones (with `level`) up to a level, weights summed."""
    some = unstable.where(F.col("level") <= level).select(*EDGE, "w")
    return stable.select(*EDGE, "w").unionByName(some).groupBy(*EDGE).agg(F.sum("w").alias("w"))


def undirected(edges: DataFrame) -> DataFrame:
    """Every pair of ends once, the lower first, with the least weight."""
    pairs = edges.select("scan_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return pairs.repartition(*EDGE).groupBy(*EDGE).agg(F.min("w").alias("w"))


# ---- components and trees ------------------------------------------------------------------------


def _grouped_edges(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    src, dst = np.asarray(table.column("src")), np.asarray(table.column("dst"))
    nodes, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return np.asarray(table.column("scan_id"))[0], nodes, flat[: len(src)], flat[len(src) :], np.asarray(table.column("w"))


def _labels(table: pa.Table) -> pa.Table:
    scan, nodes, src, dst, w = _grouped_edges(table)
    cc = nodes[kernels.components(len(nodes), src, dst)]
    return pa.table({"scan_id": pa.array(np.full(len(nodes), scan), pa.int64()), "node_id": pa.array(nodes, pa.int64()), "cc": pa.array(cc, pa.int64())})


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """`scan_id, node_id, cc`: the least node of every node's component, one scan a task.

    Nodes (scan_id, node_id) without an edge are components of their own.  One graph that spans
    many tasks is for `talus.operators.components`.
    """
    rows = edges.select(*[F.col(c).cast("long").alias(c) for c in EDGE], F.col("w").cast("double").alias("w"))
    found = rows.groupBy("scan_id").applyInArrow(_labels, "scan_id long, node_id long, cc long")
    if nodes is None:
        return found
    # Estimates do not know what a grouped function returns: sorted, not broadcast.
    return nodes.select("scan_id", "node_id").join(found.hint("merge"), ["scan_id", "node_id"], "left").withColumn("cc", F.coalesce("cc", "node_id"))


def quasi_flat_zones(edges: DataFrame, threshold: float, nodes: DataFrame | None = None) -> DataFrame:
    """Components of the edges below a threshold.  A spanning tree first would give the same components."""
    return connected_components(threshold_edges(edges, threshold), nodes)


def spanning_forest(edges: DataFrame, additive: bool = False) -> DataFrame:
    """Edges of a minimum spanning forest of every scan: `scan_id, src, dst, w, step, n_src, n_dst`.

    Edges come in by weight, then ends, `step` by step; `n_src` and `n_dst` are the sizes of the
    sets that the edge joined.  `additive`: the weight is multiplied by the smaller of both.
    """

    def run(table: pa.Table) -> pa.Table:
        scan, nodes, src, dst, w = _grouped_edges(table)
        kept, sizes = kernels.spanning_tree(len(nodes), src, dst, w)
        kept, sizes = np.array(kept, np.int64), np.array(sizes, np.int64).reshape(-1, 2)
        weight = w[kept] * sizes.min(1, initial=len(nodes)) if additive else w[kept]
        columns = [np.full(len(kept), scan), nodes[src[kept]], nodes[dst[kept]], weight, np.arange(len(kept)), sizes[:, 0], sizes[:, 1]]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["scan_id", "src", "dst", "w", "step", "n_src", "n_dst"])

    rows = undirected(edges).select(*[F.col(c).cast("long").alias(c) for c in EDGE], F.col("w").cast("double").alias("w"))
    return rows.groupBy("scan_id").applyInArrow(run, "scan_id long, src long, dst long, w double, step long, n_src long, n_dst long")


def component_sizes(labels: DataFrame) -> DataFrame:
    """Components by size, the largest first, ties to the lower name."""
    order = Window.partitionBy("scan_id").orderBy(F.desc("n"), "cc")
    return labels.groupBy("scan_id", "cc").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(order).cast("long"))


def lowest_components(labels: DataFrame, points: DataFrame, min_size: int, most: int) -> DataFrame:
    """Of the components above a size, the `most` of lowest mean height."""
    heights = labels.join(points.select("scan_id", F.col("point_id").alias("node_id"), "z").hint("merge"), ["scan_id", "node_id"])
    stats = heights.groupBy("scan_id", "cc").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("z_mean")).where(F.col("n") > min_size)
    order = Window.partitionBy("scan_id").orderBy(F.round("z_mean", 9), "cc")
    return stats.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def _by_component(cc: np.ndarray, ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows by component and id, the components and where each begins, with the end of the last."""
    order = np.lexsort((ids, cc))
    names, start = np.unique(cc[order], return_index=True)
    return cc[order], ids[order], p[order], names, np.append(start, len(cc))


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = np.zeros((len(q), len(p)))
    for axis in range(p.shape[1]):
        diff = q[:, None, axis] - p[None, :, axis]
        d += diff * diff
    return np.sqrt(d, out=d)


def _closest(ids: np.ndarray, p: np.ndarray, start: np.ndarray, k: int) -> list[tuple[int, int, int, int, float, int]]:
    """Places of two components and of their closest points, distance and rank, for the k nearest of every component."""
    out = []
    for i in range(len(start) - 1):
        best, mate = np.full(len(p), np.inf), np.zeros(len(p), np.int64)
        for a in range(start[i], start[i + 1], 256):
            # Distances, as different squares may have one root: ties are those of distances.
            d2 = _distances(p[a : min(a + 256, start[i + 1])], p)
            j = d2.argmin(0)
            d = d2[j, np.arange(len(p))]
            closer = d < best
            best[closer], mate[closer] = d[closer], a + j[closer]
        least = np.minimum.reduceat(best, start[:-1])
        least[i] = np.inf
        for r, m in enumerate(np.argsort(least, kind="stable")[: min(k, len(least) - 1)].tolist(), 1):
            ties = np.flatnonzero(best[start[m] : start[m + 1]] == least[m]) + start[m]
            # Places go by id inside a component.
            t = ties[np.lexsort((ties, mate[ties]))[0]]
            out.append((i, m, int(mate[t]), int(t), float(least[m]), r))
    return out


def _grouped_points(table: pa.Table) -> tuple[np.ndarray, ...]:
    cc, ids = np.asarray(table.column("cc")), np.asarray(table.column("node_id"))
    return _by_component(cc, ids, np.stack([np.asarray(table.column(c)) for c in "xyz"], axis=1))


def closest_components(labelled: DataFrame, k: int = 3) -> DataFrame:
    """For every component of `labelled(scan_id, node_id, cc, x, y, z)` its k nearest ones, with the closest pair.

    The pairs of one scan's points are compared inside one task, block by block.
    """

    def run(table: pa.Table) -> pa.Table:
        _, ids, p, names, start = _grouped_points(table)
        out = [(names[i], names[m], ids[u], ids[v], d, r) for i, m, u, v, d, r in _closest(ids, p, start, k)]
        columns = list(zip(*out)) if out else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        arrays = [pa.array(np.full(len(out), np.asarray(table.column("scan_id"))[0]), pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types)]]
        return pa.Table.from_arrays(arrays, names=["scan_id", "cc", "other", "src", "dst", "d", "rank"])

    rows = labelled.select("scan_id", "node_id", "cc", "x", "y", "z")
    return rows.groupBy("scan_id").applyInArrow(run, "scan_id long, cc long, other long, src long, dst long, d double, rank long")


def connecting_edges(cc: np.ndarray, ids: np.ndarray, p: np.ndarray, k: int, around: int, longest: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of both ends and lengths of the edges of `connect_components` in one scan, one direction, repeats included."""
    _, ids, p, _, start = _by_component(cc, ids, p)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def near(m: int, at: int) -> np.ndarray:
        own = np.arange(start[m], start[m + 1])
        return own[np.argsort(_distances(p[at : at + 1], p[own])[0], kind="stable")[: max(min(around, len(own) - 1), 1)]]

    for i, m, u, v, _, _ in _closest(ids, p, start, k):
        s, d = near(i, v), near(m, u)
        w = _distances(p[s], p[d])
        a, b = np.nonzero(w < longest) if longest is not None else np.indices(w.shape).reshape(2, -1)
        found.append((ids[s[a]], ids[d[b]], w[a, b]))
    return tuple(np.concatenate(x) for x in zip(*found))


def connect_components(labelled: DataFrame, k: int = 3, around: int = 30, longest: float | None = 12.0) -> DataFrame:
    """Edges between near components: around each closest pair the nearest members on both sides, all combinations.

    At most `around` members on a side and one less than its size (one at least), so the
    combinations of a pair are bounded; `longest` cuts long edges.  One task works on one scan: joins would bring
    all members of a large component to each link.
    """

    def run(table: pa.Table) -> pa.Table:
        cc, ids, p, _, _ = _grouped_points(table)
        src, dst, w = connecting_edges(cc, ids, p, k, around, longest)
        return pa.table({"scan_id": pa.array(np.full(len(src), np.asarray(table.column("scan_id"))[0]), pa.int64()), "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "w": pa.array(w, pa.float64())})

    rows = labelled.select("scan_id", "node_id", "cc", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return symmetric(rows.groupBy("scan_id").applyInArrow(run, "scan_id long, src long, dst long, w double"))


# ---- image graphs --------------------------------------------------------------------------------


#: Half of each neighbourhood: rows down, columns on from an even row, and from an odd one.  Of six neighbours, odd
#: rows lie half a pixel to the right.
STEPS = {4: [(0, 1, 1), (1, 0, 0)], 6: [(0, 1, 1), (1, -1, 0), (1, 0, 1)], 8: [(0, 1, 1), (1, -1, -1), (1, 0, 0), (1, 1, 1)]}


def image_graph(raster: DataFrame, channels: list[str], width: int | None = None, metric: Callable[[list[Column], list[Column]], Column] | None = None, mask: str | None = None, neighbours: int = 4) -> DataFrame:
    """Edges of 4-, 6- or 8-neighbours (scan_id, row, col, row2, col2, w), weight the greatest channel difference plus 1e-10.

    With `width` the image wraps around its columns.  `metric` gives another weight from the channels
    of both pixels; `mask`, a boolean column, keeps edges between its pixels.
    """
    if mask is not None:
        raster = raster.where(mask)
    a = raster.select("scan_id", "row", "col", *[F.col(c).alias(f"a_{c}") for c in channels])
    b = raster.select("scan_id", F.col("row").alias("row2"), F.col("col").alias("col2"), *[F.col(c).alias(f"b_{c}") for c in channels])
    ends = []
    for down, even, odd in STEPS[neighbours]:
        col = F.col("col") + (F.lit(even) if even == odd else F.when(F.col("row") % 2 == 0, even).otherwise(odd))
        ends.append(F.struct((F.col("row") + down).alias("row2"), (col if width is None else F.pmod(col, F.lit(width))).alias("col2")))
    moved = a.withColumn("n", F.explode(F.array(*ends))).select("*", "n.row2", "n.col2").drop("n")
    joined = join_pixels(moved, b, ["scan_id", "row2", "col2"])
    if metric is None:
        w = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in channels]
        weight = (F.greatest(*w) if len(w) > 1 else w[0]) + 1e-10
    else:
        weight = metric([F.col(f"a_{c}") for c in channels], [F.col(f"b_{c}") for c in channels])
    return joined.select("scan_id", "row", "col", "row2", "col2", weight.alias("w"))


def pixel_number(row: Column, col: Column, height: Column, width: Column, order: str = "C", row_offset: int = 0, col_offset: int = 0) -> Column:
    """A pixel's node number, row by row (`C`) or column by column (`F`), of an image that starts at an offset."""
    if order not in ("C", "F"):
        raise ValueError("order is C or F")
    r, c = row - F.lit(row_offset), col - F.lit(col_offset)
    return (r * width + c if order == "C" else c * height + r).cast("long")


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Values of a column: whole numbers without nulls as they are, others as doubles with NaN for null."""
    return column.to_numpy() if pa.types.is_integer(column.type) and not column.null_count else column.cast(pa.float64()).to_numpy()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values get equal numbers; NaN for null."""
    held, out = column.is_valid().to_numpy(), np.full(len(column), np.nan)
    out[held] = np.unique(column.drop_null().to_numpy(), return_inverse=True)[1]
    return out


def _zones(raster: DataFrame, channels: list[str], values: Callable[[pa.ChunkedArray], np.ndarray], lam: float, width: int, neighbours: int) -> DataFrame:
    """`scan_id, node_id, cc`: components of neighbouring pixels none of whose channels differs by more than `lam`.

    One task works on one scan's image, so no table of edges is made.  A channel that is null in one of two pixels
    does not count; pixels without a common channel are apart.
    """

    def run(table: pa.Table) -> pa.Table:
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        nodes, at = np.unique(row * width + col, return_inverse=True)
        held = [values(table.column(f"v{i}")) for i in range(len(channels))]
        a, b = kernels.pixel_pairs(row, col, STEPS[neighbours])
        with np.errstate(invalid="ignore"):
            apart = [np.abs(v[a] - v[b]).astype(float) + 1e-10 for v in held]
        same = np.fmax.reduce(apart) <= lam + 1e-10
        cc = nodes[kernels.components(len(nodes), at[a[same]], at[b[same]])]
        return pa.table({"scan_id": pa.repeat(table.column("scan_id")[0], len(nodes)), "node_id": pa.array(nodes, pa.int64()), "cc": pa.array(cc, pa.int64())})

    place = [F.col(c).cast("long").alias(c) for c in ("scan_id", "row", "col")]
    rows = raster.where(F.col("row").isNotNull() & F.col("col").isNotNull()).select(*place, *[F.col(c).alias(f"v{i}") for i, c in enumerate(channels)])
    return rows.groupBy("scan_id").applyInArrow(run, "scan_id long, node_id long, cc long")


def label_zones(raster: DataFrame, labels: list[str], width: int, neighbours: int = 4) -> DataFrame:
    """Components of neighbours that agree in all label images."""
    return _zones(raster, labels, _codes, 0.0, width, neighbours)


def two_partition_zones(raster: DataFrame, first: str, second: str, width: int) -> DataFrame:
    """Components of 4-neighbours that agree in two label images."""
    return label_zones(raster, [first, second], width)


def pixel_components(edges: DataFrame, pixels: DataFrame, width: int) -> DataFrame:
    """Components of an image graph; pixels are numbered row by row."""
    number = lambda r, c: (F.col(r) * width + F.col(c)).cast("long")
    flat = edges.select("scan_id", number("row", "col").alias("src"), number("row2", "col2").alias("dst"), F.lit(1.0).alias("w"))
    return connected_components(flat, pixels.select("scan_id", number("row", "col").alias("node_id")).distinct())


def flat_zones(raster: DataFrame, value: str, lam: float, width: int, neighbours: int = 4) -> DataFrame:
    """λ-flat zones: components of neighbours that differ by at most `lam`."""
    return _zones(raster, [value], _numbers, lam, width, neighbours)
