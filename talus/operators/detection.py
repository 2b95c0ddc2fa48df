"""Ground detection: planes, cloth, flat zones, hybrid segmentation and label transfer."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.geometry import lcg_rank
from talus.operators import graph as G
from talus.operators import kernels
from talus.operators import points as P
from talus.operators import raster as R


def transfer_labels(points: DataFrame, value: str, k: int = 3, how: str = "mean") -> DataFrame:
    """`scan_id, point_id, score`: points that share a pixel get the mean value of their k nearest points that do not.

    With `vote` they get the commonest value, the least of equally common ones.
    """
    if how not in ("mean", "vote"):
        raise ValueError("how is mean or vote")
    alone = Window.partitionBy("scan_id", "lidx")

    def run(table: pa.Table) -> pa.Table:
        ids, v, n = (np.asarray(table.column(c)) for c in ("point_id", "value", "n"))
        p = np.stack([np.asarray(table.column(c)) for c in "xyz"], axis=1)
        train, test = np.flatnonzero(n == 1), np.flatnonzero(n > 1)
        train = train[np.argsort(ids[train])]
        scores = np.zeros(len(test))
        for a in range(0, len(test) if len(train) else 0, 256):
            some = test[a : a + 256]
            d2 = np.zeros((len(some), len(train)))
            for axis in range(3):
                diff = p[some, None, axis] - p[None, train, axis]
                d2 += diff * diff
            near = np.argsort(np.sqrt(d2), axis=1, kind="stable")[:, :k]
            found = v[train][near]
            if how == "vote":
                found = np.sort(found, axis=1)
                same = (found[:, :, None] == found[:, None, :]).sum(2)
                scores[a : a + 256] = found[np.arange(len(some)), same.argmax(1)]
            else:
                scores[a : a + 256] = found.mean(1)
        scan = np.full(len(test), np.asarray(table.column("scan_id"))[0])
        return pa.table({"scan_id": pa.array(scan, pa.int64()), "point_id": pa.array(ids[test], pa.int64()), "score": pa.array(scores, pa.float64())})

    rows = points.select("scan_id", "point_id", F.col(value).cast("double").alias("value"), F.count(F.lit(1)).over(alone).alias("n"), "x", "y", "z")
    return rows.groupBy("scan_id").applyInArrow(run, "scan_id long, point_id long, score double")


def planes(points: DataFrame, iterations: int, group: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Candidate planes (group, t, nx, ny, nz, px, py, pz): three points a round, picked by integer arithmetic on rank.

    The last column of the group seeds the choice.
    """
    order = Window.partitionBy(*group).orderBy("point_id")
    ranked = points.select(*group, "x", "y", "z", (F.row_number().over(order) - 1).cast("long").alias("r"))
    sizes = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3)
    rounds = sizes.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))))
    for k, name in enumerate("abc"):
        rounds = rounds.withColumn(name, lcg_rank(F.col("t") * 3 + F.lit(k) + F.pmod(group[-1], F.lit(1 << 31)) * 7919, F.col("n")))
    rounds = rounds.where((F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")))
    for name in "abc":
        corner = ranked.select(*group, F.col("r").alias(name), *[F.col(c).alias(f"{name}{c}") for c in "xyz"])
        rounds = rounds.join(corner, [*group, name])
    u = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    v = [F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    out = rounds.select(*group, "t", n[0].alias("nx"), n[1].alias("ny"), n[2].alias("nz"), *[F.col(f"a{c}").alias(f"p{c}") for c in "xyz"])
    return out.where(_length() >= 1e-12)


def _length():
    return F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))


def _off_plane():
    return F.abs(F.col("nx") * (F.col("x") - F.col("px")) + F.col("ny") * (F.col("y") - F.col("py")) + F.col("nz") * (F.col("z") - F.col("pz"))) / _length()


#: Points that one task compares with a group's planes.
PLANE_POINTS = 1 << 17


def plane_inliers(points: DataFrame, candidates: DataFrame, max_dist: float, group: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """`group, t, n_inliers`: points of a group nearer than `max_dist` to each of its planes.

    A task compares a part of a group's points with all of its planes, by blocks, and returns a count a plane.
    """
    keys, types = [f"g{i}" for i in range(len(group))], dict(points.dtypes)
    sizes = candidates.select(*group).distinct().join(points.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / PLANE_POINTS).cast("int").alias("parts")), list(group))
    named = [F.col(c).alias(k) for c, k in zip(group, keys)]
    cloud = points.select(*group, "point_id", "x", "y", "z").join(sizes, list(group))
    cloud = cloud.select(*named, F.pmod(F.xxhash64("point_id"), "parts").cast("int").alias("part"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    flat = candidates.join(sizes, list(group)).select(*named, every, *[F.col(c).alias(c) for c in ("t", "nx", "ny", "nz", "px", "py", "pz")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p = [left.column(c).to_numpy(zero_copy_only=False) for c in "xyz"]
        found = []
        for nx, ny, nz, px, py, pz in zip(*(right.column(c).to_numpy() for c in ("nx", "ny", "nz", "px", "py", "pz"))):
            off = np.abs(nx * (p[0] - px) + ny * (p[1] - py) + nz * (p[2] - pz)) / np.sqrt(nx * nx + ny * ny + nz * nz)
            found.append(int((off < max_dist).sum()))
        return right.select([*keys, "t"]).append_column("n", pa.array(found, pa.int64()))

    schema = ", ".join(f"{k} {types[c]}" for k, c in zip(keys, group)) + ", t long, n long"
    part = [*keys, "part"]
    counted = cloud.groupBy(*part).cogroup(flat.groupBy(*part)).applyInArrow(run, schema)
    return counted.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, group)], "t").agg(F.sum("n").alias("n_inliers"))


def ransac_plane(points: DataFrame, max_dist: float, iterations: int, stop_at: int | None = None, group: tuple[str, ...] = ("scan_id",), cut=None) -> DataFrame:
    """The plane with most points nearer than `max_dist` in each group; ties, and the first to reach `stop_at`, by round."""
    candidates = planes(points, iterations, group)
    if cut is not None:
        candidates = cut(candidates)
    counted = plane_inliers(points, candidates, max_dist, group)
    if stop_at is not None:
        counted = counted.withColumn("place", F.struct(F.when(F.col("n_inliers") >= stop_at, 0).otherwise(1).alias("late"), F.when(F.col("n_inliers") >= stop_at, F.lit(0)).otherwise(-F.col("n_inliers")).alias("fewer"), F.col("t")))
    else:
        counted = counted.withColumn("place", F.struct((-F.col("n_inliers")).alias("fewer"), F.col("t")))
    best = counted.groupBy(*group).agg(F.min_by(F.struct("t", "n_inliers"), "place").alias("best")).select(*group, "best.*")
    return best.join(candidates, [*group, "t"])


def ransac_ground(points: DataFrame, min_height: float, max_height: float, max_dist: float, iterations: int, stop_at: int | None = None) -> DataFrame:
    """Adds `ground`: points of the height range near its best plane."""
    inside = P.filter_points(points, height_range=(min_height, max_height))
    best = ransac_plane(inside, max_dist, iterations, stop_at)
    joined = points.join(best, "scan_id", "left")
    low = (F.col("z") > min_height) & (F.col("z") < max_height)
    return joined.withColumn("ground", F.coalesce(low & (_off_plane() < max_dist), F.lit(False))).select(*points.columns, "ground")


def merge_labels(points: DataFrame, labels: DataFrame, min_size: int, max_dist: float, iterations: int, share: float, cut=None) -> DataFrame:
    """`scan_id, point_id, ground`: the largest component and those that lie on a plane with it.

    Every component above a size is compared with the largest one alone, so all comparisons of
    all scans run at once: a plane is fitted to both together, and the component joins if more
    than `share` of its points are inliers.  `cut` stores the pairs' points and planes, which are read several times.
    """
    cut = cut or (lambda df: df)
    sizes = G.component_sizes(labels)
    first = sizes.where(F.col("rank") == 1).select("scan_id", F.col("cc").alias("big"))
    others = sizes.where((F.col("rank") > 1) & (F.col("n") > min_size)).select("scan_id", F.col("cc").alias("other"))
    pairs = first.join(others, "scan_id")
    at = points.join(labels.select("scan_id", F.col("node_id").alias("point_id"), "cc"), ["scan_id", "point_id"])
    both = cut(at.join(pairs.withColumn("cc", F.explode(F.array("big", "other"))), ["scan_id", "cc"]))
    # The smaller component names its pair with the largest one of the scan.
    best = ransac_plane(both, max_dist, iterations, group=("scan_id", "other"), cut=cut).drop("t", "n_inliers")
    inside = both.where(F.col("cc") == F.col("other")).join(best, ["scan_id", "other"])
    joins = inside.groupBy("scan_id", "other").agg(F.avg((_off_plane() < max_dist).cast("double")).alias("inlier_share")).where(F.col("inlier_share") > share)
    ground = first.select("scan_id", F.col("big").alias("cc")).unionByName(joins.select("scan_id", F.col("other").alias("cc"))).withColumn("ground", F.lit(True))
    return at.join(ground, ["scan_id", "cc"], "left").select("scan_id", "point_id", F.coalesce("ground", F.lit(False)).alias("ground"))


def pca_normals(points: DataFrame, k: int, keep: bool = False) -> DataFrame:
    """`scan_id, point_id, nx, ny, nz, e0, e1, e2`: smallest eigenvector and eigenvalues over the k nearest and the point itself.

    With `keep` also x, y and z.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("point_id"))
        order = np.argsort(ids)
        p = np.stack([np.asarray(table.column(c)) for c in "xyz"], axis=1)[order]
        who, _ = kernels.nearest(p, k)
        normals, values = kernels.eigen_normals(p, who)
        # The sign of an eigenvector is free: upwards here.
        normals = np.where(normals[:, 2:] < 0, -normals, normals)
        columns = {"scan_id": pa.array(np.full(len(ids), np.asarray(table.column("scan_id"))[0]), pa.int64()), "point_id": pa.array(ids[order], pa.int64())}
        columns |= {n: pa.array(np.ascontiguousarray(normals[:, i])) for i, n in enumerate(("nx", "ny", "nz"))}
        columns |= {n: pa.array(np.ascontiguousarray(values[:, i])) for i, n in enumerate(("e0", "e1", "e2"))}
        if keep:
            columns |= {n: pa.array(p[:, i].astype(float)) for i, n in enumerate("xyz")}
        return pa.table(columns)

    schema = "scan_id long, point_id long, nx double, ny double, nz double, e0 double, e1 double, e2 double"
    if keep:
        schema += ", x double, y double, z double"
    return points.select("scan_id", "point_id", "x", "y", "z").groupBy("scan_id").applyInArrow(run, schema)


def normals(points: DataFrame, method: str = "spherical", k: int = 10, res_yaw: int = 2048, layers: int = 64, back_project: bool = False) -> DataFrame:
    """Normals by the range image of scan lines (`spherical`: a row a pixel, or with `back_project` a point) or by
    eigenvectors of the k nearest (`pca`: a row a point).  Points outside the image get the zero vector."""
    if method == "pca":
        return pca_normals(points, k).select("scan_id", "point_id", "nx", "ny", "nz")
    if method != "spherical":
        raise ValueError(f"method is spherical or pca, not {method!r}")
    px = P.layer_pixels(P.scan_layers(points, layers), "layer", layers, res_yaw)
    rho = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    sizes = points.select("scan_id").distinct().select("scan_id", F.lit(layers).cast("long").alias("height"), F.lit(res_yaw).cast("long").alias("width"))
    image = R.fill_holes(R.dense(R.rasterize(px, rho=F.max(rho)), sizes, rho=0.0), "rho")
    found = R.spherical_normals(image, "rho", layers, res_yaw).select(*R.PIXEL, "nx", "ny", "nz")
    if not back_project:
        return found
    joined = px.select("scan_id", "point_id", "row", "col").join(found, R.PIXEL, "left")
    return joined.select("scan_id", "point_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


def eigenentropy(e0, total):
    e = e0 / F.nullif(total, F.lit(0.0))
    part = lambda v: F.when(v > 0, v * F.ln(F.when(v > 0, v))).otherwise(F.lit(0.0))
    return -part(F.lit(1.0) - e) - part(e)


def hybrid_ground(points: DataFrame, edges: DataFrame, threshold: float, k_normals: int, min_size: int, max_dist: float, iterations: int, share: float, cut=None) -> DataFrame:
    """Flat zones of height weights on a graph, merged by planes; `cut` stores what is read several times."""
    store = cut or (lambda df: df)
    normals = pca_normals(points, k_normals)
    weighted = G.height_weights(edges, points, normals)
    labels = store(G.quasi_flat_zones(weighted, threshold, points.select("scan_id", F.col("point_id").alias("node_id"))))
    return merge_labels(points, labels, min_size, max_dist, iterations, share, cut)


def iterative_step(points: DataFrame, edges: DataFrame, threshold: float, cut, k: int, k_normals: int) -> DataFrame:
    """Flat zones of height weights on the k-NN graph and `edges`, whose separate parts are linked to their nearest ones.

    Normals come in one task a scan, all of the graph in a second one, so no table of edges is shuffled between its steps.
    """
    normals = pca_normals(points, k_normals, keep=True)
    low = F.min("z").over(Window.partitionBy("scan_id"))
    rows = normals.select("scan_id", "point_id", *"xyz", G.height_ratio(low).alias("r"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("point_id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        p = np.stack([left.column(c).to_numpy() for c in "xyz"], axis=1)[order]
        ratio = left.column("r").to_numpy()[order]
        ends = [right.column(c).to_numpy() for c in ("src", "dst")]
        ends = [e[np.isin(ends[0], ids) & np.isin(ends[1], ids)] for e in ends]
        who, _ = kernels.nearest(p, k)
        src = np.concatenate([np.searchsorted(ids, ends[0]), np.repeat(np.arange(len(ids)), who.shape[1])])
        dst = np.concatenate([np.searchsorted(ids, ends[1]), who.ravel()])
        parts = kernels.components(len(ids), src, dst)
        more = G.connecting_edges(parts, np.arange(len(ids)), p, 3, 30, 12.0)
        src, dst = np.concatenate([src, more[0]]), np.concatenate([dst, more[1]])
        flat = np.abs(ratio[src] - ratio[dst]) < threshold
        cc = ids[kernels.components(len(ids), src[flat], dst[flat])]
        scan = left.column("scan_id")[0].as_py() if len(ids) else 0
        return pa.table({"scan_id": pa.array(np.full(len(ids), scan), pa.int64()), "node_id": pa.array(ids, pa.int64()), "cc": pa.array(cc, pa.int64())})

    return cut(rows.groupBy("scan_id").cogroup(edges.select(*G.EDGE).groupBy("scan_id")).applyInArrow(run, "scan_id long, node_id long, cc long"))


def iterative_ground(points: DataFrame, edges: DataFrame, threshold: float, min_size: int, most: int, cut, rounds: int = 10, enough: int = 20, k: int = 10, k_normals: int = 30) -> DataFrame:
    """Flat zones of the lowest large components, again and again until few are left; the first zones of what is left are ground.

    Every scan stops by itself, when it has at most `enough` components.  A scan without a
    component above `min_size` has no ground.  `cut` materialises the labels of a round where all
    executors can read them.
    """
    points, edges = cut(points.select("scan_id", "point_id", "x", "y", "z")), cut(edges)
    first = labels = iterative_step(points, edges, threshold, cut, k, k_normals)
    left = []
    for _ in range(rounds):
        more = labels.groupBy("scan_id").agg(F.count_distinct("cc").alias("n")).where(F.col("n") > enough).select("scan_id")
        left.append(labels.join(more, "scan_id", "left_anti").select("scan_id", "node_id"))
        labels = labels.join(more, "scan_id", "left_semi")
        if labels.isEmpty():
            break
        low = G.lowest_components(labels, points, min_size, most)
        nodes = cut(labels.join(low, ["scan_id", "cc"], "left_semi").select("scan_id", "node_id"))
        some = cut(points.join(nodes.withColumnRenamed("node_id", "point_id").hint("merge"), ["scan_id", "point_id"], "left_semi"))
        labels = iterative_step(some, cut(G.subgraph(edges, nodes)), threshold, cut, k, k_normals)
    left.append(labels.select("scan_id", "node_id"))
    stay = left[0]
    for other in left[1:]:
        stay = stay.unionByName(other)
    ground = first.join(stay.hint("merge"), ["scan_id", "node_id"], "left_semi").select("scan_id", "cc").distinct().withColumn("ground", F.lit(True))
    return first.join(ground.hint("merge"), ["scan_id", "cc"], "left").select("scan_id", F.col("node_id").alias("point_id"), F.coalesce("ground", F.lit(False)).alias("ground"))


def cloth_ground(
    points: DataFrame, res: float = 1.0, res_z: float = 10.0, rigidness: int = 3, delta: float = 0.2, low_share: float = 0.005,
    avg_mode: str = "all", mass_mode: str = "one", local_rigidness: float = 1.0, max_iter: int = 200, epsilon: float = 0.01,
) -> DataFrame:
    """Cloth simulation: adds `ground`.  The lowest level counts from the 0.5-percent height of each scan.

    `avg_mode`: neighbours of all pixels, or only those that hold points (`mask`), pull at the cloth;
    `mass_mode`: mass 1, or that of a square of one metre (`res_x`).
    """
    if avg_mode not in ("all", "mask") or mass_mode not in ("one", "res_x"):
        raise ValueError("avg_mode is all or mask, mass_mode is one or res_x")
    mass = 1.0 if mass_mode == "one" else 1 / (res * res)
    px = P.linear_pixels(points, res, res)
    base = points.groupBy("scan_id").agg(F.percentile("z", F.lit(low_share)).alias("min_z"))
    px = px.join(base, "scan_id")
    level = (F.floor(F.greatest(F.col("z") - F.col("min_z"), F.lit(0.0)) * res_z) + 1).cast("long")
    px = px.withColumn("level", level)
    lowest = px.groupBy("scan_id", "row", "col", "height", "width").agg(F.coalesce(F.min(F.when(F.col("z") >= F.col("min_z"), F.col("level"))), F.lit(1).cast("long")).alias("im_min"))
    step = 9.8 / res_z / mass * 0.65**2

    def run(table: pa.Table) -> pa.Table:
        shape = (int(np.asarray(table.column("height"))[0]), int(np.asarray(table.column("width"))[0]))
        row, col, low = (np.asarray(table.column(c)) for c in ("row", "col", "im_min"))
        image, mask = np.full(shape, 255.0), np.zeros(shape, bool)
        image[row, col], mask[row, col] = low, True
        rest = kernels.cloth(image, mask, step, rigidness, local_rigidness, max_iter, epsilon, avg_mode == "mask")
        # Heights were cut to whole levels; the cloth lies on levels above 0.
        ground = np.trunc(rest[row, col])
        return pa.table({"scan_id": table.column("scan_id"), "row": table.column("row"), "col": table.column("col"), "im_min": pa.array(ground.astype(np.int64)), "is_ground": pa.array(ground > 0)})

    surface = lowest.groupBy("scan_id").applyInArrow(run, "scan_id long, row long, col long, im_min long, is_ground boolean")
    joined = px.join(surface, R.PIXEL, "left")
    near = F.col("level") - F.col("im_min") <= delta * res_z
    return joined.withColumn("ground", F.coalesce(F.col("is_ground") & near, F.lit(False))).select(*points.columns, "ground")


def histogram_floor(points: DataFrame, step: float, more_than: int = 100) -> DataFrame:
    """Left edge of the lowest height bin with more than `more_than` points of each scan."""
    low = points.groupBy("scan_id").agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    bins = points.join(low.hint("merge"), "scan_id").withColumn("bin", F.floor((F.col("z") - F.col("z0")) / step).cast("long"))
    bins = bins.where(F.col("bin") < F.ceil((F.col("z1") - F.col("z0")) / step) - 1)
    counted = bins.groupBy("scan_id", "z0", "bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return counted.groupBy("scan_id", "z0").agg(F.min("bin").alias("bin")).select("scan_id", (F.col("z0") + F.col("bin") * F.lit(step)).alias("min_z"))


#: Fixed values of the scanner: height, lines, vertical span in degrees.
SCANNER_HEIGHT, LINES, SPAN = 1.73, 64, 26.9


def dart_board(raster: DataFrame, res: float) -> DataFrame:
    """Adds ring, sector and `cell` (a zone of one ring and sector) of every pixel of images with r0, c0, height and width.

    Rings lie between the ground distances of the scan lines, of which those outside the image are left out.
    """
    import math

    radii = [abs(round(SCANNER_HEIGHT * math.tan(math.radians(90 + k * SPAN / LINES)) * res)) for k in range(LINES)]
    dr, dc = (F.col("row") - F.col("r0")).cast("double"), (F.col("col") - F.col("c0")).cast("double")
    r, size = F.floor(F.sqrt(dr * dr + dc * dc)), F.greatest("height", "width")
    ring = F.coalesce(*[F.when((F.lit(radii[k]) < size) & (F.lit(radii[k]) < F.col("__r")), F.lit(k + 1)) for k in range(1, LINES)], F.lit(LINES + 1))
    sector = F.when((dr == 0) & (dc == 0), F.lit(0)).otherwise(F.rint(F.lit(180.0) + F.lit(180.0) * F.atan2(dr, dc) / F.lit(2 * math.pi)).cast("int"))
    # The distance is a column of its own: inside the rings it would be computed once for each.
    board = raster.withColumn("__r", r).withColumn("ring", ring).withColumn("sector", sector).drop("__r")
    cells = G.label_zones(board, ["ring", "sector"], 1 << 20).withColumnRenamed("cc", "cell")
    numbered = board.withColumn("node_id", (F.col("row") * (1 << 20) + F.col("col")).cast("long"))
    return R.join_pixels(numbered, cells, ["scan_id", "node_id"]).drop("node_id")


def scanner_circle(raster: DataFrame, half: int, neighbours: int = 6) -> DataFrame:
    """Adds `inside` (1 or 0): empty pixels (`im_acc` 0) connected with the scanner's own (r0, c0), up to `half` pixels around it.

    Where the scanner's pixel holds points there are none.
    """
    number = lambda r, c: (F.col(r) * (1 << 20) + F.col(c)).cast("long")
    empty = raster.where(F.col("im_acc") == 0)
    zones = G.flat_zones(empty, "im_acc", 0.0, 1 << 20, neighbours)
    own = raster.select("scan_id", number("r0", "c0").alias("node_id")).distinct().join(zones.hint("merge"), ["scan_id", "node_id"]).select("scan_id", "cc")
    circle = R.join_pixels(zones, own, ["scan_id", "cc"]).select("scan_id", "node_id", F.lit(1).alias("inside"))
    near = (F.abs(F.col("row") - F.col("r0")) <= half) & (F.abs(F.col("col") - F.col("c0")) <= half)
    joined = R.join_pixels(raster.withColumn("node_id", number("row", "col")), circle, ["scan_id", "node_id"], "left").drop("node_id")
    return joined.withColumn("inside", F.when(near, F.coalesce("inside", F.lit(0))).otherwise(0))


def dart_ground(
    points: DataFrame, cut, res: float = 1.0, res_z: float = 10.0, lam: float = 2.0, delta: float = 0.05, delta_circle: float = 0.5,
    min_z: float | None = None, neighbours: int = 6,
) -> DataFrame:
    """Ring-and-sector ground detection on the bird's-eye image: adds `ground`.

    Levels count from each scan's `histogram_floor` (its lowest point where no bin of 0.2 m has enough
    points), or from `min_z` for all scans.  Seeds are low pixels around the empty circle of the scanner,
    at more than one pixel a metre opened by 2 x 2 pixels; every cell of `dart_board` gives a lowest height,
    flat zones that hold a seed are ground, and zones of the lowest levels extend it.  Elements and zones
    are hexagonal with 6 `neighbours`, square with 8.  `cut` materialises the images between the steps
    where all executors can read them.
    """
    if min_z is None:
        lowest = points.groupBy("scan_id").agg(F.min("z").alias("__lowest")).join(histogram_floor(points, 0.2).hint("merge"), "scan_id", "left")
        floors = lowest.select("scan_id", F.coalesce("min_z", "__lowest").alias("__floor"))
        based = points.join(floors.hint("merge"), "scan_id")
    else:
        based = points.withColumn("__floor", F.lit(float(min_z)))
    px, floor_z = P.linear_pixels(based, res, res), F.col("__floor")
    images = R.height_images(px, floor_z, res_z)
    sizes = P.bounding_box(points, res, res)
    full = R.dense(images.select(*R.PIXEL, "im_min", "im_max", "im_acc"), sizes, im_min=0, im_max=0, im_acc=0)
    box = sizes.select("scan_id", "height", "width", F.floor(-F.col("xmin") * res).cast("long").alias("r0"), F.floor(-F.col("ymin") * res).cast("long").alias("c0"))
    full = cut(full.join(box.hint("merge"), "scan_id"))
    circle = scanner_circle(full, int(5.5 * res), neighbours)
    around = R.spread(circle, "scan_id").withColumn("wide", F.col("inside"))
    reach = max(1, int(res))
    wide = R.filter_hexagon(around, "wide", "max", reach) if neighbours == 6 else R.dilate(around, "wide", reach)
    wide = wide.withColumn("around", (F.col("wide") == 1) & (F.col("im_max") > 0))
    least = wide.where(F.col("around")).groupBy("scan_id").agg(F.min("im_max").alias("m"))
    top = F.least(F.lit(255), F.col("m") + int(delta_circle * res_z))
    low = F.col("around") & (F.col("im_max") <= top) & (F.col("im_max") - F.col("im_min") <= round(0.3 * res_z))
    seeds = wide.join(least.hint("merge"), "scan_id").withColumn("seed", low.cast("int"))
    if res > 1:
        seeds = R.opened_square(seeds, "seed")
    seeds = seeds.where(F.col("seed") == 1).select(*R.PIXEL, F.lit(True).alias("seed"))
    full = cut(dart_board(full, res))
    lows = full.where(F.col("im_acc") > 0).groupBy("scan_id", "cell").agg(F.min("im_max").alias("cell_min"))
    full = R.join_pixels(full, lows, ["scan_id", "cell"], "left")
    full = full.withColumn("filled", F.when(F.col("im_acc") > 0, F.col("im_max")).otherwise(F.coalesce("cell_min", F.lit(0))))
    full = full.withColumn("obj", F.when(F.col("im_acc") > 0, F.col("im_max") - F.col("cell_min")).otherwise(0))
    full = cut(full)
    number = lambda: (F.col("row") * (1 << 20) + F.col("col")).cast("long")
    zones = G.flat_zones(full, "filled", lam, 1 << 20, neighbours).withColumnRenamed("cc", "zone")
    at = R.join_pixels(R.join_pixels(full.withColumn("node_id", number()), zones, ["scan_id", "node_id"]), seeds, R.PIXEL, "left")
    good = at.where(F.col("seed")).select("scan_id", "zone").distinct().withColumn("hit", F.lit(True))
    base = R.join_pixels(at, good, ["scan_id", "zone"], "left").withColumn("base", F.coalesce("hit", F.lit(False)) & (F.col("obj") <= 3) & (F.col("im_acc") > 0))
    base = cut(base)
    low_zones = G.flat_zones(base.where(F.col("im_acc") > 0), "im_min", 1.0, 1 << 20, neighbours).withColumnRenamed("cc", "low_zone")
    both = R.join_pixels(base, low_zones, ["scan_id", "node_id"], "left")
    reach = both.where(F.col("base")).select("scan_id", "low_zone").distinct().withColumn("near", F.lit(True))
    ground = R.join_pixels(both, reach, ["scan_id", "low_zone"], "left").where(F.col("im_acc") > 0)
    ground = ground.withColumn("is_ground", F.col("base") | F.coalesce("near", F.lit(False))).withColumn("im_delta", F.when(F.col("base"), F.lit(4.0)).otherwise(F.lit(1.0)))
    return R.back_project_ground(px, ground, floor_z, res_z, delta).select(*points.columns, "ground")


def image_model_ground(points: DataFrame, model, res_yaw: int, res_pitch: int, fov_pitch, cut: float = 0.5) -> DataFrame:
    """Any function of an image (height, width, channels) to scores, run per scan on the range image and taken back to points.

    Points that share a pixel get the scores of their nearest points that do not.
    """
    px = P.spherical_pixels(points, res_yaw, res_pitch, fov_pitch=fov_pitch)
    rho = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    image = R.rasterize(px, rho=F.max(rho), low=F.min("z"), i=F.avg("i"))

    def run(table: pa.Table) -> pa.Table:
        row, col = np.asarray(table.column("row")), np.asarray(table.column("col"))
        dense = np.zeros((res_pitch, res_yaw, 3))
        for c, name in enumerate(("rho", "low", "i")):
            dense[row, col, c] = np.asarray(table.column(name))
        score = np.asarray(model(dense), float)
        return pa.table({"scan_id": table.column("scan_id"), "row": table.column("row"), "col": table.column("col"), "score": pa.array(score[row, col])})

    scored = image.groupBy("scan_id").applyInArrow(run, "scan_id long, row long, col long, score double")
    own = px.join(scored.withColumnRenamed("score", "pixel_score"), R.PIXEL, "left")
    shared = transfer_labels(own.where(F.col("row") >= 0), "pixel_score").withColumnRenamed("score", "near_score")
    out = own.join(shared, ["scan_id", "point_id"], "left")
    return out.withColumn("ground", F.coalesce("near_score", "pixel_score", F.lit(0.0)) > cut).select(*points.columns, "ground")
