"""Forward passes of graph networks whose neighbours are found again among the features of every layer.

Weights are data: a table of numbers, read into layers of a checked size.  Nodes are rows of scan_id, point_id
and `h`, their features as an array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import kernels

#: Nodes of a block of a scan: a task compares one block with another.
BLOCK_ROWS = 16_384
#: Messages that a task passes at once.
MESSAGE_ROWS = 65_536
#: Most numbers of a network; they are sent to every task.
MAX_NUMBERS = 100_000_000

WEIGHTS = "layer string, part string, row int, col int, value double"


@dataclass(frozen=True)
class Layer:
    """Weights (outputs x inputs) with bias, then a scale and shift (a trained normalisation), then a leaky rectifier.

    A `slope` of 1 leaves values as they are, 0 is the plain rectifier.
    """

    weight: np.ndarray
    bias: np.ndarray | None = None
    scale: np.ndarray | None = None
    shift: np.ndarray | None = None
    slope: float = 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.finish(x @ self.weight.reshape(len(self.weight), -1).T)

    def finish(self, y: np.ndarray) -> np.ndarray:
        """What follows the product, for outputs along the last axis."""
        for part, step in ((self.bias, np.add), (self.scale, np.multiply), (self.shift, np.add)):
            if part is not None:
                y = step(y, part)
        return y if self.slope == 1.0 else np.where(y > 0, y, self.slope * y)


def normalisation(mean: np.ndarray, variance: np.ndarray, weight: np.ndarray, bias: np.ndarray, epsilon: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Scale and shift of a batch normalisation with its running figures."""
    scale = weight / np.sqrt(variance + epsilon)
    return scale, bias - mean * scale


def write_layers(spark: SparkSession, layers: dict[str, Layer], path: str) -> None:
    """A network as a table of numbers: a row a number, by layer, part, row and column (the place within a row)."""
    rows = []
    for name, layer in layers.items():
        for part in ("weight", "bias", "scale", "shift"):
            values = getattr(layer, part)
            if values is not None:
                flat = np.asarray(values, float).reshape(len(values), -1)
                rows += [(name, part, r, c, float(flat[r, c])) for r in range(flat.shape[0]) for c in range(flat.shape[1])]
        rows.append((name, "slope", 0, 0, float(layer.slope)))
    spark.createDataFrame(rows, WEIGHTS).write.parquet(path)


def read_layers(spark: SparkSession, path: str) -> dict[str, Layer]:
    """The layers that `write_layers` wrote; a table of more than MAX_NUMBERS is refused, as every task gets all of them."""
    table = spark.read.schema(WEIGHTS).parquet(path)
    if (n := table.count()) > MAX_NUMBERS:
        raise ValueError(f"{n} weights; a network may have {MAX_NUMBERS}")
    table = table.toArrow()
    names, parts = (table.column(c).to_numpy(zero_copy_only=False) for c in ("layer", "part"))
    row, col, value = (table.column(c).to_numpy() for c in ("row", "col", "value"))
    out: dict[str, Layer] = {}
    for name in sorted(set(names)):
        found = {}
        for part in ("weight", "bias", "scale", "shift", "slope"):
            at = (names == name) & (parts == part)
            if at.any():
                m = np.zeros((row[at].max() + 1, col[at].max() + 1))
                m[row[at], col[at]] = value[at]
                found[part] = m if part == "weight" else m[:, 0]
        out[name] = Layer(**found | {"slope": float(found["slope"][0])})
    return out


def _of(layers: dict[str, Layer], prefix: str) -> list[Layer]:
    """Layers `prefix0`, `prefix1`, ... in the order of their numbers."""
    out = []
    while f"{prefix}{len(out)}" in layers:
        out.append(layers[f"{prefix}{len(out)}"])
    return out


def _run(layers: list[Layer], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        x = layer(x)
    return x


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), np.ascontiguousarray(m, float).ravel())


def nodes_of(points: DataFrame, features: list[str]) -> DataFrame:
    """`scan_id, point_id, h`: the features of every point; points with a null or a value that is not finite are left out."""
    whole = F.col("scan_id").isNotNull() & F.col("point_id").isNotNull()
    for f in features:
        v = F.col(f).cast("double")
        whole &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ids = [F.col(c).cast("long").alias(c) for c in ("scan_id", "point_id")]
    return points.where(whole).select(*ids, F.array(*[F.col(f).cast("double") for f in features]).alias("h"))


def _renewed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns under new identities: both sides of a cogroup may come from one frame."""
    return df.select(*[F.col(c).alias(c) for c in columns])


def knn_features(nodes: DataFrame, k: int, loop: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`scan_id, src, dst, d, rank`: the k nearest of every node's scan by Euclidean distance of `h`, ties to the lower id.

    With `loop` a node itself counts.  Scans fall into blocks of nodes by hash; a task compares one block with
    another and returns at most k a node, so no task holds a whole scan.  A scan of up to `block_rows` is one tile.
    """
    sizes = nodes.groupBy("scan_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__blocks"))
    placed = nodes.join(sizes.hint("merge"), "scan_id").withColumn("__own", F.pmod(F.xxhash64("point_id"), F.col("__blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    asked = placed.select("scan_id", "point_id", "h", F.col("__own").alias("q"), every.alias("c"))
    known = _renewed(placed, "scan_id", "point_id", "h", "__own", "__blocks").select("scan_id", "point_id", "h", F.col("__own").alias("c"), every.alias("q"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"scan_id": pa.array([], pa.int64()), "src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        who, ids = left.column("point_id").to_numpy(), right.column("point_id").to_numpy()
        row, dst, d = kernels.nearest_features(_matrix(left.column("h")), who, _matrix(right.column("h")), ids, k, loop)
        scan = np.full(len(row), left.column("scan_id")[0].as_py())
        return pa.table({"scan_id": pa.array(scan, pa.int64()), "src": who[row], "dst": dst, "d": d})

    tile = ("scan_id", "q", "c")
    found = asked.groupBy(*tile).cogroup(known.groupBy(*tile)).applyInArrow(run, "scan_id long, src long, dst long, d double")
    # Of every block of candidates at most k came back.
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", "dst"))), 1, k)
    ranked = found.groupBy("scan_id", "src").agg(near.alias("near")).select("scan_id", "src", F.posexplode("near").alias("rank", "near"))
    return ranked.select("scan_id", "src", "near.dst", "near.d", (F.col("rank") + 1).cast("long").alias("rank"))


REDUCE = {"max": np.maximum, "min": np.minimum, "add": np.add, "mean": np.add}


def _checked(layers: list[Layer], how: str) -> None:
    if how not in REDUCE:
        raise ValueError(f"how is one of {', '.join(REDUCE)}")
    if not layers:
        raise ValueError("no layers")


def _aggregate(layers: list[Layer], here: np.ndarray, there: np.ndarray, node: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """Where messages of another node begin, and every node's aggregate; messages are sorted by node and rank."""
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.empty(0, np.int64)
    out = _run(layers, np.concatenate([here, there - here], axis=1))
    out = REDUCE[how].reduceat(out, first, axis=0) if len(first) else out
    if how == "mean":
        out = out / np.diff(np.append(first, len(node)))[:, None]
    return first, out


def edge_layers(edges: DataFrame, nodes: DataFrame, layers: list[Layer], how: str = "max", message_rows: int = MESSAGE_ROWS) -> DataFrame:
    """`scan_id, point_id, h`: for every node with edges (scan_id, src, dst, rank) the aggregate of layers on (x_i, x_j - x_i).

    Edges get their neighbour's features by a join; messages of one node meet in one task, which holds a part
    of a scan.  They are added in the order of their ranks, so that runs agree to the last digit.
    """
    _checked(layers, how)
    sizes = edges.groupBy("scan_id").agg(F.ceil(F.count(F.lit(1)) / message_rows).cast("int").alias("__parts"))
    part = lambda node: F.pmod(F.xxhash64(node), F.col("__parts")).cast("int").alias("part")
    far = nodes.select("scan_id", F.col("point_id").alias("dst"), F.col("h").alias("far"))
    # Files of nodes are small beside their rows: sorted, not broadcast.
    left = edges.select("scan_id", "src", "dst", "rank").join(far.hint("merge"), ["scan_id", "dst"]).join(sizes.hint("merge"), "scan_id").select("scan_id", part("src"), "src", "rank", "far")
    right = _renewed(nodes.join(sizes.hint("merge"), "scan_id"), "scan_id", "point_id", "h", "__parts").select("scan_id", part("point_id"), "point_id", "h")

    def run(messages: pa.Table, own: pa.Table) -> pa.Table:
        if not messages.num_rows or not own.num_rows:
            return pa.table({"scan_id": pa.array([], pa.int64()), "point_id": pa.array([], pa.int64()), "h": pa.array([], pa.list_(pa.float64()))})
        src, ids = messages.column("src").to_numpy(), own.column("point_id").to_numpy()
        order = np.lexsort((messages.column("rank").to_numpy(), src))
        src, known = src[order], np.argsort(ids, kind="stable")
        at = known[np.minimum(np.searchsorted(ids, src, sorter=known), len(ids) - 1)]
        held = ids[at] == src
        src, at = src[held], at[held]
        here, there = _matrix(own.column("h"))[at], _matrix(messages.column("far"))[order][held]
        first, out = _aggregate(layers, here, there, src, how)
        scan = np.full(len(first), own.column("scan_id")[0].as_py())
        return pa.table({"scan_id": pa.array(scan, pa.int64()), "point_id": pa.array(src[first], pa.int64()), "h": _lists(out)})

    keys = ("scan_id", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "scan_id long, point_id long, h array<double>")


def scan_edge_layers(nodes: DataFrame, layers: list[Layer], k: int, how: str = "max", message_rows: int = MESSAGE_ROWS) -> DataFrame:
    """`edge_layers` over `knn_features` where one task may hold any scan: edges and neighbours' features are not shuffled.

    Messages are passed in stretches of nodes with at most `message_rows`; point ids are unique in a scan.
    """
    _checked(layers, how)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id")
        ids, h = table.column("point_id").to_numpy(), _matrix(table.column("h"))
        row, dst, _ = kernels.nearest_features(h, ids, h, ids, k)
        dst, step = np.searchsorted(ids, dst), max(1, message_rows // k)
        nodes, out = [], []
        for a in range(0, len(ids), step):
            some = slice(*np.searchsorted(row, [a, a + step]))
            first, found = _aggregate(layers, h[row[some]], h[dst[some]], row[some], how)
            nodes.append(row[some][first])
            out.append(found)
        held = ids[np.concatenate(nodes)]
        return pa.table({"scan_id": pa.array(np.full(len(held), table.column("scan_id")[0].as_py()), pa.int64()), "point_id": pa.array(held, pa.int64()), "h": _lists(np.concatenate(out))})

    return nodes.select("scan_id", "point_id", "h").groupBy("scan_id").applyInArrow(run, "scan_id long, point_id long, h array<double>")


def dense_layers(nodes: DataFrame, layers: list[Layer], log_softmax: bool = False) -> DataFrame:
    """Layers on every node's features alone, in batches; with `log_softmax` the logarithms of the classes' shares."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _run(layers, _matrix(batch.column("h")))
            if log_softmax:
                x = x - x.max(1, keepdims=True)
                x = x - np.log(np.exp(x).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column("scan_id"), batch.column("point_id"), _lists(x)], ["scan_id", "point_id", "h"])

    return nodes.select("scan_id", "point_id", "h").mapInArrow(run, "scan_id long, point_id long, h array<double>")


def pooled(nodes: DataFrame) -> DataFrame:
    """`scan_id, h`: the greatest value of every feature over a scan's nodes; batches send one row a scan."""

    def greatest(scan: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(scan, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(scan[order]) != 0))
        return scan[order][first], np.maximum.reduceat(h[order], first, axis=0)

    def some(batches):
        for batch in batches:
            if batch.num_rows:
                scan, h = greatest(batch.column("scan_id").to_numpy(), _matrix(batch.column("h")))
                yield pa.RecordBatch.from_arrays([pa.array(scan), _lists(h)], ["scan_id", "h"])

    def last(table: pa.Table) -> pa.Table:
        scan, h = greatest(table.column("scan_id").to_numpy(), _matrix(table.column("h")))
        return pa.table({"scan_id": scan, "h": _lists(h)})

    schema = "scan_id long, h array<double>"
    return nodes.select("scan_id", "h").mapInArrow(some, schema).groupBy("scan_id").applyInArrow(last, schema)


def _near_layers(nodes: DataFrame, layers: list[Layer], k: int, how: str, whole: bool) -> DataFrame:
    """Edge layers over the k nearest: of a `whole` scan in one task, or by tiles."""
    return scan_edge_layers(nodes, layers, k, how) if whole else edge_layers(knn_features(nodes, k), nodes, layers, how)


def scan_matrices(nodes: DataFrame, layers: dict[str, Layer], k: int = 3, whole: bool = False) -> DataFrame:
    """`scan_id, h`: a matrix of every scan, row by row, from edge layers over k neighbours, node layers, the greatest, and layers on it.

    With `whole` a task holds any scan.
    """
    found = _near_layers(nodes, _of(layers, "turn.edge."), k, "max", whole)
    scans = pooled(dense_layers(found, _of(layers, "turn.node."))).withColumn("point_id", F.lit(0).cast("long"))
    return dense_layers(scans, _of(layers, "turn.scan.")).select("scan_id", "h")


def turned(nodes: DataFrame, matrices: DataFrame) -> DataFrame:
    """Features times their scan's matrix (scan_id, h)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                h = _matrix(batch.column("h"))
                m = _matrix(batch.column("m")).reshape(len(h), h.shape[1], h.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("scan_id"), batch.column("point_id"), _lists((h[:, None, :] @ m)[:, 0])], ["scan_id", "point_id", "h"])

    joined = nodes.join(matrices.select("scan_id", F.col("h").alias("m")).hint("merge"), "scan_id")
    return joined.select("scan_id", "point_id", "h", "m").mapInArrow(run, "scan_id long, point_id long, h array<double>")


def _forward(nodes: DataFrame, layers: dict[str, Layer], k: int, cut, how: str, turn_k: int, whole: bool) -> DataFrame:
    if _of(layers, "turn.scan."):
        nodes = cut(turned(nodes, scan_matrices(nodes, layers, turn_k, whole)))
    past, number = [], 0
    while steps := _of(layers, f"conv{number}."):
        nodes = cut(_near_layers(nodes, steps, k, how, whole))
        past.append(nodes.withColumnRenamed("h", f"h{number}"))
        number += 1
    every = past[0]
    for other in past[1:]:
        every = every.join(other.hint("merge"), ["scan_id", "point_id"])
    every = every.withColumn("h", F.concat(*[f"h{i}" for i in range(number)]))
    return dense_layers(every, _of(layers, "head."), log_softmax=True)


def dynamic_network(
    points: DataFrame, layers: dict[str, Layer], k: int, cut, features: tuple[str, ...] = ("x", "y", "z"), how: str = "max", turn_k: int = 3, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`scan_id, point_id, h`: logarithms of the classes' shares of every point by a dynamic graph network.

    Every edge layer finds the k nearest nodes (each node is one of its own) among the features of the layer before;
    the head works on the features of all edge layers together.  `layers` are named `conv<layer>.<step>` and `head.<step>`;
    with `turn.edge.<step>`, `turn.node.<step>` and `turn.scan.<step>` each scan is first multiplied by a matrix that
    these make of it: edge layers over `turn_k` neighbours, node layers, the greatest over the scan, and layers on that.
    Points with a null or a value that is not finite take no part.  A scan of up to `block_rows` points takes one task a
    layer, larger ones go by tiles.  `cut` stores each layer's nodes where all executors can read them, as they are read several times.
    """
    nodes = cut(nodes_of(points, list(features)))
    large = cut(nodes.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("scan_id"))
    if large.isEmpty():
        return _forward(nodes, layers, k, cut, how, turn_k, True)
    parts = [(nodes.join(large, "scan_id", "left_anti"), True), (nodes.join(large, "scan_id", "left_semi"), False)]
    small, tiled = (_forward(cut(part), layers, k, cut, how, turn_k, whole) for part, whole in parts)
    return small.unionByName(tiled)
