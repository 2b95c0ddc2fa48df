"""Message passing on neighbour graphs with given weights, and rotation-invariant features."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.geometry import norm
from talus.operators import kernels
from talus.operators.graph import with_ends

AGGREGATES = {"max": F.max, "mean": F.avg, "add": F.sum, "min": F.min}


def linear(inputs: list[Column], weights: list[list[float]], relu: bool = True) -> list[Column]:
    """Rows of weights times inputs, rectified."""
    out = [sum((F.lit(float(w)) * x for w, x in zip(row[1:], inputs[1:])), F.lit(float(row[0])) * inputs[0]) for row in weights]
    return [F.greatest(x, F.lit(0.0)) for x in out] if relu else out


def edge_features(edges: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Every edge with x_i (the source's) and x_j - x_i, as i_<f> and g_<f>."""
    ends = with_ends(edges, nodes, features)
    return ends.withColumns({f"i_{f}": F.col(f"s_{f}") for f in features} | {f"g_{f}": F.col(f"d_{f}") - F.col(f"s_{f}") for f in features})


def edge_conv(edges: DataFrame, nodes: DataFrame, features: list[str], weights: list[list[float]], how: str = "max") -> DataFrame:
    """For each source the aggregate over its edges of a layer on (x_i, x_j - x_i); outputs h0, h1, ..."""
    rows = edge_features(edges, nodes, features)
    out = linear([F.col(f"i_{f}") for f in features] + [F.col(f"g_{f}") for f in features], weights)
    return rows.groupBy("scan_id", F.col("src").alias("point_id")).agg(*[AGGREGATES[how](h).alias(f"h{k}") for k, h in enumerate(out)])


def morphological_conv(edges: DataFrame, nodes: DataFrame, features: list[str], weights: list[list[float]], erode: bool = False, negative: bool = True) -> DataFrame:
    """Max-plus dilation max(x_j - relu(w)) or min-plus erosion min(x_j + relu(w)) (`negative`: min(x_j - relu(w))).

    `weights` has a row for each neighbour rank and a column for each filter; output h<filter>_<feature>.
    """
    ends = with_ends(edges.select("scan_id", "src", "dst", "rank"), nodes, features)
    sign = 1.0 if erode and not negative else -1.0
    out = []
    for k in range(len(weights[0])):
        table = F.array(*[F.lit(sign * max(float(row[k]), 0.0)) for row in weights])
        for f in features:
            out.append((F.min if erode else F.max)(F.col(f"d_{f}") + F.element_at(table, F.col("rank").cast("int"))).alias(f"h{k}_{f}"))
    return ends.groupBy("scan_id", F.col("src").alias("point_id")).agg(*out)


def max_plus(inputs: list[Column], weights: list[list[float]]) -> list[Column]:
    """Products in the (max, +) algebra: for each column of weights the greatest of input less relu(weight)."""
    less = lambda x, w: x - F.lit(max(float(w), 0.0))
    out = []
    for k in range(len(weights[0])):
        terms = [less(x, row[k]) for x, row in zip(inputs, weights, strict=True)]
        out.append(F.greatest(*terms) if len(terms) > 1 else terms[0])
    return out


def layered_morphological_conv(edges: DataFrame, nodes: DataFrame, features: list[str], weights: list[list[float]], offsets: list[list[float]], how: str = "max") -> DataFrame:
    """A layer on (x_i, x_j - x_i) of every ranked edge, less relu of the offset of its rank, aggregated over the source.

    `weights` has a row a filter; `offsets` has a row a rank and a column a filter; output h<filter>.
    """
    ends = with_ends(edges.select("scan_id", "src", "dst", "rank"), nodes, features)
    inputs = [F.col(f"s_{f}") for f in features] + [F.col(f"d_{f}") - F.col(f"s_{f}") for f in features]
    out = []
    for k, h in enumerate(linear(inputs, weights)):
        table = F.array(*[F.lit(max(float(row[k]), 0.0)) for row in offsets])
        out.append(AGGREGATES[how](h - F.element_at(table, F.col("rank").cast("int"))).alias(f"h{k}"))
    return ends.groupBy("scan_id", F.col("src").alias("point_id")).agg(*out)


def bilateral_conv(edges: DataFrame, nodes: DataFrame, features: list[str], places: list[str], r: float = 1.0, s: float = 1.0) -> DataFrame:
    """Feature differences weighted by exp(-|h_i - h_j| / r² - |p_i - p_j| / s²), normalised over each source."""
    ends = with_ends(edges, nodes, list(dict.fromkeys(features + places)))
    gap = lambda cols: norm(*[F.col(f"s_{c}") - F.col(f"d_{c}") for c in cols])
    w = F.exp(-gap(features) / (r * r + 1e-16) - gap(places) / (s * s + 1e-16))
    rows = ends.withColumn("__w", w)
    out = [(F.sum((F.col(f"s_{f}") - F.col(f"d_{f}")) * F.col("__w")) / (F.sum("__w") + F.lit(1e-16))).alias(f"h_{f}") for f in features]
    return rows.groupBy("scan_id", F.col("src").alias("point_id")).agg(*out)


def attention_conv(edges: DataFrame, nodes: DataFrame, feature: str, lam: float) -> DataFrame:
    """Softmax attention of x_i - x_j over each source, kept where it passes `lam`; the sum of x_j times it."""
    ends = with_ends(edges, nodes, [feature])
    over = Window.partitionBy("scan_id", "src")
    e = F.exp(F.col("__a") - F.max("__a").over(over))
    rows = ends.withColumn("__a", F.col(f"s_{feature}") - F.col(f"d_{feature}")).withColumn("__e", e)
    alpha = F.col("__e") / F.sum("__e").over(over)
    rows = rows.withColumn("__p", alpha)
    kept = F.col("__p") / (F.abs(F.col("__p") - F.lit(lam)) + 1e-5) * F.greatest(F.col("__p") - F.lit(lam), F.lit(0.0))
    return rows.groupBy("scan_id", F.col("src").alias("point_id")).agg(F.sum(F.col(f"d_{feature}") * kept).alias("h"))


def invariant_features(points: DataFrame, k: int) -> DataFrame:
    """Rotation-invariant features (src, dst, rho_i, rho_j, theta, phi) of every point and neighbour.

    theta is the angle between both directions from the origin; phi the least angle, seen along the
    source's direction, to another neighbour; null where a direction has no length.  A scan of two
    points has no other neighbour and gives no row.  One task works on one scan.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("point_id"))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        p = np.stack([np.asarray(table.column(c)) for c in "xyz"], axis=1)[order]
        who, _ = kernels.nearest(p, k)
        n, m = who.shape if who.shape[1] > 1 else (0, 0)
        rho_i, rho_j, theta, phi = (x.ravel() for x in kernels.invariant(p, who)) if n else [np.empty(0)] * 4
        columns = {"rho_i": np.repeat(rho_i, m), "rho_j": rho_j, "theta": theta, "phi": phi}
        scan = np.full(n * m, np.asarray(table.column("scan_id"))[0])
        out = {"scan_id": pa.array(scan, pa.int64()), "src": pa.array(np.repeat(ids[:n], m), pa.int64()), "dst": pa.array(ids[who.ravel()[: n * m]], pa.int64())}
        return pa.table(out | {c: pa.array(v, pa.float64(), from_pandas=True) for c, v in columns.items()})

    rows = points.select(F.col("scan_id").cast("long").alias("scan_id"), F.col("point_id").cast("long").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return rows.groupBy("scan_id").applyInArrow(run, "scan_id long, src long, dst long, rho_i double, rho_j double, theta double, phi double")
