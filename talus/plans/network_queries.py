"""Queries of networks with given weights: graphs made again between layers, and images, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from talus.operators import convolution as C
from talus.operators import gnn, networks
from talus.operators import graph as G
from talus.operators.networks import Layer
from talus.plans.fixtures import points, r6
from talus.plans.graph_queries import knn_sql
from talus.plans.point_queries import FILL_SQL, _pts, filled, pixels_sql, spherical_sql
from talus.storage import stored

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def weights(outputs: int, inputs: int, seed: int) -> np.ndarray:
    """Stand-ins for trained weights, by rule: quarters from -1 to 1."""
    return ((np.arange(outputs * inputs) * 7 + seed * 5) % 9 - 4).reshape(outputs, inputs) / 4.0


# ---- graph networks ------------------------------------------------------------------------------


@register(
    "dynamic_features",
    _pts(
        knn_sql(4)
        + """ select k.scan_id, k.src, k.dst, """
        + ", ".join(f"round(a.{c}, 6) + 0e0 as i_{c}, round(b.{c} - a.{c}, 6) + 0e0 as g_{c}" for c in "xyz")
        + """ from kn k join points a on a.scan_id = k.scan_id and a.point_id = k.src join points b on b.scan_id = k.scan_id and b.point_id = k.dst"""
    ),
)
def dynamic_features(spark, d):
    """Every point's features beside what its neighbours' differ by."""
    cloud = points(spark, d)
    found = gnn.edge_features(G.knn(cloud, 4).select("scan_id", "src", "dst"), cloud, list("xyz"))
    return found.select("scan_id", "src", "dst", *[r6(f"{p}_{c}").alias(f"{p}_{c}") for c in "xyz" for p in "ig"])


GRAPH_K = 4
GRAPH = {
    "conv0.0": Layer(weights(3, 6, 1), bias=np.array([0.5, -0.25, 0.125]), slope=0.2),
    "conv1.0": Layer(weights(3, 6, 2), scale=np.array([0.5, 1.5, 0.75]), shift=np.array([0.25, 0.0, -0.5]), slope=0.2),
    "head.0": Layer(weights(4, 6, 3) / 16, slope=0.2),
    "head.1": Layer(weights(2, 4, 4), bias=np.array([0.125, -0.125])),
}


def layer_sql(layer: Layer, inputs: list[str]) -> list[str]:
    """The outputs of a layer over expressions."""
    out = []
    for k, row in enumerate(layer.weight):
        y = " + ".join(f"({w}e0) * {x}" for w, x in zip(row, inputs))
        y = f"({y}" + (f" + ({layer.bias[k]}e0))" if layer.bias is not None else ")")
        y = f"({y} * ({layer.scale[k]}e0) + ({layer.shift[k]}e0))" if layer.scale is not None else y
        out.append(y if layer.slope == 1.0 else f"(case when {y} > 0 then {y} else {layer.slope}e0 * {y} end)")
    return out


def edge_layer_sql(source: str, out: str, layer: Layer, k: int) -> str:
    """Table `out`: the layer over each node's k nearest, itself among them, in the features h0 to h2 of `source`."""
    d2 = " + ".join(f"(a.h{c}-b.h{c})*(a.h{c}-b.h{c})" for c in range(3))
    inputs = [f"a{c}" for c in range(3)] + [f"(b{c} - a{c})" for c in range(3)]
    ends = ", ".join(f"a.h{c} as a{c}, b.h{c} as b{c}" for c in range(3))
    best = ", ".join(f"max({y}) as h{i}" for i, y in enumerate(layer_sql(layer, inputs)))
    return f"""{out}_near as (
  select a.scan_id, a.point_id, {ends}, row_number() over (partition by a.scan_id, a.point_id order by sqrt({d2}), b.point_id) as rank
  from {source} a join {source} b on a.scan_id = b.scan_id
), {out} as (select scan_id, point_id, {best} from {out}_near where rank <= {k} group by 1, 2)"""


def _graph_sql() -> str:
    shared = [f"f{i}" for i in range(6)]
    hidden = ", ".join(f"{y} as h{i}" for i, y in enumerate(layer_sql(GRAPH["head.0"], shared)))
    last = layer_sql(GRAPH["head.1"], [f"h{i}" for i in range(4)])
    first, second = edge_layer_sql("n0", "n1", GRAPH["conv0.0"], GRAPH_K), edge_layer_sql("n1", "n2", GRAPH["conv1.0"], GRAPH_K)
    return f"""n0 as (select scan_id, point_id, x as h0, y as h1, z as h2 from points), {first}, {second}, hidden_in as (
  select scan_id, point_id, n1.h0 as f0, n1.h1 as f1, n1.h2 as f2, n2.h0 as f3, n2.h1 as f4, n2.h2 as f5 from n1 join n2 using (scan_id, point_id)
), hidden as (select scan_id, point_id, {hidden} from hidden_in), classes as (
  select scan_id, point_id, {last[0]} as a, {last[1]} as b from hidden
)
select scan_id, point_id, round(a - greatest(a, b) - ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) + 0e0 as class0,
  round(b - greatest(a, b) - ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) + 0e0 as class1 from classes"""


@register("dynamic_network", _pts(_graph_sql()))
def dynamic_network(spark, d):
    """Two edge layers, each on neighbours among the features before it, and a head."""
    out = networks.dynamic_network(points(spark, d), GRAPH, GRAPH_K, stored)
    return out.select("scan_id", "point_id", *[r6(F.get("h", F.lit(c))).alias(f"class{c}") for c in range(2)])


TURNED = GRAPH | {
    "turn.edge.0": Layer(weights(4, 6, 5), slope=0.2),
    "turn.node.0": Layer(weights(5, 4, 6), slope=0.2),
    "turn.scan.0": Layer(weights(4, 5, 7) / 64, slope=0.2),
    "turn.scan.1": Layer(weights(9, 4, 8) / 64, bias=np.eye(3).ravel()),
}


@register("dynamic_network_turned")
def dynamic_network_turned(spark, d):
    """The same behind a matrix that each scan's own points give; brute force in the tests."""
    out = networks.dynamic_network(points(spark, d), TURNED, GRAPH_K, stored)
    return out.select("scan_id", "point_id", *[r6(F.get("h", F.lit(c))).alias(f"class{c}") for c in range(2)])


# ---- images --------------------------------------------------------------------------------------

FULL = pixels_sql() + ", " + FILL_SQL
CONV = Layer(weights(2, 18, 1), bias=np.array([0.5, -0.5]), slope=0.0)


def _conv_sql() -> str:
    """Every tap as a join of pixels, zeros outside the image."""
    taps = ", ".join(f"({r - 1}, {c - 1}, " + ", ".join(f"{CONV.weight[o, ch * 9 + r * 3 + c]}e0" for o in range(2) for ch in range(2)) + ")" for r in range(3) for c in range(3))
    h = ", ".join(f"round(greatest(0e0, sum(w{o}0 * b.zmax + w{o}1 * b.n) + ({CONV.bias[o]}e0)), 6) + 0e0 as h{o}" for o in range(2))
    return f"""taps as (select * from (values {taps}) t(dr, dc, w00, w01, w10, w11))
select a.scan_id, a.row, a.col, {h} from full_ a, taps t join full_ b on b.scan_id = a.scan_id and b.row = a.row + dr and b.col = a.col + dc group by 1, 2, 3"""


@register("image_convolution", _pts(FULL + ", " + _conv_sql()))
def image_convolution(spark, d):
    """Two filters of 3 x 3 over height and count of the fixture's rasters."""
    out = C.map_images(filled(spark, d), ["zmax", "n"], lambda image: C.convolve(image, CONV), ["h0", "h1"])
    return out.withColumns({c: r6(c) for c in ("h0", "h1")})


@register(
    "image_pooling",
    _pts(FULL + " select f.scan_id, row // 3 as row, col // 2 as col, max(n)::double as n from full_ f join box b using (scan_id) where row // 3 < height // 3 and col // 2 < width // 2 group by 1, 2, 3"),
)
def image_pooling(spark, d):
    return C.map_images(filled(spark, d), ["n"], lambda image: C.pool(image, (3, 2)), ["n"])


@register(
    "image_enlargement",
    _pts(
        FULL
        + """, grid as (
  select scan_id, height, width, r.row, c.col, r.row * ((height - 1)::double / (2 * height - 1)) as ay, c.col * ((width - 1)::double / (3 * width - 1)) as ax
  from box, unnest(range(0, 2 * height)) r(row), unnest(range(0, 3 * width)) c(col)
), corner as (
  select *, floor(ay)::bigint as y0, floor(ax)::bigint as x0, least(floor(ay)::bigint + 1, height - 1) as y1, least(floor(ax)::bigint + 1, width - 1) as x1 from grid
)
select g.scan_id, g.row, g.col,
  round((p.n * (1 - (ay - y0)) + q.n * (ay - y0)) * (1 - (ax - x0)) + (r.n * (1 - (ay - y0)) + s.n * (ay - y0)) * (ax - x0), 6) + 0e0 as n
from corner g
join full_ p on p.scan_id = g.scan_id and p.row = y0 and p.col = x0 join full_ q on q.scan_id = g.scan_id and q.row = y1 and q.col = x0
join full_ r on r.scan_id = g.scan_id and r.row = y0 and r.col = x1 join full_ s on s.scan_id = g.scan_id and s.row = y1 and s.col = x1"""
    ),
)
def image_enlargement(spark, d):
    return C.map_images(filled(spark, d), ["n"], lambda image: C.enlarge(image, (2, 3)), ["n"]).withColumn("n", r6("n"))


#: Means and deviations of range, height and intensity.
MEANS, DEVIATIONS, FOV = [12.5, -1.0, 0.25], [10.0, 0.5, 0.25], (1.2, 1.9)


@register(
    "range_image",
    _pts(
        spherical_sql()
        + """, held as (
  select scan_id, row, col, max(sqrt(x*x+y*y+z*z)) as rho, min(z) as low, avg(i) as i from sp where lidx >= 0 group by 1, 2, 3
), grid as (
  select scan_id, r.row, c.col from (select distinct scan_id from points), unnest(range(0, 16)) r(row), unnest(range(0, 64)) c(col)
)
select g.scan_id, g.row, g.col, round((coalesce(rho, 0e0) - 12.5e0) / 10e0, 6) + 0e0 as rho, round((coalesce(low, 0e0) + 1e0) / 0.5e0, 6) + 0e0 as low,
  round((coalesce(i, 0e0) - 0.25e0) / 0.25e0, 6) + 0e0 as i from grid g left join held using (scan_id, row, col)"""
    ),
)
def range_image(spark, d):
    """Standardised channels of every scan's range image."""
    out = C.range_image(points(spark, d), MEANS, DEVIATIONS, 64, 16, FOV)
    return out.withColumns({c: r6(c) for c in C.CHANNELS})


def _image_layers() -> dict[str, Layer]:
    """Two levels of six channels in, with double convolutions."""
    shapes = {"in.0": (4, 6), "in.1": (4, 4), "down0.0": (8, 4), "down0.1": (8, 8), "down1.0": (8, 8), "down1.1": (8, 8), "up0.0": (8, 16), "up0.1": (4, 8), "up1.0": (4, 8), "up1.1": (4, 4)}
    out = {}
    for seed, (name, (o, c)) in enumerate(shapes.items(), 1):
        out[name] = Layer(weights(o, 9 * c, seed) / (2 * c), bias=np.arange(o) / 8 - 0.25, scale=np.full(o, 1.25), shift=np.full(o, 0.0625), slope=0.0)
    return out | {"out": Layer(weights(1, 4, 3), bias=np.array([-0.25]))}


IMAGE = _image_layers()


@register("network_ground")
def network_ground(spark, d):
    """An encoder-decoder of two levels over range, height, intensity and normals; brute force in the tests."""
    out = C.network_ground(points(spark, d), IMAGE, MEANS, DEVIATIONS, 64, 16, FOV, normals=True, scale=(1, 2))
    return out.select("scan_id", "point_id", r6("score").alias("score"), "ground")
