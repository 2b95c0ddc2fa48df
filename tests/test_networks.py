"""Graph networks and image networks against plain loops."""

import math
import tempfile

import numpy as np
import pytest

from talus.operators import convolution as C
from talus.operators import kernels
from talus.operators import networks as N
from talus.operators.networks import Layer
from talus.plans import catalogue, fixtures
from talus.plans import network_queries as Q
from talus.storage import stored

POINTS = "scan_id long, point_id long, x double, y double, z double, h string, __parts int"


def _near(h, ids, i, k):
    d = [(math.sqrt(sum((a - b) * (a - b) for a, b in zip(h[i], h[j]))), ids[j], j) for j in range(len(h))]
    return [j for _, _, j in sorted(d)[:k]]


def _layer(layer, x):
    out = []
    for k, row in enumerate(np.asarray(layer.weight).reshape(len(layer.weight), -1)):
        y = sum(float(w) * float(v) for w, v in zip(row, x))
        y += float(layer.bias[k]) if layer.bias is not None else 0.0
        y = y * float(layer.scale[k]) if layer.scale is not None else y
        y += float(layer.shift[k]) if layer.shift is not None else 0.0
        out.append(y if y > 0 else layer.slope * y)
    return out


def _all(layers, prefix, x):
    n = 0
    while f"{prefix}{n}" in layers:
        x, n = _layer(layers[f"{prefix}{n}"], x), n + 1
    return x


def _edge(layers, prefix, h, ids, k, how="max"):
    reduce = {"max": max, "min": min, "add": sum, "mean": lambda v: sum(v) / len(v)}[how]
    out = []
    for i in range(len(h)):
        messages = [_all(layers, prefix, [*h[i], *[b - a for a, b in zip(h[i], h[j])]]) for j in _near(h, ids, i, k)]
        out.append([reduce(column) for column in zip(*messages)])
    return out


def _matrix(layers, ids, h, k=3):
    rows = [_all(layers, "turn.node.", x) for x in _edge(layers, "turn.edge.", h, ids, k)]
    return _all(layers, "turn.scan.", [max(c) for c in zip(*rows)])


def _forward(layers, ids, h, k, how="max"):
    every, number = [[] for _ in h], 0
    while f"conv{number}.0" in layers:
        h = _edge(layers, f"conv{number}.", h, ids, k, how)
        every, number = [a + b for a, b in zip(every, h)], number + 1
    out = []
    for x in every:
        x = _all(layers, "head.", x)
        total = math.log(sum(math.exp(v - max(x)) for v in x)) + max(x)
        out.append([v - total for v in x])
    return out


def test_nearest_features_equal_all_pairs():
    rng = np.random.default_rng(3)
    clouds = [rng.normal(size=(300, 9)), rng.integers(0, 3, (300, 4)).astype(float), np.zeros((40, 5)), 1e8 + rng.normal(size=(80, 6)), rng.normal(size=(1, 3))]
    for p in clouds:
        ids = rng.permutation(len(p) * 2)[: len(p)]
        for loop in (True, False):
            row, dst, d = kernels.nearest_features(p, ids, p, ids, 5, loop, block=64)
            for i in range(len(p)):
                want = sorted((math.sqrt(sum((a - b) * (a - b) for a, b in zip(p[i], p[j]))), int(ids[j])) for j in range(len(p)) if loop or j != i)[:5]
                assert list(zip(d[row == i].tolist(), dst[row == i].tolist())) == want


@pytest.mark.parametrize("how", ["max", "min", "add", "mean"])
def test_network_over_many_blocks(spark, how):
    """Tiny blocks, nulls, values that are not finite, copies, columns of the operators' own names, a scan of one point."""
    rng = np.random.default_rng(4)
    rows = [(s, 3 * i + 1, *map(float, rng.integers(0, 6, 3)), "text", 7) for s in (0, 5) for i in range(60)]
    odd = [(0, 500, None, 1.0, 1.0, "a", 1), (0, 501, float("nan"), 1.0, 1.0, "a", 1), (5, 502, float("inf"), 0.0, 0.0, "a", 1), (9, 4, 1.0, 2.0, 3.0, "a", 1)]
    df = spark.createDataFrame(rows + odd, POINTS)
    edges = lambda frame, k, loop=True: N.knn_features(frame, k, loop, block_rows=16)
    nodes = N.nodes_of(df, ["x", "y", "z"])
    got = {(r["scan_id"], r["point_id"]): r["h"] for r in N.edge_layers(edges(nodes, 4), nodes, [Q.GRAPH["conv0.0"]], how, message_rows=50).collect()}
    assert len(got) == 121
    for scan in (0, 5, 9):
        here = [r for r in rows + odd[3:] if r[0] == scan]
        want = _edge(Q.GRAPH, "conv0.", [list(r[2:5]) for r in here], [r[1] for r in here], 4, how)
        for r, w in zip(here, want):
            assert np.allclose(got[scan, r[1]], w)
    found = edges(nodes, 200).groupBy("scan_id").count().collect()
    assert {r["scan_id"]: r["count"] for r in found} == {0: 3600, 5: 3600, 9: 1}
    assert edges(nodes, 3, False).where("src = dst").count() == 0


@pytest.mark.parametrize("how", ["max", "min", "add", "mean"])
def test_layers_of_whole_scans_equal_loops(spark, how):
    """Ids out of order, copies, stretches of messages that end within a scan, a scan of fewer nodes than neighbours."""
    rng = np.random.default_rng(8)
    rows = [(s, int(i), *map(float, rng.integers(0, 6, 3)), "text", 7) for s in (-1, 5) for i in rng.permutation(200)[:60] - 50]
    rows += [(9, 4, 1.0, 2.0, 3.0, "a", 1), (9, 3, 1.0, 2.0, 3.0, "a", 1)]
    odd = [(None, 500, 1.0, 1.0, 1.0, "a", 1), (5, None, 1.0, 1.0, 1.0, "a", 1)]
    nodes = N.nodes_of(spark.createDataFrame(rows + odd, POINTS), ["x", "y", "z"])
    for message_rows in (3, 50, 1000):
        found = N.scan_edge_layers(nodes, [Q.GRAPH["conv0.0"]], 4, how, message_rows).collect()
        got = {(r["scan_id"], r["point_id"]): r["h"] for r in found}
        assert len(got) == len(found) == 122
        for scan in (-1, 5, 9):
            here = [r for r in rows if r[0] == scan]
            for r, w in zip(here, _edge(Q.GRAPH, "conv0.", [list(r[2:5]) for r in here], [r[1] for r in here], 4, how)):
                assert np.allclose(got[scan, r[1]], w)


def test_network_of_small_and_large_scans(spark):
    """Tiled and whole scans side by side; values are exact, so both ways agree on ties."""
    rng = np.random.default_rng(9)
    rows = [(s, i, *map(float, rng.integers(0, 9, 3)), "text", 7) for s, n in ((1, 70), (2, 20), (3, 50), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, POINTS)
    results = []
    for block_rows in (10, 30, 1000):
        found = sorted(N.dynamic_network(df, Q.GRAPH, 4, stored, block_rows=block_rows).collect())
        assert [tuple(r[:2]) for r in found] == [r[:2] for r in rows]
        results.append(np.array([r["h"] for r in found]))
    assert np.allclose(results[0], results[1]) and np.allclose(results[0], results[2])


@pytest.mark.parametrize("name", ["dynamic_network", "dynamic_network_turned"])
def test_networks_of_small_scans_shuffle_no_edges(spark, executed, name):
    """A layer is one grouped function of a scan: no edges meet nodes again, no nodes are broadcast."""
    plans = executed(lambda: catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect())
    assert any("FlatMapGroupsInArrow" in p for p in plans)
    assert not [p for p in plans if "FlatMapCoGroups" in p or "BroadcastExchange" in p]


def test_network_of_nothing(spark):
    df = spark.createDataFrame([], POINTS)
    assert N.dynamic_network(df, Q.TURNED, 4, stored).count() == 0
    with pytest.raises(ValueError):
        N.edge_layers(df, df, [Q.GRAPH["conv0.0"]], "median")
    with pytest.raises(ValueError):
        N.edge_layers(df, df, [])


@pytest.mark.parametrize("name", ["dynamic_network", "dynamic_network_turned"])
def test_registered_networks_equal_loops(spark, name):
    """Points of a lattice are at equal distances, which rounding of a turned lattice breaks: loops go on from the turned points."""
    sf_dir = "/root/testdata/sf0.001"
    got = {(r["scan_id"], r["point_id"]): (r["class0"], r["class1"]) for r in catalogue.queries()[name](spark, sf_dir).collect()}
    nodes = N.nodes_of(fixtures.points(spark, sf_dir), ["x", "y", "z"])
    rows = plain = sorted(nodes.collect())
    if name.endswith("turned"):
        matrices = N.scan_matrices(nodes, Q.TURNED)
        rows = sorted(N.turned(nodes, matrices).collect())
        for scan, m in matrices.collect():
            here = [r for r in plain if r[0] == scan]
            assert np.allclose(m, _matrix(Q.TURNED, [r[1] for r in here], [r[2] for r in here]))
            assert np.allclose([r[2] for r in rows if r[0] == scan], np.array([r[2] for r in here]) @ np.array(m).reshape(3, 3))
    assert len(got) == len(rows) == len(plain)
    for scan in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == scan]
        want = _forward(Q.GRAPH, [r[1] for r in here], [r[2] for r in here], Q.GRAPH_K)
        for r, w in zip(here, want):
            assert np.allclose(got[scan, r[1]], w, atol=2e-6)


def test_layers_as_tables(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/weights"
    N.write_layers(spark, Q.TURNED | Q.IMAGE, path)
    back = N.read_layers(spark, path)
    assert back.keys() == (Q.TURNED | Q.IMAGE).keys()
    for name, layer in (Q.TURNED | Q.IMAGE).items():
        assert back[name].slope == layer.slope
        for part in ("weight", "bias", "scale", "shift"):
            a, b = getattr(layer, part), getattr(back[name], part)
            assert (a is None) == (b is None) and (a is None or np.array_equal(a, b))


def test_normalisation():
    mean, variance, weight, bias = (np.array(v) for v in ([1.0, -2.0], [4.0, 0.25], [2.0, 0.5], [0.5, 3.0]))
    scale, shift = N.normalisation(mean, variance, weight, bias, 0.0)
    x = np.array([[3.0, 4.0], [-1.0, 0.0]])
    assert np.allclose(x * scale + shift, (x - mean) / np.sqrt(variance) * weight + bias)


# ---- images --------------------------------------------------------------------------------------


def _convolved(image, layer):
    channels, height, width = len(image), len(image[0]), len(image[0][0])
    side = round((layer.weight.shape[1] / channels) ** 0.5)
    out = np.zeros((len(layer.weight), height, width))
    for r in range(height):
        for c in range(width):
            taps = []
            for ch in range(channels):
                for dr in range(side):
                    for dc in range(side):
                        a, b = r + dr - side // 2, c + dc - side // 2
                        taps.append(image[ch][a][b] if 0 <= a < height and 0 <= b < width else 0.0)
            out[:, r, c] = _layer(layer, taps)
    return out


def _larger(image, scale):
    channels, height, width = image.shape
    big_h, big_w = height * scale[0], width * scale[1]
    out = np.zeros((channels, big_h, big_w))
    for r in range(big_h):
        for c in range(big_w):
            y = r * (height - 1) / (big_h - 1) if big_h > 1 else 0.0
            x = c * (width - 1) / (big_w - 1) if big_w > 1 else 0.0
            a, b = min(int(y), height - 1), min(int(x), width - 1)
            a2, b2 = min(a + 1, height - 1), min(b + 1, width - 1)
            u, v = y - a, x - b
            out[:, r, c] = (1 - v) * ((1 - u) * image[:, a, b] + u * image[:, a2, b]) + v * ((1 - u) * image[:, a, b2] + u * image[:, a2, b2])
    return out


def _scores(layers, image, scale):
    def steps(x, prefix):
        n = 0
        while f"{prefix}.{n}" in layers:
            x, n = _convolved(x, layers[f"{prefix}.{n}"]), n + 1
        return x

    first = steps(image, "in")
    half = np.array([[[ch[r * scale[0] : (r + 1) * scale[0], c * scale[1] : (c + 1) * scale[1]].max() for c in range(ch.shape[1] // scale[1])] for r in range(ch.shape[0] // scale[0])] for ch in first])
    second = steps(half, "down0")
    quarter = np.array([[[ch[r * scale[0] : (r + 1) * scale[0], c * scale[1] : (c + 1) * scale[1]].max() for c in range(ch.shape[1] // scale[1])] for r in range(ch.shape[0] // scale[0])] for ch in second])
    third = steps(quarter, "down1")
    for at, prefix in ((second, "up0"), (first, "up1")):
        big, whole = _larger(third, scale), np.zeros((len(third), *at.shape[1:]))
        dr, dc = (at.shape[1] - big.shape[1]) // 2, (at.shape[2] - big.shape[2]) // 2
        whole[:, dr : dr + big.shape[1], dc : dc + big.shape[2]] = big
        third = steps(np.concatenate([at, whole]), prefix)
    return _convolved(third, layers["out"])


@pytest.mark.parametrize("shape, scale", [((8, 12), (2, 2)), ((7, 9), (1, 2)), ((5, 6), (2, 1)), ((4, 11), (2, 2))])
def test_encoder_decoder_equals_loops(shape, scale):
    image = np.random.default_rng(6).normal(size=(6, *shape))
    assert np.allclose(C.encoder_decoder(Q.IMAGE, scale)(image), _scores(Q.IMAGE, image, scale))


def test_kernel_that_fits_no_square():
    with pytest.raises(ValueError):
        C.convolve(np.zeros((2, 4, 4)), Layer(np.zeros((1, 8))))


def test_images_of_gaps_and_nulls(spark):
    rows = [(1, 0, 1, 2.0, "a"), (1, 2, 0, None, "b"), (2, 0, 0, 5.0, "c")]
    df = spark.createDataFrame(rows, "scan_id long, row long, col long, v double, part string")
    got = {tuple(r) for r in C.map_images(df, ["v"], lambda image: image + 1, ["v"]).collect()}
    assert got == {(1, r, c, 3.0 if (r, c) == (0, 1) else 1.0) for r in range(3) for c in range(2)} | {(2, 0, 0, 6.0)}
    assert C.map_images(df.limit(0), ["v"], lambda image: image, ["v"]).count() == 0


def test_registered_image_network_equals_loops(spark):
    """Whole result: channels and normals as Spark gives them, then loops, then the nearest points of shared pixels."""
    sf_dir = "/root/testdata/sf0.001"
    cloud = fixtures.points(spark, sf_dir)
    image = np.zeros((6, 16, 64))
    (scan,) = {r["scan_id"] for r in cloud.select("scan_id").distinct().collect()}
    for r in C.range_image(cloud, Q.MEANS, Q.DEVIATIONS, 64, 16, Q.FOV, normals=True).collect():
        image[:, r["row"], r["col"]] = [r[c] for c in (*C.CHANNELS, *C.NORMALS)]
    share = 1 / (1 + np.exp(-_scores(Q.IMAGE, image, (1, 2))[0]))
    px = {r["point_id"]: r for r in Q.C.P.spherical_pixels(cloud, 64, 16, fov_pitch=Q.FOV).collect()}
    held = {}
    for i, r in px.items():
        if r["row"] >= 0:
            held.setdefault((r["row"], r["col"]), []).append(i)
    alone = sorted(i for ids in held.values() if len(ids) == 1 for i in ids)
    p = {i: np.array([r["x"], r["y"], r["z"]]) for i, r in px.items()}
    got = {r["point_id"]: (r["score"], r["ground"]) for r in catalogue.queries()["network_ground"](spark, sf_dir).collect()}
    assert got.keys() == px.keys() and scan == 0
    for i, r in px.items():
        if r["row"] < 0:
            want = 0.0
        elif len(held[r["row"], r["col"]]) == 1:
            want = share[r["row"], r["col"]]
        else:
            near = sorted(alone, key=lambda j: (math.sqrt(((p[i] - p[j]) ** 2).sum()), j))[:3]
            want = sum(share[px[j]["row"], px[j]["col"]] for j in near) / 3
        assert abs(got[i][0] - want) < 2e-6 and got[i][1] == (want > 0.5)
