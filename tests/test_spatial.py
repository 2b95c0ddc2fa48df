"""Cell-wise neighbours, global forests and scan lines against brute force."""

import numpy as np
import pytest

from talus.operators import components, kernels
from talus.operators import graph as G
from talus.operators import points as P
from talus.operators.cells import knn_cells
from talus.plans import catalogue, fixtures
from talus.storage import stored


def _cloud(kind, rng):
    if kind == "even":
        return rng.uniform(0, 100, (700, 3))
    if kind == "hot and far":
        return np.concatenate([rng.normal(50, 0.01, (400, 3)), rng.uniform(0, 100, (300, 3)), [[1e5, 3, 3], [-4e4, 2e4, 0], [1e5, 3, 4]]])
    if kind == "copies":
        return np.concatenate([np.repeat([[5.0, 5.0, 5.0]], 300, 0), rng.integers(0, 9, (300, 3)).astype(float)])
    if kind == "line":
        return np.stack([np.arange(150.0), np.zeros(150), np.zeros(150)], 1)
    return rng.uniform(0, 1, (4, 3))


@pytest.mark.parametrize("kind, k, fill", [("even", 5, 16), ("hot and far", 4, 16), ("copies", 6, 8), ("line", 3, 8), ("fewer than k", 6, 8)])
def test_cells_find_what_all_pairs_find(spark, kind, k, fill):
    p = _cloud(kind, np.random.default_rng(1))
    rows = [(0, 3 * i, *map(float, x), "z") for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double, level string")
    want = set()
    for i, a in enumerate(p):
        d2 = (a[0] - p[:, 0]) ** 2 + (a[1] - p[:, 1]) ** 2 + (a[2] - p[:, 2]) ** 2
        near = [j for j in np.lexsort((np.arange(len(p)), np.sqrt(d2))) if j != i][:k]
        want |= {(0, 3 * i, 3 * int(j), float(np.sqrt(d2[j])), r) for r, j in enumerate(near, 1)}
    got = [tuple(r) for r in knn_cells(df, k, stored, fill=fill).collect()]
    assert len(got) == len(want) and set(got) == want


def test_cells_of_nothing(spark):
    df = spark.createDataFrame([], "scan_id long, point_id long, x double, y double, z double")
    assert knn_cells(df, 3, stored).count() == 0


def test_other_metrics():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(300, 3))
    plain = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    who, far = kernels.nearest_by(p, 6, plain)
    want, d = kernels.nearest(p, 6)
    assert (who == want).all() and np.allclose(far, d)
    assert kernels.nearest_by(p[:1], 3, plain)[0].shape == (1, 0)
    assert kernels.cosine(np.array([[1.0, 0], [0, 0]]), np.array([[2.0, 0], [0, 3]])).tolist() == [[0, 1], [1, 1]]


def _kruskal(edges):
    root, out = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for w, u, v in sorted({(w, min(u, v), max(u, v)) for u, v, w in edges if u != v and w is not None}):
        a, b = find(u), find(v)
        if a != b:
            root[a] = b
            out.add((u, v, w))
    return out


def test_global_forest_equals_kruskal(spark):
    rng = np.random.default_rng(5)
    graphs = [
        [(int(u), int(v), float(w)) for u, v, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(0, 6, 150))],
        [(i, i + 1, float(-i)) for i in range(70)],
        [(0, i, 1.0) for i in range(1, 80)] + [(5, 5, 0.0), (1, 2, None), (2, 1, 0.5), (1, 2, 0.7)],
    ]
    for edges in graphs:
        df = spark.createDataFrame(edges, "u long, v long, w double")
        got = [tuple(r) for r in components.global_spanning_forest(df, stored).collect()]
        assert len(got) == len(set(got)) and set(got) == _kruskal(edges)
    assert components.global_spanning_forest(df.limit(0), stored).count() == 0


def test_registered_forests_equal_kruskal(spark, sf_dir):
    queries = catalogue.queries()
    edges = [(r["src"], r["dst"], r["w"]) for r in fixtures.supply(spark, sf_dir).collect()]
    assert {tuple(r) for r in queries["spanning_forest_global"](spark, sf_dir).collect()} == _kruskal(edges)
    cloud = fixtures.points(spark, sf_dir).drop("scan_id").selectExpr("*", "0L as scan_id")
    edges = [(r["src"], r["dst"], r["d"]) for r in G.knn(cloud, 4).collect()]
    assert {tuple(r) for r in queries["spanning_forest_neighbours"](spark, sf_dir).collect()} == _kruskal(edges)


def _layers(x, y, most, window=20):
    """Line by line in file order: intervals of positions, then their numbers from the end."""
    angle, n, half = np.arctan2(y, x), len(x), window // 2
    low = [angle[max(0, i - half) : i + window - half].min() for i in range(n)]
    opened = np.array([max(low[max(0, i - (window - half - 1)) : i + half + 1]) for i in range(n)])
    changes = [i for i in range(1, n) if opened[i] >= 0 > opened[i - 1]]
    edges = [0, *changes, n]
    lines = list(zip(edges, edges[1:]))
    if 1 < len(lines) < most:
        _, end = lines.pop(0)
        falls = [i for i in range(end - 1) if opened[i + 1] < opened[i]]
        falls = falls[: most - len(lines)] if len(falls) > most - len(lines) else falls
        new = []
        for i, at in enumerate(falls):
            if i == 0:
                new.append((0, at))
            else:
                # A cut list still ends where the first line ended.
                new.append((at, end if i == len(falls) - 1 else falls[i + 1]))
        lines = new + lines
    out = [0] * n
    for k, (a, b) in enumerate(reversed(lines)):
        out[a:b] = [most - k - 1] * (b - a)
    return out


def test_lines_are_split_again_where_some_lack(spark):
    rng = np.random.default_rng(9)
    turns = [np.linspace(-3, 3, 90), np.concatenate([np.sin(np.arange(400) / 9) * 1.5 - 1.6, *[np.linspace(-3, 3, 60)] * 3]), rng.uniform(-3, 3, 500), np.full(40, -1.0)]
    turns += [np.concatenate([np.linspace(-0.1, -3, 30), np.linspace(-3, 3, 80)])]
    rows = [(s, i, float(np.cos(t)), float(np.sin(t))) for s, angles in enumerate(turns) for i, t in enumerate(angles)]
    df = spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double")
    for most in (3, 6, 64):
        got = {(r["scan_id"], r["point_id"]): r["layer"] for r in P.scan_layers(df, most).collect()}
        for s in range(len(turns)):
            x, y = np.array([(r[2], r[3]) for r in rows if r[0] == s]).T
            want = _layers(x, y, most)
            have = [got[s, i] for i in range(len(x))]
            # Scans of more lines than asked for have negative numbers.
            assert have == want, (most, s)
