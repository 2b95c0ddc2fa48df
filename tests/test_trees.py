"""Common ancestors, partition trees of sparse graphs, their losses, and assignments against brute force."""

from itertools import permutations

import numpy as np
import pytest

from talus.operators import hierarchy as T
from talus.operators import kernels
from talus.plans import catalogue
from talus.plans.spatial_queries import neighbour_pairs


def _path(parent, x):
    out = [x]
    while parent[out[-1]] >= 0:
        out.append(int(parent[out[-1]]))
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "star", "forest", "one"])
def test_common_ancestors(kind):
    rng = np.random.default_rng(3)
    n = 1 if kind == "one" else 90
    parent = {
        "random": [-1, *(int(rng.integers(0, i)) for i in range(1, n))], "chain": list(range(-1, n - 1)), "star": [-1] + [0] * (n - 1),
        "forest": [-1 if i % 17 == 0 else int(rng.integers(i // 17 * 17, i)) for i in range(n)], "one": [-1],
    }[kind]
    parent = np.array(parent)
    # Numbers need not follow the tree.
    order = rng.permutation(n)
    moved = np.full(n, -1)
    moved[order] = np.where(parent >= 0, order[parent], -1)
    found = kernels.CommonAncestors(moved)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    paths = [_path(moved, x) for x in range(n)]
    want = [next((x for x in paths[i] if x in set(paths[j])), -1) for i, j in zip(a, b)]
    assert found.of(a, b).tolist() == want
    assert found.depth().tolist() == [len(p) - 1 for p in paths]


def test_circles_are_refused():
    with pytest.raises(ValueError):
        kernels.tour(np.array([1, 0, -1]))


def test_long_chains_take_n_log_n():
    n = 200_000
    found = kernels.CommonAncestors(np.arange(-1, n - 1))
    assert found.of(np.array([5, n - 1]), np.array([n - 1, 7])).tolist() == [5, 7]
    assert sum(len(x) for x in found.least) < 20 * n


def test_questions_on_several_trees(spark):
    rows = [(1, 10, -1), (1, 20, 10), (1, 30, 10), (1, 40, 30), (2, 1, -1), (2, 2, -1), (2, 3, 2)]
    tree = spark.createDataFrame(rows, "tree_id long, node_id long, parent long")
    asked = spark.createDataFrame([(1, 20, 40, "x"), (1, 40, 40, "y"), (1, 20, 99, "z"), (2, 1, 3, "u"), (2, 3, 2, "v"), (7, 1, 1, "w")], "tree_id long, a long, b long, name string")
    got = {(r["name"], r["lca"]) for r in T.lowest_common(asked, tree).collect()}
    assert got == {("x", 10), ("y", 40), ("v", 2)}
    assert T.lowest_common(asked.limit(0), tree).count() == 0
    assert {(r["tree_id"], r["node_id"], r["depth"]) for r in T.depths(tree).collect()} == {(1, 10, 0), (1, 20, 1), (1, 30, 1), (1, 40, 2), (2, 1, 0), (2, 2, 0), (2, 3, 1)}


def _merges(edges):
    """Heights, sizes and least sizes of every pair of items that meet, by growing sets in order of weight."""
    sets, out, made = {}, {}, []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        left, right = sets.setdefault(a, frozenset([a])), sets.setdefault(b, frozenset([b]))
        if left is right:
            continue
        both, least = left | right, min(len(left), len(right))
        for x in left:
            for y in right:
                out[min(x, y), max(x, y)] = (w, len(both), least)
        made.append((w, len(both), least))
        for x in both:
            sets[x] = both
    return out, made


def test_partition_trees_and_losses(spark, sf_dir):
    queries = catalogue.queries()
    edges = neighbour_pairs(spark, sf_dir).toPandas()
    tree, found, losses = (queries[q](spark, sf_dir).toPandas() for q in ("partition_tree", "ultrametric_edges", "ultrametric_losses"))
    assert len(found) == len(edges)
    for t, e in edges.groupby("tree_id"):
        pairs = [(r.a, r.b, r.w) for r in e.itertuples()]
        met, made = _merges(pairs)
        nodes = tree[tree["tree_id"] == t]
        inner = nodes[nodes["id"].isna()]
        assert sorted((round(w, 6), n, m) for w, n, m in made) == sorted(zip(inner["height"], inner["size"], inner["least"]))
        for r in found[found["tree_id"] == t].itertuples():
            w, n, least = met[r.a, r.b]
            assert (r.u, r.size, r.least) == (round(w, 6), n, least)
        u = np.array([met[a, b][0] for a, b, _ in pairs])
        w = np.array([w for _, _, w in pairs])
        closest, size = ((u - w) ** 2).mean(), (u / np.array([met[a, b][2] for a, b, _ in pairs])).max()
        cost = sum(w * met[a, b][1] for a, b, w in pairs)
        own = losses[losses["tree_id"] == t].iloc[0]
        assert np.allclose([own["closest"], own["cluster_size"], own["both"], own["dasgupta"]], [closest, size, closest + 0.5 * size, cost], atol=2e-6)


def test_forests_have_as_many_roots(spark):
    edges = spark.createDataFrame([(0, 5, 9, 2.0), (0, 9, 5, 2.0), (0, 7, 7, 1.0), (0, 1, 2, 0.5), (0, 2, 5, None)], "tree_id long, a long, b long, w double")
    tree = T.partition_tree(edges).toPandas()
    assert (tree["parent"] == -1).sum() == 2 and sorted(tree["id"].dropna()) == [1, 2, 5, 9]
    asked = spark.createDataFrame([(0, 1, 2), (0, 1, 9), (0, 9, 5)], "tree_id long, a long, b long")
    assert {(r["a"], r["b"], r["u"]) for r in T.ultrametric(asked, T.partition_tree(edges)).collect()} == {(1, 2, 0.5), (9, 5, 2.0)}
    assert T.partition_tree(edges.limit(0)).count() == 0


def test_assignment_is_the_best():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 5, 7):
        for high in (2, 50):
            m = rng.integers(0, high, (n, n))
            got = kernels.assignment(m)
            assert sorted(got.tolist()) == list(range(n))
            assert m[np.arange(n), got].sum() == max(sum(m[i, j] for i, j in enumerate(p)) for p in permutations(range(n)))
    hidden = rng.permutation(120)
    m = rng.integers(0, 40, (120, 120))
    m[np.arange(120), hidden] += 100
    assert kernels.assignment(m).tolist() == hidden.tolist()


def test_accuracy_of_many_classes(spark):
    from talus.operators import metrics as M

    rows = [(0, k, (7 * k + 3) % 40) for k in range(40) for _ in range(3)] + [(0, 1, 0), (1, 5, 5)]
    df = spark.createDataFrame(rows, "scan_id long, label long, c long")
    got = {r["scan_id"]: r["accuracy"] for r in M.best_assignment_accuracy(df, "label", "c", "scan_id").collect()}
    assert got == {0: 120 / 121, 1: 1.0}
