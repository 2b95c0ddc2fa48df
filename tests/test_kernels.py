"""NumPy kernels against brute force, and the golden spanning tree."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.operators import kernels as K

EDGES = st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14), st.integers(0, 5)), max_size=40)


def _columns(edges):
    return (np.array([e[k] for e in edges], np.int64 if k < 2 else float) for k in range(3))


@settings(deadline=None, max_examples=60)
@given(EDGES)
def test_components_match_a_forest(edges):
    src, dst, _ = _columns(edges)
    forest = K.Forest(15)
    for a, b, _ in edges:
        forest.union(a, b)
    assert K.components(15, src, dst).tolist() == [forest.find(i) for i in range(15)]


@settings(deadline=None, max_examples=40)
@given(EDGES)
def test_thresholded_tree_has_the_components_of_the_thresholded_graph(edges):
    src, dst, w = _columns(edges)
    kept = np.array([e for e in K.spanning_tree(15, src, dst, w)[0] if w[e] < 3], np.int64)
    low = w < 3
    assert (K.components(15, src[kept], dst[kept]) == K.components(15, src[low], dst[low])).all()


def test_golden_spanning_tree():
    src, dst, w = np.array([0, 0, 1, 1, 2]), np.array([1, 3, 2, 3, 3]), np.array([8.0, 3, 2, 5, 6])
    kept, sizes = K.spanning_tree(4, src, dst, w)
    assert sizes == [(1, 1), (1, 1), (2, 2)]
    assert sorted((int(src[e]), int(dst[e])) for e in kept) == [(0, 3), (1, 2), (1, 3)]
    assert w[kept].sum() == 10


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 12, (700, 3)).astype(float)
    who, far = K.nearest(p, 5, block=64)
    for i in range(len(p)):
        d = np.sqrt(((p - p[i]) ** 2).sum(1))
        d[i] = np.inf
        want = np.lexsort((np.arange(len(p)), d))[:5]
        assert who[i].tolist() == want.tolist()
        assert np.allclose(far[i], d[want])


def test_merge_tree_is_ultrametric():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(20, 2))
    a, b = np.triu_indices(20, 1)
    z = K.merge_tree(20, a, b, np.sqrt(((p[a] - p[b]) ** 2).sum(1)))
    assert len(z) == 19 and z[-1, 3] == 20
    assert (np.diff(z[:, 2]) >= 0).all()


def _cloth(low, mask, step, rigidness, local, masked, most=200, eps=0.01):
    """The cloth cell by cell."""
    h, w = low.shape
    now, before, fixed = np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w), bool)
    for _ in range(most):
        new = np.where(fixed, now, 2 * now - before + step)
        for i, j in np.ndindex(h, w):
            if new[i, j] >= low[i, j]:
                fixed[i, j], new[i, j] = True, low[i, j]
        for _ in range(rigidness):
            old = new.copy()
            for i, j in np.ndindex(h, w):
                total = n = 0
                for di, dj in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1), (2, 0), (-2, 0), (0, 2), (0, -2)):
                    a, b = (i + di, j + dj) if 0 <= i + di < h and 0 <= j + dj < w else (i, j)
                    if mask[a, b] or not masked:
                        total, n = total + old[a, b], n + 1
                if not fixed[i, j]:
                    new[i, j] += local * ((total / n if n else 0.0) - old[i, j])
        move = np.abs(now - new)[mask].max()
        before, now = now, new
        if move <= eps:
            break
    return now


def test_cloth_matches_the_loop():
    rng = np.random.default_rng(8)
    for masked in (False, True):
        mask = rng.random((9, 7)) < 0.6
        low = np.where(mask, rng.integers(1, 20, (9, 7)), 255).astype(float)
        assert np.allclose(K.cloth(low, mask, 0.4, 3, 0.7, masked=masked), _cloth(low, mask, 0.4, 3, 0.7, masked))


def test_cloth_rests_on_a_flat_floor():
    low, mask = np.full((8, 8), 5.0), np.ones((8, 8), bool)
    assert np.allclose(K.cloth(low, mask, 0.4), 5.0)


def test_eigen_normals_of_a_plane():
    rng = np.random.default_rng(3)
    p = np.c_[rng.normal(size=(50, 2)), np.zeros(50)]
    who, _ = K.nearest(p, 8)
    normals, values = K.eigen_normals(p, who)
    assert np.allclose(np.abs(normals[:, 2]), 1) and np.allclose(values[:, 0], 0)


def test_degenerate_inputs():
    assert K.nearest(np.zeros((1, 3)), 3)[0].shape == (1, 0)
    assert K.components(3, np.array([], int), np.array([], int)).tolist() == [0, 1, 2]
