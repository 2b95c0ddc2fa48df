"""Queries do the whole job: results against brute force, also where their SQL covers a part only."""

import numpy as np
import pandas as pd
import pytest

from talus.plans import catalogue, fixtures

QUERIES = catalogue.queries()
LARGER = "/root/testdata/sf0.1"


def _closure(ids, near):
    """The least id that each id reaches over the pairs of `near`."""
    label = dict(zip(ids, ids))
    while True:
        new = {i: min([label[i], *[label[j] for j in near[i]]]) for i in ids}
        if new == label:
            return label
        label = new


def test_single_linkage_cut_keeps_all_trees(spark):
    rows = fixtures.disc(spark, LARGER).toPandas()
    want = {}
    for tree, t in rows.groupby("tree_id"):
        p, ids = t[["x", "y"]].to_numpy(), t["id"].tolist()
        dx, dy = p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1]
        below = np.sqrt(dx * dx + dy * dy) < 0.06
        want |= {(tree, i): c for i, c in _closure(ids, {i: [ids[k] for k in np.flatnonzero(below[n])] for n, i in enumerate(ids)}).items()}
    got = {(r.tree_id, r.id): r.cc for r in QUERIES["single_linkage_cut"](spark, LARGER).toPandas().itertuples()}
    assert max(t for t, _ in want) >= 20
    assert got == want


def test_knn_batch_loop_takes_all_points(spark, sf_dir):
    want = []
    for scan, t in fixtures.points(spark, sf_dir).toPandas().sort_values("point_id").groupby("scan_id"):
        p, ids = t[["x", "y", "z"]].to_numpy(), t["point_id"].to_numpy()
        for i, own in enumerate(ids):
            d2 = np.zeros(len(p))
            for axis in range(3):
                diff = p[i, axis] - p[:, axis]
                d2 += diff * diff
            near = np.lexsort((ids, np.sqrt(d2)))[:5]
            want += [(scan, own, ids[n], r) for r, n in enumerate(near, 1)]
    got = QUERIES["knn_batch_loop"](spark, sf_dir).toPandas()
    assert set(got[["scan_id", "src", "dst", "rank"]].itertuples(index=False, name=None)) == set(want)
    assert len(got) == len(want)


def test_knn_with_loop_keeps_ties_and_lone_points(spark):
    from talus.operators import graph as G

    rows = [(0, 7, 1.0), (0, 3, 1.0), (0, 5, 1.0), (0, 9, 2.0), (1, 4, 0.0)]
    p = spark.createDataFrame(rows, "scan_id long, point_id long, x double").selectExpr("*", "0.0D as y", "0.0D as z")
    got = G.knn(p, 2, loop=True).toPandas()
    pairs = {(r.src, r.rank): (r.dst, r.d) for r in got.itertuples()}
    assert pairs[7, 1] == (3, 0.0) and pairs[7, 2] == (5, 0.0)
    assert pairs[9, 1] == (9, 0.0) and pairs[9, 2] == (3, 1.0)
    assert pairs[4, 1] == (4, 0.0) and (4, 2) not in pairs


def _rand(a, b):
    """Adjusted Rand index of two labellings."""
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    both = np.array([[np.sum((a == x) & (b == y)) for y in np.unique(b)] for x in np.unique(a)])
    ab, pa, pb, every = pairs(both), pairs(both.sum(1)), pairs(both.sum(0)), len(a) * (len(a) - 1) / 2
    most, chance = (pa + pb) / 2, pa * pb / every
    return 1.0 if most == chance else (ab - chance) / (most - chance)


def test_best_k_tries_four_more_than_the_classes(spark):
    d = "/root/testdata/sf0.01"
    want = {}
    for tree, t in fixtures.disc(spark, d).toPandas().groupby("tree_id"):
        p, y = t[["x", "y"]].to_numpy(), t["cls"].to_numpy()
        far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        label, scores = np.arange(len(p)), {}
        while True:
            scores[len(np.unique(label))] = round(_rand(y, label), 9)
            apart = np.where(label[:, None] != label[None], far, np.inf)
            if not np.isfinite(apart).any():
                break
            i, j = np.unravel_index(apart.argmin(), apart.shape)
            label[label == label[j]] = label[i]
        want[tree] = max((scores[k], -k) for k in range(1, y.max() + 6))
    got = QUERIES["best_k"](spark, d).toPandas()
    assert any(-k > 10 for _, k in want.values())
    assert {r.tree_id: r.k for r in got.itertuples()} == {t: -k for t, (_, k) in want.items()}
    assert {r.tree_id: r.ari for r in got.itertuples()} == pytest.approx({t: s for t, (s, _) in want.items()}, abs=2e-6)


def _step(p, edges, threshold, k, k_normals):
    """Labels of one round, all pairs compared."""
    n = len(p)
    far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    near = np.argsort(far + np.where(np.eye(n, dtype=bool), -1, 0), axis=1, kind="stable")
    links = edges.copy()
    for i in range(n):
        links[i, near[i, 1 : k + 1]] = links[near[i, 1 : k + 1], i] = True

    def zones(joined):
        label = np.arange(n)
        while True:
            new = np.where(joined | np.eye(n, dtype=bool), label[None], n).min(1)
            if (new == label).all():
                return label
            label = new

    parts = zones(links)
    names = np.unique(parts)
    for a in names:
        own = np.flatnonzero(parts == a)
        others = sorted((far[np.ix_(own, parts == b)].min(), b) for b in names if b != a)[:3]
        for _, b in others:
            there = np.flatnonzero(parts == b)
            i, j = np.unravel_index(far[np.ix_(own, there)].argmin(), (len(own), len(there)))
            s = own[np.argsort(far[own, there[j]], kind="stable")][: max(min(30, len(own) - 1), 1)]
            t = there[np.argsort(far[there, own[i]], kind="stable")][: max(min(30, len(there) - 1), 1)]
            for x in s:
                for y in t:
                    if far[x, y] < 12.0:
                        links[x, y] = links[y, x] = True
    nz = np.empty(n)
    for i in range(n):
        q = p[near[i, : k_normals + 1]]
        nz[i] = abs(np.linalg.eigh(np.cov(q.T, bias=True) if len(q) > 1 else np.zeros((3, 3)))[1][2, 0])
    r = (p[:, 2] - p[:, 2].min()) * (1 + np.exp(-32 * (nz - 0.7)))
    return zones(links & (np.abs(r[:, None] - r[None]) < threshold))


def _iterative(p, edges, threshold, min_size, most, k, k_normals):
    first = label = _step(p, edges, threshold, k, k_normals)
    left, rounds = np.arange(len(p)), 0
    while len(np.unique(label)) > 20 and rounds < 10:
        large = [c for c in np.unique(label) if (label == c).sum() > min_size]
        low = sorted(large, key=lambda c: (round(p[left][label == c, 2].mean(), 9), c))[:most]
        left = left[np.isin(label, low)]
        label = _step(p[left], edges[np.ix_(left, left)], threshold, k, k_normals) if len(left) else label[:0]
        rounds += 1
    return np.isin(first, first[left]), rounds


def test_iterative_ground_goes_on_in_every_scan_by_itself(spark):
    from talus.operators import detection as D
    from talus.storage import stored

    draw = np.random.default_rng(5)
    scans, want, rounds = [], {}, []
    for scan, (n, spread) in enumerate([(220, 0.02), (300, 0.6), (260, 1.5), (240, 0.3)]):
        p = np.c_[draw.uniform(-20, 20, (n, 2)), draw.normal(0, spread, n)]
        edges = np.zeros((n, n), bool)
        edges[np.arange(n - 1), np.arange(1, n)] = np.abs(np.diff(p[:, 2])) < 0.1
        edges |= edges.T
        ground, took = _iterative(p, edges, 0.2, 3, 10, 4, 8)
        rounds.append(took)
        want |= {(scan, i): bool(g) for i, g in enumerate(ground)}
        scans.append((scan, p, edges))
    points = spark.createDataFrame([(s, i, *map(float, q)) for s, p, _ in scans for i, q in enumerate(p)], "scan_id long, point_id long, x double, y double, z double")
    edges = spark.createDataFrame([(s, int(i), int(j), 1.0) for s, _, e in scans for i, j in np.argwhere(e)], "scan_id long, src long, dst long, w double")
    got = D.iterative_ground(points, edges, 0.2, 3, 10, stored, k=4, k_normals=8).toPandas()
    assert len(set(rounds)) > 1, rounds
    assert {(r.scan_id, r.point_id): r.ground for r in got.itertuples()} == want


def _board(height, width, r0, c0, res):
    """Cells of the dart board, ring by ring from the outermost radius."""
    size, radii = max(height, width), []
    for i in range(64):
        r = round(abs(1.73 * np.tan(np.radians(90 + i * 26.9 / 64)) * res))
        radii.append(size if r > height + width else r)
    index = next(i for i in range(64) if radii[i] < size)
    rings, r = {}, height + width
    while r > 0 and index < 64:
        while r > radii[index]:
            rings[r] = index + 1
            r -= 1
        index += 1
    rings |= {x: 65 for x in range(r + 1)}
    row, col = np.mgrid[:height, :width]
    ring = np.vectorize(rings.get)(np.sqrt((row - r0) ** 2 + (col - c0) ** 2).astype(int))
    sector = np.round(180 + 180 * np.arctan2(row - r0, col - c0) / (2 * np.pi)).astype(int)
    sector[r0, c0] = 0
    return ring, sector


def test_dart_board_has_the_rings_of_the_scan_lines(spark):
    from talus.operators import detection as D

    for height, width, r0, c0, res in ((40, 40, 20, 20, 0.5), (90, 70, 41, 30, 2.0)):
        ring, sector = _board(height, width, r0, c0, res)
        pixels = [(0, i, j, r0, c0, height, width) for i in range(height) for j in range(width)]
        got = D.dart_board(spark.createDataFrame(pixels, "scan_id long, row long, col long, r0 long, c0 long, height long, width long"), res).toPandas()
        assert len(got) == height * width
        assert (got["ring"] == ring[got["row"], got["col"]]).all()
        assert (got["sector"] == sector[got["row"], got["col"]]).all()
        cells = np.zeros((height, width), np.int64)
        cells[got["row"], got["col"]] = got["cell"]
        for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:, 1:], np.s_[:, :-1])):
            assert ((cells[a] == cells[b]) == ((ring[a] == ring[b]) & (sector[a] == sector[b]))).all()


def test_opened_square_drops_thin_parts(spark):
    from talus.operators import raster as R

    image = np.zeros((6, 7), int)
    image[1:3, 1:3] = image[4, 1:6] = image[1:5, 5] = 1
    rows = spark.createDataFrame([(0, i, j, int(image[i, j])) for i in range(6) for j in range(7)], "scan_id long, row long, col long, v int")
    got = {(r.row, r.col) for r in R.opened_square(rows, "v").toPandas().itertuples() if r.v}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2)}


@pytest.mark.parametrize("additive", [False, True])
def test_spanning_forest_matches_merging_by_hand(spark, additive):
    from talus.operators import graph as G

    draw = np.random.default_rng(6)
    rows, want = [], {}
    for scan in range(3):
        edges = sorted({(float(draw.integers(1, 9)), *sorted(map(int, draw.choice(12, 2, replace=False)))) for _ in range(18)}, key=lambda e: e)
        least = {}
        for w, a, b in edges:
            least[a, b] = min(w, least.get((a, b), w))
        rows += [(scan, *((a, b) if draw.random() < 0.5 else (b, a)), w) for (a, b), w in least.items()]
        sets = [{i} for i in range(12)]
        step = 0
        for w, a, b in sorted((w, a, b) for (a, b), w in least.items()):
            x, y = (next(s for s in sets if i in s) for i in (a, b))
            if x is not y:
                want[scan, a, b] = (w * min(len(x), len(y)) if additive else w, step, len(x), len(y))
                sets = [s for s in sets if s is not x and s is not y] + [x | y]
                step += 1
    got = G.spanning_forest(spark.createDataFrame(rows, "scan_id long, src long, dst long, w double"), additive).collect()
    assert {(r.scan_id, r.src, r.dst): (r.w, r.step, r.n_src, r.n_dst) for r in got} == want


def test_ransac_picks_do_not_overflow(spark):
    from talus.operators import detection as D

    rows = [(s, o, i, float(i % 5), float(i // 5), 0.0) for s, o in ((7, 3), (1 << 40, (1 << 60) + 5)) for i in range(20)]
    p = spark.createDataFrame(rows, "scan_id long, other long, point_id long, x double, y double, z double")
    got = D.ransac_plane(p, 0.1, 10, group=("scan_id", "other")).collect()
    assert {(r.scan_id, r.other, r.n_inliers) for r in got} == {(7, 3, 20), (1 << 40, (1 << 60) + 5, 20)}


def test_labels_of_several_sequences_stay_apart(spark, tmp_path):
    from talus.sources import scans as S

    for sequence in ("00", "01"):
        for kind in ("velodyne", "labels"):
            (tmp_path / "sequences" / sequence / kind).mkdir(parents=True)
        np.arange(16, dtype="<f4").tofile(tmp_path / "sequences" / sequence / "velodyne" / "000003.bin")
        np.full(4, int(sequence) + 40, "<u4").tofile(tmp_path / "sequences" / sequence / "labels" / "000003.label")
    points, labels = S.read_scans(spark, f"file://{tmp_path}"), S.read_labels(spark, f"file://{tmp_path}")
    got = S.unique_scans(S.labelled_scans(points, labels))
    assert got.count() == 8 and got.select("scan_id").distinct().count() == 2
    assert {(r.sequence, r.label) for r in got.collect()} == {("00", 40), ("01", 41)}
    with pytest.raises(ValueError, match="sequence 01, scan 3"):
        S.labelled_scans(points, labels.where("sequence <> '01' or point_id > 0"))


@pytest.mark.parametrize("neighbours", [4, 6, 8])
def test_scanner_circle_floods_from_the_scanner(spark, neighbours):
    from talus.operators import detection as D

    square = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    # Odd rows lie half a pixel to the right.
    hexagon = lambda r: [(0, 1), (0, -1), *((d, r % 2 - k) for d in (1, -1) for k in (0, 1))]
    steps = {4: lambda r: square, 6: hexagon, 8: lambda r: [*square, (1, 1), (1, -1), (-1, 1), (-1, -1)]}[neighbours]

    draw = np.random.default_rng(7)
    rows, want = [], {}
    for scan, (r0, c0) in enumerate(((6, 5), (2, 9), (6, 6))):
        held = draw.random((13, 12)) < 0.35
        held[r0, c0] = scan == 2
        seen, todo = set(), [] if held[r0, c0] else [(r0, c0)]
        while todo:
            r, c = todo.pop()
            if (r, c) in seen or not (0 <= r < 13 and 0 <= c < 12) or held[r, c]:
                continue
            seen.add((r, c))
            todo += [(r + dr, c + dc) for dr, dc in steps(r)]
        for r, c in np.ndindex(13, 12):
            rows.append((scan, r, c, int(held[r, c]), r0, c0))
            want[scan, r, c] = int((r, c) in seen and abs(r - r0) <= 4 and abs(c - c0) <= 4)
    raster = spark.createDataFrame(rows, "scan_id long, row long, col long, im_acc long, r0 long, c0 long")
    got = D.scanner_circle(raster, 4, neighbours).collect()
    assert {(r.scan_id, r.row, r.col): r.inside for r in got} == want
