"""Running sums, samples, curves, tree edits and plane counts over rows that no task holds, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talus.operators import detection as D
from talus.operators import metrics as M
from talus.operators import points as P
from talus.operators import trees as T
from talus.operators.ordered import ranked, running
from talus.storage import stored


def _rows():
    rng = random.Random(8)
    return [(g, rng.randint(0, 9), i, rng.randint(-5, 5), "a") for i, g in enumerate([1] * 300 + [None] * 40 + [7] + [2] * 30)]


def test_running_sums_by_group(spark):
    """A hot group, null groups, ties, a column named as the operator's own."""
    df = spark.createDataFrame(_rows(), "g int, v int, id long, w int, held string").repartition(7)
    got = running(df, ["g"], [F.desc("v"), F.col("id")], {"total": F.col("w")}, stored).collect()
    want = {}
    for g in (1, None, 7, 2):
        here = sorted([r for r in _rows() if r[0] == g], key=lambda r: (-r[1], r[2]))
        total = 0
        for r in here:
            total += r[3]
            want[r[2]] = (total, sum(x[3] for x in here))
    assert {r["id"]: (r["total"], r["total_all"]) for r in got} == want
    assert ranked(df.limit(0), ["g"], [F.col("id")], stored).count() == 0


def test_quota_sample_of_a_hot_group(spark):
    df = spark.createDataFrame([(r[0], r[2], r[1]) for r in _rows()], "g int, id long, n int").repartition(5)
    got = P.quota_sample(df, "g", ["id"], F.ceil(F.col("n") * 0.1), stored)
    want = set()
    for g in (1, None, 7, 2):
        ids = sorted(r[2] for r in _rows() if r[0] == g)
        want |= set(ids[: math.ceil(len(ids) * 0.1)])
    assert {r["id"] for r in got.collect()} == want and got.columns == ["g", "id", "n"]


def test_curve_equals_loops(spark):
    rows = [(r[3] > 0, float(r[1])) for r in _rows()]
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in M.precision_recall(spark.createDataFrame(rows, "t boolean, s double"), F.col("t"), F.col("s"), stored).collect()}
    for s in {r[1] for r in rows}:
        above = [t for t, v in rows if v >= s]
        assert got[s] == pytest.approx((sum(above) / len(above), sum(above) / sum(t for t, _ in rows)))


def _tree(kind):
    if kind == "chain":
        return [(1, 3 * i, 3 * i + 3 if i < 199 else -1) for i in range(200)]
    if kind == "star and roots":
        return [(1, 5, None)] + [(1, 10 + i, 5) for i in range(50)] + [(2, 8, 8), (2, 9, 8), (2, 4, 77), (3, 0, -1)]
    rng = random.Random(1)
    return [(4, i, rng.choice(range(i + 1, 120)) if i < 119 else -1) for i in range(120)]


@pytest.mark.parametrize("kind", ["chain", "star and roots", "random"])
@pytest.mark.parametrize("levels", [False, True])
def test_renumbering_equals_loops(spark, kind, levels):
    rows = _tree(kind)
    up = {(t, n): p for t, n, p in rows}

    def depth(t, n):
        d = 0
        while up[t, n] is not None and up[t, n] != n and (t, up[t, n]) in up:
            n, d = up[t, n], d + 1
        return d

    place, want = {}, set()
    for t in {r[0] for r in rows}:
        for i, (_, n) in enumerate(sorted((depth(t, n) if levels else 0, n) for tt, n, _ in rows if tt == t)):
            place[t, n] = i
    for t, n, p in rows:
        want.add((t, place[t, n], place[t, p] if depth(t, n) else -1, depth(t, n), f"node {n}"))
    df = spark.createDataFrame([(*r, f"node {r[1]}") for r in rows], "tree_id long, node_id long, parent long, name string")
    got = T.renumber(df, stored, levels).select("tree_id", "node_id", "parent", "depth", "name").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_trees_that_are_none(spark):
    schema = "tree_id long, node_id long, parent long"
    with pytest.raises(ValueError, match="circle"):
        T.tree_depths(spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1)], schema), lambda df: spark.createDataFrame(df.toArrow()))
    with pytest.raises(ValueError, match="twice"):
        T.renumber(spark.createDataFrame([(1, 1, -1), (1, 1, -1)], schema), stored)
    assert T.renumber(spark.createDataFrame([], schema), stored).count() == 0


def test_added_nodes(spark):
    tree = spark.createDataFrame([(1, 4, -1, 0.5), (1, 7, 4, 0.25)], "tree_id long, node_id long, parent long, height double")
    new = spark.createDataFrame([(1, 7), (1, 4), (9, None)], "tree_id long, parent long")
    assert {tuple(r) for r in T.add_nodes(tree, new, stored).collect()} == {(1, 4, -1, 0.5), (1, 7, 4, 0.25), (1, 8, 4, None), (1, 9, 7, None), (9, 0, None, None)}
    assert T.add_nodes(tree, new.limit(0), stored).count() == 2


def test_plane_counts_over_parts_of_a_cloud(spark, monkeypatch):
    """A scan in many parts, a scan without planes, null coordinates."""
    monkeypatch.setattr(D, "PLANE_POINTS", 16)
    rng = random.Random(2)
    cloud = [(s, i, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0, 1)) for s, n in ((1, 200), (2, 2), (3, 30)) for i in range(n)]
    df = spark.createDataFrame([*cloud, (3, 90, None, 1.0, 1.0)], "scan_id long, point_id long, x double, y double, z double")
    planes = D.planes(df.where("x is not null"), 12)
    got = {(r["scan_id"], r["t"]): r["n_inliers"] for r in D.plane_inliers(df, planes, 0.2).collect()}
    want = {}
    for r in planes.collect():
        n = (r["nx"], r["ny"], r["nz"])
        far = [abs(n[0] * (x - r["px"]) + n[1] * (y - r["py"]) + n[2] * (z - r["pz"])) / math.sqrt(n[0] ** 2 + n[1] ** 2 + n[2] ** 2) for s, _, x, y, z in cloud if s == r["scan_id"]]
        want[r["scan_id"], r["t"]] = sum(f < 0.2 for f in far)
    assert got == want and {s for s, _ in got} == {1, 3}
