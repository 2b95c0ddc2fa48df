"""Sources and sinks: label configurations, point files, reports, file lists; and normals by name."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import detection as D
from talus.operators import hierarchy as T
from talus.operators import metrics as M
from talus.sources import scans as S

CONFIG = """
labels: {0: unlabeled, 10: car, 40: road, 252: moving-car}
color_map: {0: [0, 0, 0], 10: [245, 150, 100], 40: [255, 0, 255]}
content: {0: 0.02, 10: 0.04}
learning_map: {0: 0, 10: 1, 40: 9, 252: 1}
learning_map_inv: {0: 0, 1: 10, 9: 40}
learning_ignore: {0: true, 1: false}
split: {train: [0, 1], valid: [8]}
"""


def test_label_configuration(spark, tmp_path):
    path = tmp_path / "labels.yaml"
    path.write_text(CONFIG)
    got = {r.label: r for r in S.label_config(spark, str(path)).collect()}
    assert got[252].learn_id == 1 and got[252].learn_label == 10 and got[252].content is None and got[252].r == 0
    assert (got[10].r, got[10].g, got[10].b) == (100, 150, 245) and got[40].is_ground == 1 and not got[10].ignored and got[0].ignored
    assert set(map(tuple, S.label_splits(spark, str(path)).collect())) == {("train", "00"), ("train", "01"), ("valid", "08")}


def _las(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Coordinates, user data and colours of a point file, read field by field."""
    assert data[:4] == b"LASF" and data[24:26] == bytes([1, 2])
    start, kind, size, n = struct.unpack_from("<I", data, 96)[0], data[104], *struct.unpack_from("<HI", data, 105)
    scale, low = np.array(struct.unpack_from("<3d", data, 131)), np.array(struct.unpack_from("<3d", data, 155))
    assert len(data) == start + n * size
    xyz = np.array([struct.unpack_from("<3i", data, start + i * size) for i in range(n)]) * scale + low
    user = np.array([data[start + i * size + 17] for i in range(n)])
    rgb = np.array([struct.unpack_from("<3H", data, start + i * size + 20) for i in range(n)]) if kind == 2 else None
    return xyz, user, rgb


def test_las_files_of_scans(spark, tmp_path):
    rows = [(s, i, s + i * 0.5, -i * 0.25, i * 0.125, 40 + i, 10 * i, 5, 255) for s in (3, 4) for i in range(7)]
    points = spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double, label int, r int, g int, b int")
    for colour in (None, ("r", "g", "b")):
        folder = tmp_path / f"las-{colour is None}"
        done = S.write_las(points, str(folder), "label", colour).collect()
        assert sorted(p.name for p in folder.iterdir()) == ["3.las", "4.las"] and {r.n_points for r in done} == {7}
        for s in (3, 4):
            xyz, user, rgb = _las((folder / f"{s}.las").read_bytes())
            own = [r for r in rows if r[0] == s]
            assert np.allclose(xyz, [r[2:5] for r in own], atol=6e-4) and user.tolist() == [r[5] for r in own]
            assert rgb is None if colour is None else rgb.tolist() == [list(r[6:]) for r in own]


def test_reports_gather_by_method(spark, tmp_path):
    rows = spark.createDataFrame([(s, t, p) for s in (2, 1) for t, p in ((40, 40), (40, 10), (10, 10), (10, 10))], "scan_id long, t int, p int")
    scores = M.binary_scores(rows, F.col("t") == 40, F.col("p") == 40, ["scan_id"])
    matrices = rows.groupBy("scan_id", F.col("t").alias("truth"), F.col("p").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(s, t, p) for s in (1, 2) for t in (10, 40) for p in (10, 40)], "scan_id long, truth int, pred int")
    matrices = grid.join(matrices, ["scan_id", "truth", "pred"], "left").fillna(0)
    for method in ("one", "two"):
        S.write_reports(S.score_reports(scores, matrices, method), f"file://{tmp_path}/reports")
    got = S.gathered_reports(spark, f"file://{tmp_path}/reports", "two").collect()
    assert [r.scan_id for r in got] == [1, 2]
    assert got[0].report == "Scan 1\nF1 0.666667\nRecall 0.5\nPrecision 1.0\nAccuracy 0.75\nJaccard 0.5\nConfusion\n2 0\n1 1"


def test_sequence_files_are_listed_sorted_and_sliced(spark, tmp_path):
    for i in (3, 1, 2, 0):
        (tmp_path / f"{i:06d}.bin").write_bytes(b"some")
    (tmp_path / "notes.txt").write_text("x")
    got = S.sequence_files(spark, f"file://{tmp_path}", 1, None, 2)
    assert [p.rsplit("/", 1)[1] for p in got] == ["000001.bin", "000003.bin"]
    with pytest.raises(ValueError, match="notes.txt"):
        S.read_scans(spark, [f"{tmp_path}/notes.txt"])


def test_normals_by_name(spark):
    # Scan lines of a flat floor around the scanner, in the order of the file.
    rows, n = [], 0
    for line in range(8):
        for step in range(64):
            a = -np.pi + (step + 0.5) * 2 * np.pi / 64
            rows.append((0, n, float((4 + line) * np.cos(a)), float((4 + line) * np.sin(a)), -1.73))
            n += 1
    points = spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double")
    flat = D.normals(points, "pca", k=8).toPandas()
    assert len(flat) == n and np.allclose(flat.nz, 1)
    image = D.normals(points, res_yaw=64, layers=8)
    assert image.count() == 8 * 64
    back = D.normals(points, res_yaw=64, layers=8, back_project=True)
    assert back.count() == n and set(back.columns) == {"scan_id", "point_id", "nx", "ny", "nz"}
    with pytest.raises(ValueError, match="spherical or pca"):
        D.normals(points, "other")


def test_angle_linkage_matches_merging_by_hand(spark):
    draw = np.random.default_rng(3)
    v = draw.normal(size=(14, 2))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    far = np.arccos(np.clip(u @ u.T, -1, 1))
    items = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(v)], "tree_id long, id long, x double, y double")
    pairs = T.pairs(items, ["x", "y"]).select("tree_id", "a", "b", T.angle([F.col("a_x"), F.col("a_y")], [F.col("b_x"), F.col("b_y")]).alias("w"))
    got = T.single_linkage(pairs).orderBy("step").toPandas()
    sets, heights = [{i} for i in range(14)], []
    while len(sets) > 1:
        d, i, j = min((min(far[a, b] for a in x for b in y), i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j)
        heights.append((d, len(sets[i]) + len(sets[j])))
        sets = [s for k, s in enumerate(sets) if k not in (i, j)] + [sets[i] | sets[j]]
    assert np.allclose(got["dist"], [h for h, _ in heights]) and got["cnt"].tolist() == [c for _, c in heights]
    zero = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert zero.select(T.angle([F.col("a"), F.col("b")], [F.col("c"), F.col("d")]).alias("w")).first().w is None


def test_votes_take_the_least_of_equally_common_labels(spark):
    rows = [(0, i, float(x), 0.0, 0.0, i, v) for i, (x, v) in enumerate(((0, 7), (1, 5), (2, 9), (50, 9)))]
    rows += [(0, 10, 0.9, 0.0, 0.0, 99, 1), (0, 11, 49.0, 0.0, 0.0, 99, 1)]
    points = spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double, lidx long, v int")
    got = {r.point_id: r.score for r in D.transfer_labels(points, "v", how="vote").collect()}
    assert got == {10: 5.0, 11: 9.0}
