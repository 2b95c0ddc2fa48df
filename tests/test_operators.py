"""Defined results at the edges: empty scans, origins, ties, thresholds, unknown names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators import metrics as M
from talus.operators import points as P
from talus.operators import raster as R
from talus.sources import scans as S

SCHEMA = "scan_id long, point_id long, x double, y double, z double, i double, label int"


def frame(spark, rows):
    return spark.createDataFrame([(0, k, *map(float, r), 0.5, 40) for k, r in enumerate(rows)], SCHEMA)


def test_far_border_falls_into_the_last_pixel(spark):
    rows = P.linear_pixels(frame(spark, [(0, 0, 0), (2, 2, 0)]), 1.0, 1.0).orderBy("point_id").collect()
    assert [(r["row"], r["col"]) for r in rows] == [(0, 0), (1, 1)]


def test_origin_has_no_pixel(spark):
    rows = P.spherical_pixels(frame(spark, [(0, 0, 0), (1, 1, 0)]), 8, 8).orderBy("point_id").collect()
    assert rows[0]["lidx"] == -1 and rows[1]["lidx"] >= 0
    assert R.rasterize(P.spherical_pixels(frame(spark, [(0, 0, 0)]), 8, 8), n=F.count(F.lit(1))).count() == 0


def test_ties_go_to_the_lowest_id(spark):
    px = frame(spark, [(0, 0, 1), (0, 0, 1)]).withColumns({"row": F.lit(0), "col": F.lit(0), "lidx": F.lit(0)}).withColumn("label", F.col("point_id"))
    assert R.rasterize(px, a=R.aggregate("argmax", F.col("label"), F.col("z"))).first()["a"] == 0


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        P.project(frame(spark, []), "cubic")
    with pytest.raises(ValueError):
        R.aggregate("median", F.col("z"))
    with pytest.raises(ValueError):
        G.threshold_edges(frame(spark, []), 1.0, "other")


def test_threshold_is_strict_below_and_inclusive_above(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0)], "scan_id long, src long, dst long, w double")
    assert G.threshold_edges(e, 1.0).count() == 0
    assert G.threshold_edges(e, 1.0, "similarity").count() == 1


def test_merge_graphs_commutes_and_mixes_signs(spark):
    mk = lambda w: spark.createDataFrame([(0, 1, 2, w)], "scan_id long, src long, dst long, w double")
    assert G.merge_graphs(mk(2.0), mk(-3.0)).first()["w"] == -1.0
    assert G.merge_graphs(mk(2.0), mk(5.0)).first()["w"] == G.merge_graphs(mk(5.0), mk(2.0)).first()["w"] == 5.0


def test_labels_round_trip_with_the_high_bit(spark):
    row = spark.createDataFrame([(0x80000001,)], "v long").select(*P.unpack_label(F.col("v"))).first()
    assert tuple(row) == (1, 0x8000)


def test_scores_of_nothing_are_zero(spark):
    df = spark.createDataFrame([(False, False)], "t boolean, p boolean")
    row = M.binary_scores(df, F.col("t"), F.col("p")).first()
    assert (row["recall"], row["precision"], row["f1"], row["acc"]) == (0.0, 0.0, 0.0, 1.0)


def test_condensing_keeps_the_total(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (1, 1)], "t int, p int")
    cm = M.confusion(df, "t", "p", [1, 2])
    groups = spark.createDataFrame([(1, 0), (2, 0)], "label int, grp int")
    assert M.condense(cm, groups).first()["n"] == 3


def test_scans_round_trip(spark, tmp_path):
    folder = tmp_path / "sequences" / "07" / "velodyne"
    folder.mkdir(parents=True)
    p = np.random.default_rng(1).normal(size=(5, 4)).astype("<f4")
    (folder / "000003.bin").write_bytes(p.tobytes())
    labels = np.array([40, 72 + (3 << 16), 0, 10, 50], "<u4")
    (folder / "000003.label").write_bytes(labels.tobytes())
    points = S.read_scans(spark, str(folder))
    got = S.labelled_scans(points, S.read_labels(spark, str(folder))).orderBy("point_id").toPandas()
    assert got["sequence"].unique().tolist() == ["07"] and got["scan_id"].unique().tolist() == [3]
    assert np.array_equal(got[["x", "y", "z", "i"]].to_numpy(np.float32), p)
    assert got["label"].tolist() == [40, 72, 0, 10, 50] and got["instance"].tolist() == [0, 3, 0, 0, 0]


def test_toys_are_seeded(spark):
    for kind in S.TOYS:
        a, b = (S.toy_samples(spark, kind, 3, 40, seed=5).orderBy("sample_id", "point_id").toPandas() for _ in range(2))
        assert a.equals(b) and a.groupby("sample_id").size().between(20, 40).all()


def test_stream_counts(spark, sf_dir, tmp_path):
    from talus.plans.fixtures import points
    from talus.streaming import scores

    rows = points(spark, sf_dir).select("z", "label")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scores.point_stream(spark, str(tmp_path / "in"), rows.schema, 1)
    query = scores.start(scores.running_confusion(stream, F.col("label"), F.col("z") < -1.5), "counts", str(tmp_path / "state"))
    query.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == rows.count()
