"""Forests that start inside parts of a cloud: any parts give the same forest, and rounds see only what they leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators.cells import cloud_parts, knn_cells
from talus.operators.components import global_spanning_forest
from talus.storage import stored


@pytest.fixture(scope="module")
def cloud(spark):
    # Few heights and whole numbers, so distances tie.
    p = np.random.default_rng(3).integers(0, 60, (3000, 3)) * [1, 1, 0.1]
    rows = [(0, i, *map(float, q)) for i, q in enumerate(p)]
    return spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double")


def test_parts_give_the_same_forest(spark, cloud, monkeypatch):
    monkeypatch.setattr("talus.operators.cells.PART", 400)
    near = stored(knn_cells(cloud, 3, stored, group=None).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("d").alias("w")))
    # An edge of the same ends again, a loop, a null, and nodes that are in no part.
    odd = spark.createDataFrame([(0, 1, 0.0), (1, 0, 2.0), (7, 7, 0.0), (8, 9, None), (5000, 5001, 1.0), (5001, 3, 1.0)], "u long, v long, w double")
    edges = stored(near.unionByName(odd))
    want = sorted(map(tuple, global_spanning_forest(edges, stored).collect()))
    at = cloud_parts(cloud)
    by_hash = cloud.select(F.col("point_id").alias("node"), (F.col("point_id") % 5).alias("part"))
    one = cloud.select(F.col("point_id").alias("node"), F.lit(1).alias("part"))
    assert at.select("part").distinct().count() > 4
    for parts in (at, by_hash, one):
        assert sorted(map(tuple, global_spanning_forest(edges, stored, parts).collect())) == want
    assert global_spanning_forest(edges.limit(0), stored, at).count() == 0


def test_rounds_see_only_what_parts_leave(spark, cloud, monkeypatch):
    monkeypatch.setattr("talus.operators.cells.PART", 750)
    near = stored(knn_cells(cloud, 4, stored, group=None).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("d").alias("w")))
    sizes = []

    def cut(df):
        out = stored(df)
        sizes.append((out.columns, out.count()))
        return out

    global_spanning_forest(near, cut, cloud_parts(cloud)).collect()
    rounds = [n for columns, n in sizes if "c" in columns]
    assert rounds and max(rounds) < 3000 / 8
