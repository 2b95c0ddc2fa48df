"""Steps of the iterative ground search: one task a scan gives what the operators give one by one."""

import numpy as np
from pyspark.sql import functions as F

from talus.operators import detection as D
from talus.operators import graph as G
from talus.storage import stored


def test_step_as_by_operators(spark):
    rng = np.random.default_rng(4)
    # Clusters far apart, so that there are parts to connect; one scan holds a single point.
    rows = [(s, 10 * i + s, *map(float, rng.integers(0, 4, 3) + 6 * (i % 5) * np.array([1, 0, 0.1]))) for s in range(2) for i in range(120)] + [(2, 7, 1.0, 1.0, 1.0)]
    points = stored(spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double"))
    ends = rng.integers(0, 120, (40, 2)) * 10
    # One edge leaves the points, one scan has no edge.
    edges = stored(spark.createDataFrame([(0, int(u), int(v), 1.0) for u, v in ends if u != v] + [(0, 10, 99999, 1.0)], "scan_id long, src long, dst long, w double"))
    nodes = points.select("scan_id", F.col("point_id").alias("node_id"))
    known = G.subgraph(edges, nodes)
    normals = stored(D.pca_normals(points, 8))
    graph = stored(G.merge_graphs(known, G.knn_graph(points, 4)))
    parts = stored(G.connected_components(graph, nodes).join(points.withColumnRenamed("point_id", "node_id"), ["scan_id", "node_id"]))
    assert parts.select("scan_id", "cc").distinct().count() > 3
    every = graph.select(*G.EDGE).unionByName(G.connect_components(parts).select(*G.EDGE)).distinct()
    want = G.quasi_flat_zones(G.height_weights(every, points, normals), 0.7, nodes)
    got = D.iterative_step(points, edges, 0.7, stored, 4, 8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_members_are_not_joined_to_links(spark, capsys):
    labelled = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 0.0)], "scan_id long, node_id long, cc long, x double, y double, z double")
    G.connect_components(labelled).explain()
    assert "Join" not in capsys.readouterr().out
