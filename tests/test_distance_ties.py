"""Ties of distances between components."""

import numpy as np

from talus.operators import graph as G


def test_equal_distances_of_unequal_squares(spark):
    """Two squares that differ in the last place have one root: the lower id is the closest, not the lesser square."""
    rng = np.random.default_rng(1)
    while True:
        y = rng.random(2)
        big, small = max(1.0 + v * v for v in y), None
        for v in np.nextafter(max(y), 0) - np.arange(1, 9) * 2e-17:
            if 1.0 + v * v < big and np.sqrt(1.0 + v * v) == np.sqrt(big):
                small = float(v)
        if small is not None:
            break
    rows = [(0, 1, 1, 1.0, float(max(y)), 0.0), (0, 2, 1, 1.0, small, 0.0), (0, 3, 3, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "scan_id long, node_id long, cc long, x double, y double, z double")
    assert {(r.cc, r.src, r.dst) for r in G.closest_components(df, 1).collect()} == {(1, 1, 3), (3, 3, 1)}
