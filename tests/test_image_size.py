"""Images of many scans: no broadcast carries them, and zones are those of their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import graph as G
from talus.operators import raster as R
from talus.operators.zones import zone_measure


def _plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def image(spark, tmp_path_factory):
    """From files, whose size is known to be small."""
    folder = tmp_path_factory.mktemp("image")

    def filed(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    sizes = filed(spark.createDataFrame([(s, 6, 7) for s in range(3)], "scan_id long, height long, width long"), "sizes")
    rows = [(s, r, c, (r * c + s) % 3) for s in range(3) for r in range(6) for c in range(0, 7, 2)]
    held = filed(spark.createDataFrame(rows, "scan_id long, row long, col long, n int"), "held")
    return R.dense(held, sizes, n=0)


def test_images_are_not_broadcast(image, capsys):
    queries = [image, G.image_graph(image, ["n"]), G.flat_zones(image, "n", 0.0, 100), zone_measure(image, "n", "n", "max"), zone_measure(image, "n", "n", "mode", 8)]
    for q in queries:
        assert "Broadcast" not in _plan(q, capsys)


@pytest.mark.parametrize("neighbours", [4, 6, 8])
def test_zones_as_by_edges(spark, neighbours):
    rng = np.random.default_rng(neighbours)
    rows = [(s, r, c, None if rng.random() < 0.1 else int(rng.integers(3)), str(rng.integers(2))) for s in range(2) for r in range(-2, 9) for c in range(-3, 8) if rng.random() < 0.9]
    # A pixel may have two values.
    df = spark.createDataFrame([*rows, (0, 4, 4, 0, "0"), (0, 4, 4, 2, "1")], "scan_id long, row long, col long, a int, b string")
    for got, edges in [
        (G.flat_zones(df, "a", 1.0, 100, neighbours), G.image_graph(df, ["a"], neighbours=neighbours).where(F.col("w") <= 1.0 + 1e-10)),
        (G.label_zones(df, ["a", "b"], 100, neighbours), G.image_graph(df, ["a", "b"], neighbours=neighbours, metric=lambda a, b: F.greatest(*[(x != y).cast("int") for x, y in zip(a, b)])).where("w = 0")),
    ]:
        want = G.pixel_components(edges, df, 100)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


@pytest.mark.parametrize("name", ["dart_ground", "lambda_flat_zones", "zone_measure_8", "image_graph_metric"])
def test_registered_queries_broadcast_no_image(spark, sf_dir, capsys, name):
    """Only tables of a row a scan pass as small sides: what `explode` or a grouped function makes is not among them."""
    from talus.plans import catalogue

    plan = _plan(catalogue.queries()[name](spark, sf_dir), capsys).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(line)), len(plan))
            assert not [x for x in plan[i:end] if "Generate" in x or "InArrow" in x], line
