"""Plans that queries of images ended with, their stored steps among them."""

import pytest

from talus.plans import catalogue


def _below(plan, i):
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    end = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(plan[i])), len(plan))
    return "\n".join(plan[i:end])


@pytest.mark.parametrize("name", ["dart_ground", "lambda_flat_zones", "zone_measure_8", "image_graph_metric"])
def test_only_a_row_a_scan_is_broadcast(spark, executed, name):
    """Small sides are aggregates; no pixels that `explode` or a grouped function makes, nor a stored image, whose files are small."""
    plans = [p.splitlines() for p in executed(lambda: catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect())]
    assert plans and all("Physical Plan" in p[0] for p in plans)
    for plan in plans:
        for small in (_below(plan, i) for i, line in enumerate(plan) if "BroadcastExchange" in line):
            assert "Aggregate" in small and "Generate" not in small and "InArrow" not in small, small
