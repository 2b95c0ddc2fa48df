"""Parts and suppliers whose numbers overlap."""

from talus.plans import graph_queries


def test_parts_above_a_million(spark, tmp_path):
    lines = spark.createDataFrame([(1000001, 2), (1000001, 2), (3, 1), (1000002, 4)], "l_partkey long, l_suppkey long")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.src, r.dst, r.w) for r in graph_queries.resize_graph(spark, str(tmp_path)).collect()}
    assert got == {(1, 1000002 % 7, 2.0), (3, 1000001 % 7, 1.0), (2, 1000004 % 7, 1.0)}
    assert [(r.src, r.dst) for r in graph_queries.subgraph(spark, str(tmp_path)).collect()] == [(1000002, 1000004)]
    lines.union(spark.createDataFrame([(1000002, 5), (999999, 6), (1000003, 8)], lines.schema)).write.parquet(f"{tmp_path}/more/lineitem.parquet")
    assert {(r.src, r.dst) for r in graph_queries.subgraph(spark, f"{tmp_path}/more").collect()} == {(1000002, 1000004), (999999, 1000006)}
