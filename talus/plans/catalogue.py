"""All registered queries of the library with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("point_queries", "graph_queries", "model_queries", "further_queries", "spatial_queries", "network_queries")


def flagship(spark, sf_dir):
    return import_module("talus.plans.point_queries").flagship(spark, sf_dir)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"talus.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"talus.plans.{m}").ORACLES.items()}
