"""The registered queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("media", "vp_tree", "substring_dedup", "token_files", "segment_bpe", "token_counts", "license_scan", "mixing", "simhash", "language_id", "sentence_pieces", "fill_in_middle", "source_divergence")


def queries() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"talus.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"talus.llm.{m}").ORACLES.items()}
