"""One registered query per operator, over the supplied tables."""

from __future__ import annotations

import importlib

from cmdprism.catalog.registry import ORACLES, QUERIES, Query

FAMILIES = ["ingest_queries", "metric_queries", "split_queries", "text_queries", "report_queries"]


def _load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"cmdprism.catalog.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
