"""Imports every query module so that its entries register."""

from __future__ import annotations

import importlib

MODULES = (
    "rank_queries",
    "column_queries",
    "filter_queries",
    "join_queries",
    "locus_queries",
    "audit_queries",
    "tile_queries",
    "sample_queries",
    "model_queries",
    "stream_queries",
    "job_queries",
)


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"raresift.plans.{module}")
