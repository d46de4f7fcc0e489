"""Registered queries over the benchmark tables and their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = (
    "text_queries", "ticket_queries", "label_queries", "trend_queries", "feature_queries", "novelty_queries",
    "model_queries", "sink_queries", "report_queries",
)


def load():
    """Import every query module once and return (queries, SQL counterparts)."""
    from trendloom.catalog import registry

    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
