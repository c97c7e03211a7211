"""All registered queries; importing this module registers them."""

from __future__ import annotations

from . import file_queries, learn_queries, merge_queries, metric_queries, run_queries, text_queries  # noqa: F401
from .registry import oracles, queries

__all__ = ["queries", "oracles"]
