"""Queries of the core; importing this module registers them."""

from __future__ import annotations

from papyra.plans import extract_queries, metric_queries, more_queries, nested_queries, reader_queries, small_queries, source_queries, structure_queries, text_queries  # noqa: F401
from papyra.plans.registry import QUERIES, SQL  # noqa: F401
