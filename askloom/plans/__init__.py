"""Registered queries (each with its oracle) over the test tables."""

from askloom.plans import q_chunks, q_labels, q_metrics, q_retrieval, q_routing, q_sets, q_sources, q_streams, q_text  # noqa: F401
from askloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
