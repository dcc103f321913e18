"""Composed workflows and the registered queries over the test tables."""

from __future__ import annotations


def all_queries():
    """(queries, oracles) after importing every query module."""
    from scorelens.plans import (  # noqa: F401
        io_queries, prepare_queries, relational_queries, scoring_queries, stream_queries, tracker_queries,
        workflow_queries)
    from scorelens.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
