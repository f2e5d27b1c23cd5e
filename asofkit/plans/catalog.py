"""All queries of the core, and their SQL."""

from __future__ import annotations

from asofkit.plans import cluster_queries, feature_queries, quality_queries, times

_PARTS = (times, feature_queries, quality_queries, cluster_queries)


def queries() -> dict:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracles() -> dict:
    return {k: sql for part in _PARTS for k, sql in part.ORACLES.items()}
