"""The modules whose queries are registered."""

from __future__ import annotations

from tidemark.plans import health_queries, model_queries, portfolio_queries, problems, record_queries, runs_queries, series_queries, stream_queries


def modules() -> list:
    return [problems, series_queries, portfolio_queries, model_queries, runs_queries, health_queries, record_queries, stream_queries]
