"""Relationship-graph and event-study analytics as Spark DataFrame operators."""

from tiergraph.session import build_session

__all__ = ["build_session"]
