"""The registered queries: each runs an operator over whole tables.

Importing the modules fills ``REGISTRY``; the SQL next to a query is an
independent formulation of the same result.
"""

from tiergraph.plans.queries import (  # noqa: F401
    documents,
    graph,
    market,
    publication,
    quality,
    signals,
    study,
)
from tiergraph.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
