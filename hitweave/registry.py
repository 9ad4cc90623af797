"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from hitweave.plans import detail_queries, edge_queries, hit_queries, learning_queries, manifest_queries, more_queries, shape_queries  # noqa: F401  (they register their queries)
from hitweave.plans.proxy import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
