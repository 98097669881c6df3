"""All queries of the library and their SQL."""

from evigraph.plans import extraction, graph, metrics, retrieval, text
from evigraph.plans.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "extraction", "graph", "metrics", "retrieval", "text"]
