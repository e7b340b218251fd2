"""Importing this module registers every query."""

from noticegrid.plans import (  # noqa: F401
    collection_queries, flow_queries, normalise_queries, registry_queries, source_queries,
)
from noticegrid.plans.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
