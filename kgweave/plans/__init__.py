"""Bindings of operators to the driver's tables: registered queries and their oracle SQL."""

from kgweave.plans import evaluation, graph, queries, retrieval, sets, stores
from kgweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "graph", "queries", "retrieval", "sets", "stores"]
