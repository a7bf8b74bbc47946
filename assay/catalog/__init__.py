"""The registered queries of the engine, one for each operator, with their meaning in SQL."""

from . import engine, nodes, predicates
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "engine", "nodes", "predicates"]
