"""Queries of the structural operators, with the SQL that gives the same rows."""

from . import chains, checks, designs, graphs, insights, knowledge, sources, unfinished  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
