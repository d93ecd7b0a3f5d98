"""Registered queries of the library, all but those of the training-data operators."""

from docloom.plans import expressions, nesting, relational, scalars, tpch  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
