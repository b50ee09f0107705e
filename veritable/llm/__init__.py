"""Operators for large training-data pipelines, and their registered queries."""

from veritable.llm import queries  # noqa: F401
from veritable.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
