"""Registered queries over the test tables, each next to the SQL it must agree with."""

from checks import chart_views, insight_views, profiles, report_views, views  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
