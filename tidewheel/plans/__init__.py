"""Registered queries over the operators."""

from . import analytics, feature_sets, marts, models, portfolios, reports, research  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
