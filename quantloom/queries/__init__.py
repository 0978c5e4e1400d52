"""Registered queries. Importing this package registers all of them."""

from . import backtests, extra, factors, more, panels, points, scores, signals, texts, variants  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
