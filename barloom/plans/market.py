"""All queries over market panels; importing the modules registers them."""

from __future__ import annotations

from barloom.plans import feature_queries, portfolio_queries, report_queries, signal_queries, store_queries  # noqa: F401
from barloom.plans.portfolio_queries import flagship  # noqa: F401
from barloom.plans.registry import ORACLE, QUERIES  # noqa: F401
