"""All registered queries (importing the modules registers them)."""

from kohorta.plans import basics, cohorts, outcomes  # noqa: F401
from kohorta.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
