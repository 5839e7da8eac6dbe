"""All registered queries."""

from harvestlens.plans import climate_queries, impact_queries, run_queries, source_queries  # noqa: F401
from harvestlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
