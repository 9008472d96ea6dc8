"""All registered queries: importing a module registers its keys."""

from runloom.plans import q_core, q_dash, q_features, q_plan, q_sequence, q_sources  # noqa: F401
from runloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
