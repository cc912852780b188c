"""All registered queries and their SQL."""

from . import genealogy_plans, interval_plans, model_plans, sequence_plans, structure_plans, traversal_plans
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "genealogy_plans", "interval_plans", "model_plans", "sequence_plans", "structure_plans", "traversal_plans"]
