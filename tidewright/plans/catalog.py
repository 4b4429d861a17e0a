"""Importing this module registers every query."""

from tidewright.plans import aligning, cleaning, diagnosing, imputing, learning, modelling_risk, profiling, scoring  # noqa: F401
from tidewright.plans.registry import QUERIES, SQL  # noqa: F401
