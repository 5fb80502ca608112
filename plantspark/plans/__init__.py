"""All registered queries; importing the plan modules fills the registry."""

from plantspark.plans import catalog, detect, models, names, quality, rows, speeds, streams  # noqa: F401
from plantspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
