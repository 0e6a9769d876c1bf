"""All registered queries, by importing the modules that register them."""

from docparity.plans import comparison, confidence, extraction  # noqa: F401
from docparity.plans.confidence import levels_by_language
from docparity.plans.registry import ORACLES, QUERIES

FLAGSHIP = levels_by_language

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
