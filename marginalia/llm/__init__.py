"""Operators of a training-data pipeline, with their registered queries.

Nothing else in the package imports this subpackage.
"""

from . import classifier, dialogue, duplicates, filters, integrity, layout, search, tokens  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
