"""Registered queries over the given tables, each beside the SQL that checks it."""

from . import formatting, lines, model, outputs, selection, styled, web  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
