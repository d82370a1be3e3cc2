"""Registered queries and the data they run on."""

from . import chemistry, files, similarity, structure, tabular  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
