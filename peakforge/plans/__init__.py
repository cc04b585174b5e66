"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from .registry import ORACLES, QUERIES
from . import cleaning, evaluation, exploration, joins, library, search, splits  # noqa: F401, I001  (they register their queries)

__all__ = ["ORACLES", "QUERIES"]
