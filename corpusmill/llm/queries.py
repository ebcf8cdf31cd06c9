"""All queries of this subpackage."""

from .registry import ORACLES, QUERIES
from . import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12, op13  # noqa: F401  each registers its query

__all__ = ["ORACLES", "QUERIES"]
