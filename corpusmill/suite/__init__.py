"""The registered queries and their SQL counterparts."""

from . import files, features, profiles, records, sequences, shuffles, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
