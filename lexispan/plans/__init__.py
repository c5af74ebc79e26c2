"""Queries over the driver's tables, and their SQL."""

from . import corpus_queries, text_queries, time_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
