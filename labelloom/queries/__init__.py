"""Registered queries: each Spark query sits next to the SQL that must give the same rows."""

from .base import ORACLES, QUERIES
from . import corpus, lexicon, answers, metrics, splits, vectors, audit, models, scoring, sources, contracts  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
