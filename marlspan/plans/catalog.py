"""All registered queries."""

from . import answers, measures, poses, records, reports, runs, signals, stored, texts, tracks  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
