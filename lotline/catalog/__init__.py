"""The queries of the feature library by name, and their SQL."""

from __future__ import annotations

from . import ingest, models, ordering, scalars, search, shaping, statistics
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "ingest", "models", "ordering", "scalars", "search", "shaping", "statistics"]
