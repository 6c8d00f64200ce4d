"""All named queries: importing this module fills the registry."""

from . import facts, lookups, notices, pages, ranking, reads, reconcile, state, store, verdicts, walks, words  # noqa: F401
from . import outlines, papers, records, slices, tables, units  # noqa: F401  records reads what verdicts and reconcile register
from .registry import QUERIES

__all__ = ["QUERIES"]
