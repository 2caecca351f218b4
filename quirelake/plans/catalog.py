"""All registered queries."""

from . import access, evaluation, layout, reading, search, sections, streams, upkeep  # noqa: F401  (importing registers)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
