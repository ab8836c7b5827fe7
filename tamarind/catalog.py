"""All registered queries: importing the modules registers them."""

from . import queries, session_queries, store_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
