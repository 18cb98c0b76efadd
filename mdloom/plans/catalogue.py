"""Every registered query, and the SQL of those that SQL can express."""

from . import relational  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
