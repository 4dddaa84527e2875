"""Query registry."""

from . import audits, evaluation, records, storage  # noqa: F401  they register their queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
