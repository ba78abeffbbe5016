"""Operators for preparing training text, and their queries.

Nothing else in the library imports this package.
"""

from tracewell.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
