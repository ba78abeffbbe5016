"""The operators bound to the test tables, each with its SQL."""

from tracewell.plans import (  # noqa: F401
    function_queries,
    integrity_queries,
    ioc_queries,
    metric_queries,
    source_queries,
    stream_queries,
    timeline_queries,
)
from tracewell.plans.registry import ORACLES, QUERIES, table

__all__ = ["ORACLES", "QUERIES", "table"]
