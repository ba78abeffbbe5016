"""Structured Streaming forms of the operators."""

from tracewell.streaming.closed import stream_closed_findings
from tracewell.streaming.contract import stream_contract
from tracewell.streaming.deadlines import stream_deadlines
from tracewell.streaming.findings import stream_dedup, stream_findings
from tracewell.streaming.run import run_available

__all__ = [
    "run_available",
    "stream_closed_findings",
    "stream_contract",
    "stream_deadlines",
    "stream_dedup",
    "stream_findings",
]
