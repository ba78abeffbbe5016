"""Findings while evidence arrives, and idempotent ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ioc import IOC_KEY, Limits, content_hits


def stream_findings(entries: DataFrame, iocs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Distinct (run, indicator) matches of a stream of file entries.

    Positive indicators only: that something is absent can be said of a closed
    run, not of a running one. Each entry is joined to the static indicators;
    the state is the set of matches already reported.
    """
    positive = iocs.where("coalesce(`exists`, true)")
    by_path = positive.where("path IS NOT NULL").select(
        *IOC_KEY,
        "path",
        F.col("size_bytes").alias("__size"),
        F.col("content_contains").alias("__marker"),
    )
    path_hits = (
        entries.join(by_path, "path")
        .where("__size IS NULL OR size_bytes = __size")
        .where("__marker IS NULL OR contains(content, __marker)")
        .select("run_id", *IOC_KEY)
    )
    markers = positive.where("path IS NULL AND content_contains IS NOT NULL").select(
        *IOC_KEY, "content_contains", F.col("size_bytes").alias("__size")
    )
    text_hits = (
        content_hits(entries, markers, keep=["run_id", "size_bytes"], limits=limits)
        .where("__size IS NULL OR size_bytes = __size")
        .select("run_id", *IOC_KEY)
    )
    return path_hits.union(text_hits).dropDuplicates(["run_id", *IOC_KEY])


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each key once, however often it is delivered within ``delay``."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
