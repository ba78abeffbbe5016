"""Final findings of runs on streams, once a run is closed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators.ioc import (
    Evidence,
    Limits,
    condition_hits,
    findings_of_bits,
    numbered_conditions,
    with_conditions,
)
from tracewell.session import work_path

# Types are spelled out: state is opened in tasks, where no DDL can be parsed.
CONDITION = T.StructType([T.StructField("cond", T.LongType())])
SINCE = T.StructType([T.StructField("ts_us", T.LongType())])
CLOSING = T.StructType([T.StructField("ts_us", T.LongType()), T.StructField("told", T.BooleanType())])
# Stands for the closing in place of a condition.
CLOSE = -1
HIT = "run_id STRING, ts TIMESTAMP, ts_us BIGINT, cond BIGINT"
OUTPUT = "run_id STRING, closed_us BIGINT, words ARRAY<BIGINT>, bits ARRAY<BIGINT>"


class ClosedRun(StatefulProcessor):
    """Per run: since when each condition holds, and when the run closes.

    The state has at most one time for each condition, whatever the evidence. A run
    closes at its closing event, or ``limit_us`` after its first hit, if that is
    earlier. It is told once the watermark has passed that time, when no earlier
    evidence can arrive any more; its conditions are dropped then, and the closing
    time ``forget_us`` later. What arrives in between is not of the run any more.
    """

    def __init__(self, limit_us: int | None, forget_us: int) -> None:
        self.limit_us = limit_us
        self.forget_us = forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getMapState("since", CONDITION, SINCE)
        self.closing = handle.getValueState("closing", CLOSING)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        at, told = self.closing.get() if self.closing.exists() else (None, False)
        if told:
            for _ in rows:
                pass
            return iter([])
        before = at
        first: dict[int, int] = {}
        for batch in rows:
            closes = batch["cond"] == CLOSE
            times = [int(t) for t in batch.loc[closes, "ts_us"]]
            hits = batch.loc[~closes]
            if len(hits) and self.limit_us is not None:
                times.append(int(hits["ts_us"].min()) + self.limit_us)
            at = min(times + ([at] if at is not None else []), default=None)
            for cond, ts in hits.groupby("cond")["ts_us"].min().items():
                first[int(cond)] = min(int(ts), first.get(int(cond), int(ts)))
        for cond, ts in first.items():
            if not self.since.containsKey((cond,)) or self.since.getValue((cond,))[0] > ts:
                self.since.updateValue((cond,), (ts,))
        if at is not None and at != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + 1)
            self.closing.update((at, False))
            self.handle.registerTimer(at // 1000 + 1)
        return iter([])

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[pd.DataFrame]:
        at, told = self.closing.get()
        if told:
            self.closing.clear()
            return
        words: dict[int, int] = {}
        for (cond,), (ts,) in self.since.iterator():
            if ts <= at:
                words[cond >> 6] = words.get(cond >> 6, 0) | 1 << (cond & 63)
        self.since.clear()
        forgotten = (at + self.forget_us) // 1000 + 1
        if timerValues.getCurrentWatermarkInMs() >= forgotten:
            self.closing.clear()
        else:
            self.closing.update((at, True))
            self.handle.registerTimer(forgotten)
        signed = [bits - (1 << 64) if bits >> 63 else bits for bits in words.values()]
        yield pd.DataFrame({"run_id": [key[0]], "closed_us": [at], "words": [list(words)], "bits": [signed]})

    def close(self) -> None:
        pass


def _first_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each run and condition of a batch, so that few rows are shuffled.

    It has the earliest time, and the latest as its event time: were it the earliest,
    a late hit would take those with it that came in time.
    """
    for batch in batches:
        hits = batch.groupby(["run_id", "cond"], as_index=False, sort=False)
        yield hits.agg(ts=("ts", "max"), ts_us=("ts_us", "min"))[["run_id", "ts", "ts_us", "cond"]]


def stream_closed_findings(
    evidence: Evidence,
    closings: DataFrame,
    expected: DataFrame,
    delay: str,
    definitions: DataFrame | None = None,
    limit_seconds: int | None = None,
    forget_seconds: int = 86_400,
    limits: Limits = Limits(),
) -> DataFrame:
    """The findings of ``detect_iocs``, absences too, for each run when it is closed.

    Evidence and ``closings`` (run_id, ts) are streams with ``ts`` (TIMESTAMP); evidence
    later than a run's closing does not count, nor do rows without a run. ``expected``
    and ``definitions`` are tables. With ``limit_seconds`` a run also closes so long
    after the first evidence that meets a condition. A run is told once, with
    ``closed_us``; evidence of it that comes ``forget_seconds`` after the closing
    would open a run anew.

    Only what meets a condition is shuffled, and of that one row for each batch; time
    moves with those rows and with closings. Evidence behind the watermark is left
    out, unless it comes with evidence of the same condition that is not, in one batch.
    """
    spark = expected.sparkSession
    definitions = expected if definitions is None else definitions
    conditions = numbered_conditions(definitions)
    hits = condition_hits(evidence, conditions, limits, keep=("ts",))
    us = F.unix_micros("ts").alias("ts_us")
    found = [h.select("run_id", "ts", us, F.col("__cond").alias("cond")).mapInPandas(_first_of_batch, HIT) for h in hits]
    closes = closings.select("run_id", "ts", us, F.lit(CLOSE).cast("bigint").alias("cond"))
    timed = reduce(DataFrame.union, [closes, *found]).where("run_id IS NOT NULL").withWatermark("ts", delay)
    closed = (
        timed.groupBy("run_id")
        .transformWithStateInPandas(
            ClosedRun(None if limit_seconds is None else limit_seconds * 1_000_000, forget_seconds * 1_000_000),
            OUTPUT, "append", "EventTime",
        )
        .select("run_id", "closed_us", F.map_from_arrays("words", "bits").alias("__bits"))
    )
    # Written once: a stream would work it out again for every batch.
    path = work_path(spark, "expected")
    with_conditions(expected, conditions, definitions, limits).write.parquet(path)
    return findings_of_bits(closed.join(spark.read.parquet(path), "run_id"), ["closed_us", *expected.columns])
