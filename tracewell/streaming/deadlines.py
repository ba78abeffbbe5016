"""Run deadlines on streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.streaming.run import BLOCKS, GROUPS, append, group_of, held, keep

LIVE = pa.schema([("vm", pa.string()), ("ts_us", pa.int64()), ("start_id", pa.string()), ("is_ready", pa.bool_())])
OUTPUT = "vm STRING, start_id STRING, ts_us BIGINT, ready_us BIGINT, timed_out BOOLEAN"


class Deadline(StatefulProcessor):
    """Per group of machines: starts whose time has not run out, and the readies since.

    A start is decided once the watermark has passed its deadline; then no
    earlier ready can arrive any more. It gives one row, never one per ready.
    """

    def __init__(self, limit_us: int) -> None:
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", BLOCKS)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        earliest = []
        for batch in rows:
            append(self.live, batch, LIVE)
            earliest.append(batch["ts_us"].min())
        # A ready is timed as well: if no start waits for it, it is dropped then.
        self.wake(min(earliest))
        return iter([])

    def wake(self, ts_us: int) -> None:
        """One timer, for the earliest deadline; it looks after the later ones."""
        self.handle.registerTimer((int(ts_us) + self.limit_us) // 1000 + 1)

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 - self.limit_us
        live = held(self.live, LIVE)
        if not (live["ts_us"] < passed).any():
            return  # an earlier timer has seen to it
        rest = live[live["ts_us"] >= passed]
        keep(self.live, rest, LIVE)
        if len(rest):
            self.wake(rest["ts_us"].min())
        decided = self.decide(live, passed)
        if len(decided):
            yield decided

    def decide(self, live: pd.DataFrame, passed: int) -> pd.DataFrame:
        """One row for each start before that time."""
        vm = pd.factorize(live["vm"], use_na_sentinel=False)[0]
        is_ready, ts = live["is_ready"].to_numpy(bool), live["ts_us"].to_numpy()
        # A ready at the very time of a start comes after it.
        order = np.lexsort((is_ready, ts, vm))
        vm, is_ready, ts = vm[order], is_ready[order], ts[order]
        last = len(order) - 1
        ready = np.minimum.accumulate(np.where(is_ready, np.arange(last + 1), last)[::-1])[::-1]
        missed = ~is_ready[ready] | (vm[ready] != vm) | (ts[ready] > ts + self.limit_us)
        due = np.flatnonzero(~is_ready & (ts < passed))
        out = live[["vm", "start_id", "ts_us"]].iloc[order[due]].reset_index(drop=True)
        out["ready_us"] = pd.arrays.IntegerArray(ts[ready[due]], missed[due])
        out["timed_out"] = missed[due]
        return out

    def close(self) -> None:
        pass


def stream_deadlines(
    starts: DataFrame, readies: DataFrame, limit_seconds: int, delay: str, splits: int = 1, groups: int = GROUPS
) -> DataFrame:
    """One row per start: its first ready in time, or ``timed_out``.

    ``starts`` has vm, ts (TIMESTAMP) and start_id of any simple type, ``readies``
    vm and ts. Rows without a time are left out.
    ``splits`` deals the starts of a machine over several tasks, each of which
    sees all of its readies: the way out where one machine has a large share.
    Machines share ``groups`` state groups; what is live in one is held by a task.
    """
    salt = F.pmod(F.xxhash64("start_id"), F.lit(splits)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    columns = ["vm", "ts", F.unix_micros("ts").alias("ts_us"), group_of("vm", groups)]
    timed = lambda df: df.where("ts IS NOT NULL").withWatermark("ts", delay)
    both = (
        timed(starts)
        .select(*columns, F.col("start_id").cast("string").alias("start_id"), salt.alias("salt"), F.lit(False).alias("is_ready"))
        .union(timed(readies).select(*columns, F.lit(None).cast("string"), every.alias("salt"), F.lit(True)))
    )
    decided = both.groupBy("part", "salt").transformWithStateInPandas(
        Deadline(limit_seconds * 1_000_000), OUTPUT, "append", "EventTime"
    )
    return decided.withColumn("start_id", F.col("start_id").cast(starts.schema["start_id"].dataType))
