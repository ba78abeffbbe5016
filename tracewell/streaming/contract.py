"""Live power-state contract."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators.timeline import REQUIRED_STATE
from tracewell.streaming.run import BLOCKS, GROUPS, append, group_of, held, keep

STATES = ("on", "off")
WAITING = pa.schema([("vm", pa.string()), ("ts_us", pa.int64()), ("event_id", pa.string()), ("kind", pa.string())])
OUTPUT = "vm STRING, event_id STRING, ts_us BIGINT, kind STRING, state STRING"


class PowerState(StatefulProcessor):
    """Per group of machines: events still open to reordering, and of each machine the
    last event that told its state.

    An event is judged once the watermark has passed it, so the order of
    arrival within the allowed delay has no effect. Events of one time come in the
    order of their ids, as numbers if ``numbers``, those without an id last.
    """

    def __init__(self, numbers: bool) -> None:
        self.numbers = numbers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BLOCKS)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        earliest = []
        for batch in rows:
            append(self.waiting, batch, WAITING)
            earliest.append(batch["ts_us"].min())
        self.wake(min(earliest))
        return iter([])

    def wake(self, ts_us: int) -> None:
        """One timer, for the earliest event; it looks after the later ones."""
        self.handle.registerTimer(int(ts_us) // 1000 + 1)

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = held(self.waiting, WAITING)
        broken, rest = self.judge(events, passed)
        keep(self.waiting, rest, WAITING)
        ahead = rest["ts_us"][rest["ts_us"] >= passed]
        if len(ahead):
            self.wake(ahead.min())
        if len(broken):
            yield broken

    def judge(self, events: pd.DataFrame, passed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Broken events before that time, and what is still needed."""
        vm = pd.factorize(events["vm"], use_na_sentinel=False)[0]
        order = np.lexsort((*self.places(events["event_id"]), events["ts_us"].to_numpy(), vm))
        events, vm = events.iloc[order].reset_index(drop=True), vm[order]
        kind, due = events["kind"], (events["ts_us"] < passed).to_numpy()
        tells = kind.isin(STATES).to_numpy()
        last = np.maximum.accumulate(np.where(tells, np.arange(len(vm)), 0))
        known = tells[last] & (vm[last] == vm)
        state = kind.take(last).reset_index(drop=True).astype(object).where(known, None)
        wrong = due & ~tells & (state != kind.map(REQUIRED_STATE)).to_numpy()
        broken = events[["vm", "event_id", "ts_us", "kind"]].assign(state=state)[wrong]
        # The last state of a machine that is due stands for all before.
        told = np.flatnonzero(tells & due)
        told = told[np.append(vm[told[1:]] != vm[told[:-1]], True)] if len(told) else told
        stays = ~due
        stays[told] = True
        return broken, events[stays]

    def places(self, ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """What ids are sorted by, the later key first."""
        none = ids.isna().to_numpy()
        if self.numbers:
            return ids.where(~none, "0").astype("int64").to_numpy(), none
        return pd.factorize(ids.where(~none, ""), sort=True)[0], none

    def close(self) -> None:
        pass


def stream_contract(events: DataFrame, delay: str, splits: int = 1, groups: int = GROUPS) -> DataFrame:
    """Image events taken in the wrong power state, as they become certain.

    ``events`` has vm, ts (TIMESTAMP), event_id (a whole number or text) and kind. Rows
    without a time are left out. ``splits`` deals the
    image events of a machine over several tasks, each of which sees all of its
    state changes: the way out where one machine has a large share of events.
    Machines share ``groups`` state groups; what waits in one, and the last state of each
    of its machines, is held by a task.
    """
    salts = F.when(
        F.col("kind").isin(*STATES), F.sequence(F.lit(0), F.lit(splits - 1))
    ).otherwise(F.array(F.pmod(F.xxhash64("event_id"), F.lit(splits)).cast("int")))
    keyed = (
        events.where(F.col("kind").isin(*STATES, *REQUIRED_STATE) & F.col("ts").isNotNull())
        .withWatermark("ts", delay)
        .select(
            "vm",
            "ts",
            F.col("event_id").cast("string").alias("event_id"),
            "kind",
            F.unix_micros("ts").alias("ts_us"),
            group_of("vm", groups),
            F.explode(salts).alias("salt"),
        )
    )
    id_type = events.schema["event_id"].dataType
    broken = keyed.groupBy("part", "salt").transformWithStateInPandas(
        PowerState(isinstance(id_type, T.IntegralType)), OUTPUT, "append", "EventTime"
    )
    return broken.withColumn("event_id", F.col("event_id").cast(id_type))
