import datetime as dt
import random

import pytest
from conftest import rows

from tracewell.operators import timeline as tl

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def log_of(spark, data):
    return spark.createDataFrame(
        [(i, vm, at(m), kind) for i, (vm, m, kind) in enumerate(data)],
        "event_id int, vm string, ts timestamp_ntz, kind string",
    )


LOG = [
    ("good", 0, "revert"), ("good", 1, "on"), ("good", 2, "ready"), ("good", 3, "memory"),
    ("good", 4, "off"), ("good", 5, "disk"),
    ("bad", 1, "memory"), ("bad", 2, "off"), ("bad", 3, "memory"), ("bad", 4, "on"), ("bad", 5, "disk"),
]


@pytest.mark.parametrize("rows_per_task", [1, 1000])
def test_state_as_of(spark, rows_per_task):
    got = tl.state_as_of(log_of(spark, LOG), tie=["event_id"], rows_per_task=rows_per_task)
    assert rows(got, "vm", "kind", "state", "kept") == [
        ("bad", "disk", "on", False),
        ("bad", "memory", "off", False),
        ("bad", "memory", None, False),
        ("good", "disk", "off", True),
        ("good", "memory", "on", True),
    ]


@pytest.mark.parametrize("rows_per_task", [2, 1000])
def test_ready_within(spark, rows_per_task):
    rng = random.Random(rows_per_task)
    starts = [(i, "hot" if i % 3 else f"vm{i % 4}", rng.randrange(500)) for i in range(60)]
    readies = [("hot" if i % 3 else f"vm{i % 5}", rng.randrange(500)) for i in range(60)]
    # One at the very time of its start, one at the very limit.
    starts += [(100, "edge", 10), (101, "late", 10), (102, "never", 10)]
    readies += [("edge", 10), ("late", 41), ("edge", 40)]
    want = []
    for i, vm, m in starts:
        ready = min((r for v, r in readies if v == vm and m <= r <= m + 30), default=None)
        want.append((i, None if ready is None else at(ready), ready is None))
    got = tl.ready_within(
        spark.createDataFrame([(i, v, at(m)) for i, v, m in starts], "start_id int, vm string, ts timestamp_ntz"),
        spark.createDataFrame([(v, at(m)) for v, m in readies], "vm string, ts timestamp_ntz"),
        "30 minutes",
        rows_per_task,
    )
    assert sorted((r.start_id, r.ready_ts, r.timed_out) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("rows_per_task", [1, 1000])
def test_assign_runs(spark, rows_per_task):
    data = [("a", 0, "on"), ("a", 1, "revert"), ("a", 2, "on"), ("a", 3, "revert"), ("b", 1, "on")]
    got = tl.assign_runs(log_of(spark, data), tie=["event_id"], rows_per_task=rows_per_task)
    assert rows(got, "event_id", "run_no") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 0)]


@pytest.mark.parametrize("rows_per_task", [1, 1000])
def test_step_sequence(spark, rows_per_task):
    phases = ["look", "add", "hide", "hide", None, "hide"]
    steps = spark.createDataFrame(
        [("s", i, p) for i, p in enumerate(phases)], "scenario_id string, ordinal int, phase string"
    )
    got = tl.step_sequence(steps, rows_per_task=rows_per_task)
    assert rows(got, "ordinal", "previous_phase", "phase_changed") == [
        (0, None, False), (1, "look", True), (2, "add", True), (3, "hide", False), (4, "hide", True), (5, None, False)
    ]


def test_latest_run(spark):
    runs = spark.createDataFrame(
        [("d", "s", 1, "r1"), ("d", "s", 2, "r2"), ("d", "s", 2, "r3"), ("d", "t", 1, "r4")],
        "distro_id string, scenario_id string, ts int, run_id string",
    )
    assert rows(tl.latest_run(runs), "run_id") == [("r3",), ("r4",)]


def test_acquisition_order(spark):
    images = spark.createDataFrame(
        [("ok", "memory", 1.0), ("ok", "disk", 2.0), ("bad", "memory", 2.0), ("bad", "disk", 1.0), ("half", "disk", 1.0)],
        "run_id string, kind string, timestamp double",
    )
    assert rows(tl.acquisition_order(images), "run_id", "ordered") == [
        ("bad", False), ("half", None), ("ok", True)
    ]


def test_baseline_diff(spark):
    schema = "path string, size int"
    base = spark.createDataFrame([("same", 1), ("null", None), ("gone", 1), ("more", 1), ("lost", 1)], schema)
    now = spark.createDataFrame([("same", 1), ("null", None), ("new", None), ("more", 2), ("lost", None)], schema)
    assert rows(tl.baseline_diff(base, now, ["path"], ["size"]), "path", "status") == [
        ("gone", "removed"), ("lost", "modified"), ("more", "modified"),
        ("new", "added"), ("null", "unchanged"), ("same", "unchanged"),
    ]
