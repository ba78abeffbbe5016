import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewell.operators import metrics as m


def test_plugin_counts_and_failures(spark):
    plan = spark.createDataFrame([("r", "a"), ("r", "b")], "run_id string, plugin string")
    found = spark.createDataFrame([("r", "a")] * 3 + [("r", "other")], "run_id string, plugin string")
    assert rows(m.plugin_counts(found, plan)) == [("r", "a", 3), ("r", "b", 0)]
    results = spark.createDataFrame(
        [("r", "b", "boom"), ("r", "a", "bad"), ("r", "a", "bad"), ("r", "c", None), ("s", "a", None)],
        "run_id string, plugin string, error string",
    )
    assert rows(m.failure_report(results)) == [("r", 2, "a: bad\nb: boom")]


def test_union_plugins(spark):
    a = spark.createDataFrame([("r", 1)], "run_id string, pid int")
    b = spark.createDataFrame([("r", "x")], "run_id string, name string")
    got = m.union_plugins({"a": a, "b": b})
    assert rows(got, "plugin", "pid", "name") == [("a", 1, None), ("b", None, "x")]


def test_detection_metrics(spark):
    findings = spark.createDataFrame(
        [("g", 1, True), ("g", 2, False), ("g", 3, True), ("g", 4, False), ("empty", 6, False)],
        "grp string, id int, matched boolean",
    )
    truth = spark.createDataFrame([(1, True), (2, True), (3, False)], "id int, expected boolean")
    got = rows(m.detection_metrics(findings, truth, ["id"], ["grp"]))
    assert got == [("empty", 0, 0, 0, 1, None, None), ("g", 1, 1, 1, 1, 0.5, 0.5)]


def test_missed(spark):
    frame = lambda ids: spark.createDataFrame([("r", i) for i in ids], "run_id string, ioc_id string")
    got = m.missed_iocs(frame(["a", "b", "b"]), frame(["b", "c", "c"]))
    assert rows(got, "ioc_id", "status") == [("a", "missed"), ("c", "unexpected")]


def test_rollup_and_cube(spark):
    steps = spark.createDataFrame(
        [("t1", "x", "1"), ("t1", "x", None), ("t2", "y", "1")],
        "tactic_id string, technique_id string, sub_technique_id string",
    )
    got = m.technique_rollup(steps)
    assert rows(got.where("grouping = 7"), "n_steps") == [(3,)]
    assert rows(got.where("grouping = 0 AND sub_technique_id IS NULL"), "tactic_id") == [("t1",)]
    tests = spark.createDataFrame(
        [("linux", "sh", True, "g1"), ("macos", "sh", True, "g1"), ("linux", "bash", False, "g2")],
        "platform string, executor string, elevation_required boolean, guid string",
    )
    cube = m.catalog_coverage(tests)
    assert rows(cube.where("grouping = 7"), "n_tests", "n_guids") == [(3, 2)]
    assert rows(cube.where("grouping = 3 AND platform = 'linux'"), "n_tests", "n_guids") == [(2, 2)]


def test_scenario_keys(spark):
    keys = spark.createDataFrame([("b",), ("B",), ("a",), ("b",)], "key string")
    assert [r.key for r in m.scenario_keys(keys).collect()] == ["B", "a", "b"]


@pytest.mark.parametrize("rows_per_task", [1, 4, 20, 2000])
def test_percentiles(spark, rows_per_task):
    groups = {"one": [5], "two": [1, 2], "many": [1, 1, 1, 7, 9, 9, 30, 2, 2], "none": [None], None: [4, 6]}
    df = spark.createDataFrame(
        [(g, v) for g, values in groups.items() for v in values], "g string, v int"
    )
    probs = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r for r in m.exact_percentiles(df, "g", "v", probs, rows_per_task).collect()}
    assert set(got) == {"one", "two", "many", None}
    for g, r in got.items():
        values = sorted(groups[g])
        assert (r.low, r.mid, r.top) == (values[0], statistics.median(values), values[-1])
    want = df.where("g = 'many'").agg(F.percentile("v", 0.95)).first()[0]
    assert got["many"].p95 == pytest.approx(want)


def test_acquisition_stats(spark):
    images = spark.createDataFrame(
        [("d", 1.0, 10, 100), ("d", 3.0, 30, 100), ("e", None, None, None), (None, 7.0, 1, 2)],
        "distro_id string, acquisition_seconds double, ewf_size_bytes bigint, virtual_size_bytes bigint",
    )
    stats = m.acquisition_stats(images)
    assert rows(stats) == [
        ("d", 2, 2.0, 0.2, 2.0, (1 - 0.95) * 1.0 + (0.95 - 0) * 3.0), ("e", 1, None, None, None, None), (None, 1, 7.0, 0.5, 7.0, 7.0)
    ]
