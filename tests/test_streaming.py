"""Streams against batch results, with files that arrive out of order."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewell import streaming
from tracewell.operators import ioc, timeline

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "event_id bigint, vm string, minute int, kind string"


@pytest.fixture
def arrivals(spark, tmp_path):
    """Writes batches as files and gives (stream, table) of them."""

    def make(batches, schema, add_time=True):
        path = tmp_path / "in"
        for i, batch in enumerate(batches):
            # One file per batch; the file source takes them in order of age.
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(path))
        timed = (
            lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000))
        ) if add_time else (lambda df: df)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
        return timed(stream), timed(spark.read.schema(schema).parquet(str(path)))

    return make


def shuffled(events, window, rng):
    """Events in arrival order: late by less than ``window`` minutes."""
    return sorted(events, key=lambda e: e[2] + rng.random() * window)


def random_log(rng, n, kinds):
    vms = ["hot"] * 4 + ["a", "b"]
    return [(i, rng.choice(vms), m, rng.choice(kinds)) for i, m in enumerate(sorted(rng.sample(range(2000), n)))]


def in_batches(events, n):
    size = -(-len(events) // n)
    return [events[i : i + size] for i in range(0, len(events), size)]


@pytest.mark.parametrize("splits", [1, 3])
def test_contract(spark, arrivals, splits):
    rng = random.Random(splits)
    events = random_log(rng, 150, ["on", "off", "memory", "disk", "revert"])
    end = [(1000 + i, vm, 5000, "on") for i, vm in enumerate(["hot", "a", "b"])]
    stream, table = arrivals([*in_batches(shuffled(events, 20, rng), 4), end], SCHEMA)
    got = streaming.run_available(streaming.stream_contract(stream, "30 minutes", splits), "contract")
    want = timeline.state_as_of(table, tie=["event_id"]).where("NOT kept")
    columns = ["event_id", "vm", "kind", "state"]
    assert rows(got, *columns) == rows(want, *columns)
    assert want.count() > 10


def test_late_event_is_dropped(spark, arrivals):
    batches = [
        [(1, "a", 0, "on"), (2, "a", 100, "on")],
        [(3, "a", 200, "on")],
        # Event 4 is far behind the watermark; event 5 is the same kind in time.
        [(4, "a", 10, "disk"), (5, "a", 210, "disk")],
        [(6, "a", 1000, "on")],
    ]
    stream, _ = arrivals(batches, SCHEMA)
    got = streaming.run_available(streaming.stream_contract(stream, "5 minutes"), "late")
    assert rows(got, "event_id", "state") == [(5, "on")]


@pytest.mark.parametrize("splits", [1, 3])
def test_deadlines(spark, arrivals, splits):
    rng = random.Random(splits + 10)
    events = random_log(rng, 200, ["start", "ready", "ready"])
    end = [(1000 + 2 * i + j, vm, 6000, kind) for i, vm in enumerate(["hot", "a", "b"]) for j, kind in enumerate(["start", "ready"])]
    stream, table = arrivals([*in_batches(shuffled(events, 20, rng), 4), end], SCHEMA)
    starts = lambda df: df.where("kind = 'start'").select(F.col("event_id").alias("start_id"), "vm", "ts")
    readies = lambda df: df.where("kind = 'ready'").select("vm", "ts")
    got = streaming.run_available(
        streaming.stream_deadlines(starts(stream), readies(stream), 40 * 60, "30 minutes", splits), "deadlines"
    )
    want = timeline.ready_within(starts(table), readies(table), "40 minutes").where("start_id < 1000")
    assert rows(got, "start_id", "vm", "ready_us", "timed_out") == rows(
        want, "start_id", "vm", F.unix_micros("ready_ts"), "timed_out"
    )


def test_ids_may_be_text(spark, arrivals):
    batches = [[(1, "a", 0, "start"), (2, "a", 10, "ready")], [(3, "a", 300, "start")], [(4, "a", 2000, "ready"), (5, "a", 2000, "start")]]
    stream, _ = arrivals(batches, SCHEMA)
    named = stream.withColumn("id", F.concat(F.lit("run-"), F.col("event_id").cast("string")))
    starts = named.where("kind = 'start'").select(F.col("id").alias("start_id"), "vm", "ts")
    readies = named.where("kind = 'ready'").select("vm", "ts")
    got = streaming.run_available(streaming.stream_deadlines(starts, readies, 20 * 60, "5 minutes"), "text-ids")
    assert rows(got, "start_id", "timed_out") == [("run-1", False), ("run-3", True)]


def test_dedup(spark, arrivals):
    first = [(i, "a", i, "x") for i in range(10)]
    stream, _ = arrivals([first, first, first[5:]], SCHEMA)
    got = streaming.run_available(streaming.stream_dedup(stream, ["event_id"], "ts", "1 hour"), "dedup")
    assert rows(got, "event_id") == [(i,) for i in range(10)]


@pytest.mark.parametrize("scan_markers, broadcast_rows", [(64, 1000), (0, 1000), (0, 2)])
def test_findings(spark, arrivals, scan_markers, broadcast_rows):
    schema = "run_id string, path string, size_bytes bigint, content string, source string"
    batches = [
        [("r1", "/a", 0, "has one two three here", "s"), ("r1", "/b", 5, None, "s")],
        [("r1", "/a", 0, "has one two three here", "s"), ("r2", "/b", 0, "xshortx", "s")],
    ]
    iocs = spark.createDataFrame(
        [
            ("s", "long", None, None, "one two three", None),
            ("s", "short", None, None, "short", None),
            ("s", "other", None, None, "no such text here", None),
            ("s", "empty", "/b", 0, None, True),
            ("s", "gone", "/c", None, None, False),
        ],
        "scenario_id string, ioc_id string, path string, size_bytes bigint, content_contains string, `exists` boolean",
    )
    stream, table = arrivals(batches, schema, add_time=False)
    got = streaming.run_available(
        streaming.stream_findings(stream, iocs, ioc.Limits(scan_markers, broadcast_rows)), "findings"
    )
    assert rows(got, "run_id", "ioc_id") == [("r1", "long"), ("r2", "empty"), ("r2", "short")]
    batch = ioc.match_file_iocs(table, iocs.where("`exists` IS NULL OR `exists`")).union(
        ioc.match_content_iocs(table, iocs)
    )
    assert rows(got) == rows(batch)


CLOSED_IOCS = [
    ("s", 0, "present", "file", "/a", None, None, None, None, None, ["disk"]),
    ("s", 1, "gone", "file", "/gone", None, False, None, None, None, None),
    ("s", 2, "gone-from-disk", "file", "/late", None, False, None, None, None, ["disk"]),
    ("s", 3, "marker", "file", None, "marker", None, None, None, None, None),
    ("s", 4, "sized", "file", "/b", None, None, 7, None, None, None),
    ("s", 5, "process", "process", None, None, None, None, "pslist", {"COMM": "sshd"}, None),
    ("s", 6, "bare", "process", None, None, None, None, "pslist", {"PPID": None}, None),
    ("s", 7, "no-process", "process", None, None, False, None, "pstree", {"COMM": "sshd"}, None),
    ("s", 8, "other", "registry", None, None, None, None, None, None, None),
]
CLOSED_SCHEMA = (
    "scenario_id string, ordinal int, ioc_id string, type string, path string, content_contains string, `exists` boolean, "
    "size_bytes bigint, plugin string, attrs map<string,string>, sources array<string>"
)


def closed_case(spark, tmp_path, rng, n, minutes=100):
    """Streams and tables of entries, rows and closings; runs r0 to r4, of which r4 shows nothing."""
    at = lambda: rng.randrange(minutes)
    runs = [f"r{rng.choice([0, 0, 0, 1, 2, 3])}" for _ in range(n)]
    kinds = {
        "entries": ("run_id string, path string, size_bytes bigint, content string, source string, minute int", [
            (r, rng.choice(["/a", "/b", "/c", "/gone" if r == "r2" else "/c", "/late"]), rng.choice([1, 7]),
             rng.choice([None, "", "a marker"]), rng.choice(["disk", "memory"]) if r != "r3" else "memory", at()) for r in runs]),
        "rows": ("run_id string, plugin string, attrs map<string,string>, minute int", [
            (r, rng.choice(["pslist", "pstree"]), {"COMM": rng.choice(["sshd", "init"]), "PID": "1"}, at()) for r in runs[: n // 4]]),
        "closings": ("run_id string, minute int", [(f"r{i}", 40 + 10 * i) for i in range(5)] + [("r0", 90), ("end", 500)]),
    }
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000))
    streams, tables = {}, {}
    for name, (schema, data) in kinds.items():
        path = str(tmp_path / name)
        data = sorted(data, key=lambda r: r[-1] + rng.random() * 15)
        for batch in in_batches(data, 4):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        streams[name] = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
        tables[name] = timed(spark.read.schema(schema).parquet(path))
    return streams, tables


@pytest.mark.parametrize("limits", [ioc.Limits(), ioc.Limits(0, 1)])
@pytest.mark.parametrize("limit_minutes", [None, 45])
def test_closed_runs(spark, tmp_path, limits, limit_minutes):
    streams, tables = closed_case(spark, tmp_path, random.Random(7), 200)
    iocs = spark.createDataFrame(CLOSED_IOCS, CLOSED_SCHEMA)
    expected = spark.createDataFrame([(f"r{i}",) for i in range(5)], "run_id string").crossJoin(iocs)
    got = streaming.run_available(
        streaming.stream_closed_findings(
            ioc.Evidence(streams["entries"], streams["rows"]), streams["closings"], expected, "3 hours",
            iocs, limit_minutes and limit_minutes * 60, limits=limits,
        ), "closed",
    )
    ends = got.select("run_id", F.timestamp_micros("closed_us").alias("end")).distinct()
    closing = {r["run_id"]: (r["closed_us"] // 1_000_000 - 1_700_000_000) // 60 for r in got.select("run_id", "closed_us").distinct().collect()}
    if limit_minutes is None:
        assert closing == {f"r{i}": 40 + 10 * i for i in range(5)}
    else:
        assert closing["r4"] == 80 and all(closing[f"r{i}"] <= min(60, 40 + 10 * i) for i in range(4))
    cut = lambda name: tables[name].join(ends, "run_id").where("ts <= end").drop("ts", "end", "minute")
    want = ioc.detect_iocs(expected, ioc.Evidence(cut("entries"), cut("rows")), iocs)
    columns = ["run_id", "ioc_id", "ordinal", "type", "matched"]
    assert rows(got, *columns) == rows(want, *columns)
    assert got.where("matched").count() > 10 and got.where("NOT matched").count() > 10


def test_state_of_closed_runs_is_bounded(spark, tmp_path):
    streams, _ = closed_case(spark, tmp_path, random.Random(8), 2_000)
    iocs = spark.createDataFrame(CLOSED_IOCS, CLOSED_SCHEMA)
    expected = spark.createDataFrame([(f"r{i}",) for i in range(5)], "run_id string").crossJoin(iocs)
    found = streaming.stream_closed_findings(
        ioc.Evidence(streams["entries"], streams["rows"]), streams["closings"], expected, "3 hours", iocs, forget_seconds=60
    )
    spark.conf.set(streaming.run.STATE_STORE, streaming.run.ROCKSDB)
    try:
        query = (
            found.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(streaming.run.STATE_STORE)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    # Conditions, looks and a closing for each run, whatever the evidence.
    assert 0 < max(sizes) <= 5 * (len(CLOSED_IOCS) + 4 + 1) < 2_000
    # What is left is the closing of the run that has not ended.
    assert sizes[-1] == 1


def test_late_evidence_takes_no_other_with_it(spark, tmp_path):
    entries = [[("q", "/a", 10)], [("q", "/a", 600)], [("r", "/a", 0), ("r", "/a", 590)], [("q", "/a", 5000)]]
    path, ends = str(tmp_path / "entries"), str(tmp_path / "closings")
    for batch in entries:
        spark.createDataFrame(batch, "run_id string, path string, minute int").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("r", 595)], "run_id string, minute int").write.parquet(ends)
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000))
    read = lambda schema, p: timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(p))
    iocs = spark.createDataFrame(
        [("s", 0, "here", "file", "/a", None, None, None, None, None, None)], CLOSED_SCHEMA
    )
    found = streaming.stream_closed_findings(
        ioc.Evidence(read("run_id string, path string, minute int", path)), read("run_id string, minute int", ends),
        iocs.withColumn("run_id", F.lit("r")), "1 hour", iocs,
    )
    got = streaming.run_available(found, "late-closed")
    assert rows(got, "run_id", "ioc_id", "matched") == [("r", "here", True)]


def test_a_table_of_many_files_is_streamed(spark, tmp_path):
    from tracewell.plans.stream_queries import stream

    rows = spark.range(40).selectExpr("id", "CAST(id AS STRING) AS text")
    rows.repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    # Another table whose name contains this one's is not read.
    rows.write.parquet(f"{tmp_path}/not_many.parquet")
    rows.toPandas().to_parquet(f"{tmp_path}/one.parquet")
    for name in ("many", "one"):
        read = streaming.run_available(stream(spark, str(tmp_path), name), f"stream-{name}")
        assert sorted(r.id for r in read.collect()) == list(range(40))
