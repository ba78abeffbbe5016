"""Streams over the test tables, run until the files are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import streaming
from tracewell.operators.ioc import Evidence
from tracewell.plans.ioc_queries import FINDINGS, _expected, _item_iocs, _scenario
from tracewell.plans.registry import query, table
from tracewell.session import work_path

LIMIT_SECONDS = 4 * 3600
DAY_SECONDS = 86_400


def stream(spark, folder, name):
    """A table's file as a stream, or all files of its folder.

    The name is a pattern, as Spark takes the plain path of a stream for a folder.
    """
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{{{name}}}.parquet")


def _utc(column):
    """Wall-clock time as a timestamp whose microseconds count from 1970 in UTC."""
    since = F.col(column) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = since.cast("interval second").cast("decimal(20,6)")
    return F.timestamp_micros((seconds * 1_000_000).cast("bigint"))


@query(
    "ss01_stream_findings",
    """
    SELECT DISTINCT d.source AS run_id, CAST(b.item_id // 16 AS VARCHAR) AS scenario_id,
           'text-' || b.item_id AS ioc_id
    FROM documents d JOIN benchmark b ON contains(d.text, b.text)
    UNION
    SELECT source, CAST(item_id // 16 AS VARCHAR), 'size-' || item_id
    FROM documents JOIN benchmark ON doc_id = item_id WHERE n_chars > 1000
    """,
)
def stream_findings(spark, folder):
    entries = stream(spark, folder, "documents").select(
        F.col("source").alias("run_id"),
        F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("n_chars") > 1000, 1).otherwise(0).cast("bigint").alias("size_bytes"),
        F.col("text").alias("content"),
    )
    item = F.col("item_id").cast("string")
    want = lambda kind, path, text, size, exists: F.struct(
        F.concat(F.lit(f"{kind}-"), item).alias("ioc_id"),
        path.cast("string").alias("path"),
        text.cast("string").alias("content_contains"),
        F.lit(size).cast("bigint").alias("size_bytes"),
        F.lit(exists).cast("boolean").alias("exists"),
    )
    path, none = F.concat(F.lit("/doc/"), item), F.lit(None)
    wanted = F.array(
        want("text", none, F.col("text"), None, None),
        want("size", path, none, 1, True),
        want("gone", path, none, None, False),
    )
    iocs = (
        table(spark, folder, "benchmark")
        .select(_scenario().alias("scenario_id"), F.explode(wanted).alias("ioc"))
        .select("scenario_id", "ioc.*")
    )
    return streaming.run_available(streaming.stream_findings(entries, iocs), "stream-findings")


@query(
    "ss02_stream_deadlines",
    """
    WITH closed AS (SELECT least(max(ts) FILTER (WHERE event_type = 'signup'),
                                 max(ts) FILTER (WHERE event_type = 'purchase'))
                           - INTERVAL 4 HOUR - INTERVAL 11 MINUTE AS until FROM events)
    SELECT s.event_id AS start_id, CAST(s.user_id AS VARCHAR) AS vm, epoch_us(min(p.ts)) AS ready_us,
           min(p.ts) IS NULL AS timed_out
    FROM events s LEFT JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase'
         AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 4 HOUR
    WHERE s.event_type = 'signup' AND s.ts <= (SELECT until FROM closed)
    GROUP BY s.event_id, s.user_id
    """,
)
def stream_deadlines(spark, folder):
    events = stream(spark, folder, "events").select(
        "event_id", "event_type", F.col("user_id").cast("string").alias("vm"), _utc("ts").alias("ts")
    )
    starts = events.where("event_type = 'signup'").withColumnRenamed("event_id", "start_id")
    readies = events.where("event_type = 'purchase'")
    decided = streaming.run_available(
        streaming.stream_deadlines(starts, readies, LIMIT_SECONDS, "10 minutes", splits=2),
        "stream-deadlines",
    )
    # The watermark is the earlier one of both sides; what it leaves open is not
    # decided yet, so the result ends a minute before it.
    return _until(spark, folder, decided, LIMIT_SECONDS + 11 * 60, "signup", "purchase").select(
        "start_id", "vm", "ready_us", "timed_out"
    )


def _until(spark, folder, rows, seconds, *kinds):
    """Rows up to so many seconds before the last event, of every kind given."""
    at = F.unix_micros(_utc("ts"))
    of_kind = [F.max(F.when(F.col("event_type") == k, at)) for k in kinds]
    last = F.least(F.max(at), *of_kind) if kinds else F.max(at)
    until = table(spark, folder, "events").agg(last).scalar()
    return rows.where(F.col("ts_us") <= until - seconds * 1_000_000)


@query("ss03_stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, folder):
    events = stream(spark, folder, "events").select(
        "event_id", "user_id", "event_type", _utc("ts").alias("ts")
    )
    twice = events.union(
        stream(spark, folder, "events").select(
            "event_id", "user_id", "event_type", _utc("ts").alias("ts")
        )
    )
    once = streaming.stream_dedup(twice, ["event_id"], "ts", "1 hour")
    return streaming.run_available(once, "stream-dedup").drop("ts")


@query(
    "ss04_stream_contract",
    """
    SELECT event_id, CAST(vm AS VARCHAR) AS vm, kind, state FROM (
      SELECT event_id, user_id AS vm, ts,
             CASE event_type WHEN 'purchase' THEN 'memory' WHEN 'error' THEN 'disk' END AS kind,
             last_value(CASE event_type WHEN 'click' THEN 'on' WHEN 'view' THEN 'off' END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY ts, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state
      FROM events)
    WHERE kind IS NOT NULL AND ts <= (SELECT max(ts) - INTERVAL 11 MINUTE FROM events)
      AND NOT coalesce(state = CASE kind WHEN 'memory' THEN 'on' ELSE 'off' END, false)
    """,
)
def stream_contract(spark, folder):
    kinds = ["click", "on", "view", "off", "purchase", "memory", "error", "disk"]
    events = stream(spark, folder, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("vm"),
        _utc("ts").alias("ts"),
        F.try_element_at(F.create_map(*map(F.lit, kinds)), F.col("event_type")).alias("kind"),
    )
    broken = streaming.run_available(
        streaming.stream_contract(events, "10 minutes", splits=2), "stream-contract"
    )
    return _until(spark, folder, broken, 11 * 60).select("event_id", "vm", "kind", "state")


# Evidence of sources up to their closing; odd sources stay open.
UNTIL_CLOSED = """
    closings AS (
      SELECT DISTINCT source AS closed, 250 + TRY_CAST(substr(source, 4) AS BIGINT) AS until FROM documents
      WHERE TRY_CAST(substr(source, 4) AS BIGINT) % 2 = 0),
    cut_documents AS (SELECT d.* FROM documents d JOIN closings ON closed = source WHERE doc_id % 500 <= until),
    closed_runs AS (SELECT closed AS source FROM closings),
    cut_events AS (SELECT e.* FROM events e JOIN closings ON closed = 'src' || (user_id % 20) WHERE event_id % 500 <= until),
    """
ON_CLOSED = (
    FINDINGS.replace("SELECT DISTINCT source AS run_id FROM documents", "SELECT DISTINCT source AS run_id FROM closed_runs")
    .replace("FROM documents", "FROM cut_documents").replace("FROM events", "FROM cut_events")
)


@query(
    "ss05_closed_findings",
    f"""
    WITH {UNTIL_CLOSED} {ON_CLOSED}
    SELECT run_id, scenario_id, ordinal, ioc_id, type,
           matched AND (ioc_id NOT LIKE 'gone-%' OR run_id IN (SELECT source FROM cut_documents)) AS matched, until AS closed_at
    FROM findings JOIN closings ON closed = run_id
    """,
)
def closed_findings(spark, folder):
    """Documents and events as evidence of sources, half of which are closed."""
    # Not from second 0, where every watermark begins.
    at = lambda seconds: F.timestamp_seconds(seconds + DAY_SECONDS).alias("ts")
    entries = stream(spark, folder, "documents").select(
        F.col("source").alias("run_id"), F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"), F.col("lang").alias("source"),
        at(F.col("doc_id") % 500),
    )
    rows = stream(spark, folder, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("run_id"), F.col("event_type").alias("plugin"),
        F.from_json("props", "map<string,string>").alias("attrs"), at(F.col("event_id") % 500),
    )
    number = F.substr("source", F.lit(4)).try_cast("bigint")
    closed = table(spark, folder, "documents").select("source").distinct().where(number % 2 == 0)
    path = work_path(spark, "closings")
    # The last one, of no source, moves the time beyond all others.
    end = spark.range(1).select(F.lit("").alias("run_id"), at(F.lit(10_000)))
    closed.select(F.col("source").alias("run_id"), at(number + 250)).union(end).write.parquet(path)
    closings = spark.readStream.schema("run_id STRING, ts TIMESTAMP").parquet(path)
    found = streaming.stream_closed_findings(
        Evidence(entries, rows), closings, _expected(spark, folder), "10 minutes", _item_iocs(spark, folder)
    )
    told = streaming.run_available(found, "closed-findings")
    return told.select(
        "run_id", "scenario_id", "ordinal", "ioc_id", "type", "matched", (F.col("closed_us") / 1_000_000 - DAY_SECONDS).cast("bigint").alias("closed_at")
    )
