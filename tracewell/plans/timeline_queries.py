"""States, deadlines, runs and steps over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import timeline
from tracewell.plans.registry import query, table


def lifecycle(spark, folder):
    """Events as a machine's log."""
    kinds = ["click", "on", "view", "off", "purchase", "memory", "error", "disk", "signup", "revert"]
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("vm"),
        "ts",
        F.element_at(F.create_map(*map(F.lit, kinds)), F.col("event_type")).alias("kind"),
    )


@query(
    "jn11_baseline_diff",
    """
    WITH b AS (SELECT l_partkey, l_linenumber, max(l_quantity)::BIGINT AS size FROM lineitem
               WHERE l_returnflag = 'A' GROUP BY ALL),
    c AS (SELECT l_partkey, l_linenumber, max(l_quantity)::BIGINT AS size FROM lineitem
          WHERE l_returnflag <> 'A' GROUP BY ALL)
    SELECT coalesce(b.l_partkey, c.l_partkey) AS l_partkey,
           coalesce(b.l_linenumber, c.l_linenumber) AS l_linenumber,
           b.size AS base_size, c.size AS current_size,
           CASE WHEN b.l_partkey IS NULL THEN 'added' WHEN c.l_partkey IS NULL THEN 'removed'
                WHEN b.size = c.size THEN 'unchanged' ELSE 'modified' END AS status
    FROM b FULL JOIN c ON b.l_partkey = c.l_partkey AND b.l_linenumber = c.l_linenumber
    """,
)
def baseline_diff(spark, folder):
    keys = ["l_partkey", "l_linenumber"]
    lines = table(spark, folder, "lineitem")
    state = lambda rows: rows.groupBy(*keys).agg(F.max("l_quantity").cast("bigint").alias("size"))
    return timeline.baseline_diff(
        state(lines.where("l_returnflag = 'A'")),
        state(lines.where("l_returnflag <> 'A'")),
        keys,
        ["size"],
    )


JN12 = """
    SELECT event_id, vm, kind, state, coalesce(state = CASE kind WHEN 'memory' THEN 'on' ELSE 'off' END, false) AS kept
    FROM (
      SELECT event_id, user_id AS vm,
             CASE event_type WHEN 'purchase' THEN 'memory' WHEN 'error' THEN 'disk' END AS kind,
             last_value(CASE event_type WHEN 'click' THEN 'on' WHEN 'view' THEN 'off' END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY ts, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state
      FROM events)
    WHERE kind IS NOT NULL
    """
JN12_COLUMNS = ("event_id", "vm", "kind", "state", "kept")


@query("jn12_state_as_of", JN12)
def state_as_of(spark, folder):
    return timeline.state_as_of(lifecycle(spark, folder), tie=["event_id"]).select(*JN12_COLUMNS)


@query("jn12_state_as_of_chunked", JN12)
def state_as_of_chunked(spark, folder):
    """The way taken when a machine has more events than one task should scan."""
    return timeline.state_as_of(
        lifecycle(spark, folder), tie=["event_id"], rows_per_task=25
    ).select(*JN12_COLUMNS)


JN13 = """
    SELECT s.event_id AS start_id, s.user_id AS vm, strftime(min(p.ts), '%Y-%m-%d %H:%M:%S.%f') AS ready_at,
           min(p.ts) IS NULL AS timed_out
    FROM events s LEFT JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase'
         AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 4 HOUR
    WHERE s.event_type = 'signup' GROUP BY s.event_id, s.user_id
    """


def starts_and_readies(spark, folder):
    events = table(spark, folder, "events").withColumn("vm", F.col("user_id"))
    starts = events.where("event_type = 'signup'").select(
        F.col("event_id").alias("start_id"), "vm", "ts"
    )
    return starts, events.where("event_type = 'purchase'").select("vm", "ts")


def _ready(spark, folder, **sizes):
    starts, readies = starts_and_readies(spark, folder)
    return timeline.ready_within(starts, readies, "4 hours", **sizes).select(
        "start_id",
        "vm",
        F.date_format("ready_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ready_at"),
        "timed_out",
    )


@query("jn13_ready_within", JN13)
def ready_within(spark, folder):
    return _ready(spark, folder)


@query("jn13_ready_within_chunked", JN13)
def ready_within_chunked(spark, folder):
    """The way taken when a machine has more events than one task should scan."""
    return _ready(spark, folder, rows_per_task=10)


@query(
    "wn02_latest_run",
    """
    SELECT o_custkey, o_orderpriority, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                               ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    """,
)
def latest_run(spark, folder):
    runs = table(spark, folder, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    return timeline.latest_run(runs, keys, "o_orderdate", "o_orderkey").select(
        *keys, "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


WN03 = """
    SELECT conv_id, turn, role, previous_phase,
           previous_phase IS NOT NULL AND previous_phase <> role AS phase_changed
    FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_phase
          FROM conversations)
    """


def _steps(spark, folder, **sizes):
    steps = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return timeline.step_sequence(steps, ["conv_id"], ["turn"], "role", **sizes)


@query("wn03_step_sequence", WN03)
def step_sequence(spark, folder):
    return _steps(spark, folder)


@query("wn03_step_sequence_chunked", WN03)
def step_sequence_chunked(spark, folder):
    """The way taken when a scenario has more steps than one task should scan."""
    return _steps(spark, folder, rows_per_task=2)


@query(
    "wn04_acquisition_order",
    """
    SELECT coalesce(o_orderkey, l_orderkey) AS run_id, strftime(min(o_orderdate), '%Y-%m-%d') AS memory_day,
           strftime(min(l_shipdate), '%Y-%m-%d') AS disk_day, min(o_orderdate) <= min(l_shipdate) AS ordered
    FROM orders FULL JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
    """,
)
def acquisition_order(spark, folder):
    image = lambda key, kind, ts: [
        F.col(key).alias("run_id"), F.lit(kind).alias("kind"), F.col(ts).alias("timestamp")
    ]
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    images = orders.select(*image("o_orderkey", "memory", "o_orderdate")).union(
        lines.select(*image("l_orderkey", "disk", "l_shipdate"))
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return timeline.acquisition_order(images).select(
        "run_id", day("memory_ts").alias("memory_day"), day("disk_ts").alias("disk_day"), "ordered"
    )


WN05 = """
    SELECT event_id, user_id AS vm, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no
    FROM events
    """


@query("wn05_assign_runs", WN05)
def assign_runs(spark, folder):
    runs = timeline.assign_runs(lifecycle(spark, folder), tie=["event_id"])
    return runs.select("event_id", "vm", "run_no")


@query("wn05_assign_runs_chunked", WN05)
def assign_runs_chunked(spark, folder):
    """The way taken when a machine has more events than one task should scan."""
    runs = timeline.assign_runs(lifecycle(spark, folder), tie=["event_id"], rows_per_task=25)
    return runs.select("event_id", "vm", "run_no")
