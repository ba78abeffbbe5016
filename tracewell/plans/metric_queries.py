"""Counts, reports, metrics and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import integrity, metrics
from tracewell.plans.registry import query, table


def _cents(column):
    return F.round(F.col(column) * 100).cast("bigint")


# --- tool output: events of a user are the rows of a run's plugins -------------


@query(
    "ag03_plugin_counts",
    """
    WITH plan AS (SELECT user_id, unnest(['click', 'view', 'error', 'none']) AS plugin
                  FROM (SELECT DISTINCT user_id FROM events))
    SELECT user_id AS run_id, plugin,
           (SELECT count(*) FROM events e WHERE e.user_id = p.user_id AND e.event_type = p.plugin) AS n_rows
    FROM plan p
    """,
)
def plugin_counts(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("user_id", "run_id")
    planned = F.array(*map(F.lit, ["click", "view", "error", "none"]))
    plan = events.select("run_id").distinct().select("run_id", F.explode(planned).alias("plugin"))
    return metrics.plugin_counts(
        events.select("run_id", F.col("event_type").alias("plugin")), plan
    )


@query(
    "ag04_failure_report",
    """
    WITH e AS (SELECT user_id, 'plugin-' || json_extract_string(props, '$.k') AS plugin,
                      min('code ' || CAST(round(value) AS BIGINT)) AS error
               FROM events WHERE event_type = 'error' GROUP BY ALL)
    SELECT user_id AS run_id, count(*) AS n_failed,
           string_agg(plugin || ': ' || error, chr(10) ORDER BY plugin || ': ' || error) AS report
    FROM e GROUP BY user_id
    """,
)
def failure_report(spark, folder):
    code = F.concat(F.lit("code "), F.round("value").cast("bigint").cast("string"))
    results = table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.concat(F.lit("plugin-"), F.get_json_object("props", "$.k")).alias("plugin"),
        F.when(F.col("event_type") == "error", code).alias("error"),
    )
    return metrics.failure_report(results)


@query(
    "ag06_probe_images",
    """
    SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS n_processes,
           coalesce(bool_or(CAST(json_extract_string(props, '$.k') AS BIGINT) >= 95)
             FILTER (WHERE event_type = 'view'), false) AS passed
    FROM events GROUP BY user_id
    """,
)
def probe_images(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("user_id", "run_id")
    k = F.get_json_object("props", "$.k")
    pid = F.when(k.cast("bigint") >= 95, k).otherwise(F.lit('""'))
    rows = events.select(
        "run_id",
        F.when(F.col("event_type") == "view", metrics.PROCESS_LIST)
        .otherwise(F.col("event_type"))
        .alias("plugin"),
        F.parse_json(F.concat(F.lit('{"PID":'), pid, F.lit("}"))).alias("row"),
    )
    return metrics.probe_images(rows, events.select("run_id").distinct())


@query("so01_union_plugins", "SELECT event_id, event_type AS plugin, props FROM events")
def union_plugins(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "props")
    names = ["click", "view", "error", "signup", "purchase"]
    return metrics.union_plugins(
        {n: events.where(F.col("event_type") == n).drop("event_type") for n in names}
    ).select("event_id", "plugin", "props")


# --- detection metrics -------------------------------------------------------------


@query(
    "ag07_detection_metrics",
    """
    WITH m AS (SELECT lang, contains(text, '!!') AS hit, coalesce(quality = 0, false) AS due
               FROM documents LEFT JOIN labels USING (doc_id)),
    n AS (SELECT lang, count(*) FILTER (WHERE hit AND due) AS tp, count(*) FILTER (WHERE NOT hit AND due) AS fn,
                 count(*) FILTER (WHERE hit AND NOT due) AS fp, count(*) FILTER (WHERE NOT hit AND NOT due) AS tn
          FROM m GROUP BY lang)
    SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
           CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision FROM n
    """,
)
def detection_metrics(spark, folder):
    findings = table(spark, folder, "documents").select(
        "doc_id", "lang", F.contains("text", F.lit("!!")).alias("matched")
    )
    truth = table(spark, folder, "labels").select(
        "doc_id", (F.col("quality") == 0).alias("expected")
    )
    return metrics.detection_metrics(findings, truth, ["doc_id"], ["lang"])


@query(
    "so03_missed_iocs",
    """
    WITH found AS (SELECT CASE WHEN l_linestatus = 'O' THEN l_orderkey ELSE -l_orderkey END AS key FROM lineitem)
    SELECT key, 'missed' AS status FROM (SELECT o_orderkey AS key FROM orders EXCEPT SELECT key FROM found)
    UNION ALL
    SELECT key, 'unexpected' FROM (SELECT key FROM found EXCEPT SELECT o_orderkey FROM orders)
    """,
)
def missed_iocs(spark, folder):
    expected = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    key = F.when(F.col("l_linestatus") == "O", F.col("l_orderkey")).otherwise(-F.col("l_orderkey"))
    return metrics.missed_iocs(expected, table(spark, folder, "lineitem").select(key.alias("key")))


@query(
    "ag07_metrics_by_either_side",
    """
    WITH f AS (SELECT doc_id, lang, true AS hit FROM documents WHERE contains(text, '!!')),
    t AS (SELECT doc_id, lang, quality = 0 AS due FROM labels JOIN documents USING (doc_id)),
    m AS (SELECT coalesce(f.lang, t.lang) AS lang, coalesce(hit, false) AS hit, coalesce(due, false) AS due
          FROM f FULL JOIN t USING (doc_id)),
    n AS (SELECT lang, count(*) FILTER (WHERE hit AND due) AS tp, count(*) FILTER (WHERE NOT hit AND due) AS fn,
                 count(*) FILTER (WHERE hit AND NOT due) AS fp, count(*) FILTER (WHERE NOT hit AND NOT due) AS tn
          FROM m GROUP BY lang)
    SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
           CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision FROM n
    """,
)
def metrics_by_either_side(spark, folder):
    """Findings and truth each lack pairs of the other, and both know the group."""
    docs = table(spark, folder, "documents")
    findings = docs.where(F.contains("text", F.lit("!!"))).select("doc_id", "lang", F.lit(True).alias("matched"))
    truth = table(spark, folder, "labels").join(docs, "doc_id").select("doc_id", "lang", (F.col("quality") == 0).alias("expected"))
    return metrics.detection_metrics(findings, truth, ["doc_id"], ["lang"])


@query(
    "ag12_run_outcomes",
    """
    SELECT o_orderkey AS run_id,
           CASE WHEN o_orderkey % 7 = 0 THEN 'cleaned' WHEN o_orderkey % 5 > 2 THEN 'complete'
                WHEN o_custkey % 4 = 0 THEN 'empty' ELSE 'failed' END AS outcome FROM orders
    """,
)
def run_outcomes(spark, folder):
    key = F.col("o_orderkey") % 5
    result = F.when(key == 0, "{}").when(key == 1, '{"name": ').when(key == 3, '{"name": "x"}').when(key == 4, "[1]")
    runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 4).alias("returncode"),
        result.alias("result"), (F.col("o_orderkey") % 7 == 0).alias("cleanup"),
    )
    return metrics.run_outcomes(runs).select("run_id", "outcome")


@query("ag02_memory_images", "SELECT l_orderkey AS image_id, l_linenumber AS part, l_discount > 0 AS valid FROM lineitem")
def memory_images(spark, folder):
    size = F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100).cast("bigint"))
    images = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("part"),
        F.when(F.col("l_linenumber") > 1, F.coalesce(size, F.lit(0))).otherwise(size).alias("size_bytes"),
    )
    return integrity.validate_images(images).select("image_id", "part", "valid")


# --- catalogs -----------------------------------------------------------------------


@query(
    "ag08_technique_rollup",
    """
    SELECT r_name AS tactic_id, n_name AS technique_id, c_mktsegment AS sub_technique_id,
           CAST(grouping(r_name, n_name, c_mktsegment) AS BIGINT) AS "grouping", count(*) AS n_steps
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name, c_mktsegment)
    """,
)
def technique_rollup(spark, folder):
    steps = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("tactic_id"),
            F.col("n_name").alias("technique_id"),
            F.col("c_mktsegment").alias("sub_technique_id"),
        )
    )
    return metrics.technique_rollup(steps)


@query(
    "ag09_catalog_coverage",
    """
    WITH t AS (SELECT unnest(CASE WHEN p_size < 20 THEN ['linux', 'macos'] ELSE ['linux'] END) AS platform,
                      p_brand AS executor, p_size > 25 AS elevation_required, p_name AS guid FROM part)
    SELECT platform, executor, elevation_required,
           CAST(grouping(platform, executor, elevation_required) AS BIGINT) AS "grouping",
           count(*) AS n_tests, count(DISTINCT guid) AS n_guids
    FROM t GROUP BY CUBE (platform, executor, elevation_required)
    """,
)
def catalog_coverage(spark, folder):
    platforms = F.when(
        F.col("p_size") < 20, F.array(F.lit("linux"), F.lit("macos"))
    ).otherwise(F.array(F.lit("linux")))
    tests = table(spark, folder, "part").select(
        F.explode(platforms).alias("platform"),
        F.col("p_brand").alias("executor"),
        (F.col("p_size") > 25).alias("elevation_required"),
        F.col("p_name").alias("guid"),
    )
    return metrics.catalog_coverage(tests)


@query("st01_scenario_keys", "SELECT DISTINCT source FROM documents ORDER BY source")
def scenario_keys(spark, folder):
    return metrics.scenario_keys(table(spark, folder, "documents"), "source")


@query(
    "so02_normalize_truth",
    """
    SELECT 'described' AS shape, doc_id AS id, source AS scenario_id, CAST(NULL AS VARCHAR) AS stdout,
           CAST(NULL AS BIGINT) AS n_iocs FROM documents
    UNION ALL SELECT 'executed', conv_id, NULL, text, NULL FROM conversations
    UNION ALL SELECT 'indicators', item_id, 'scenario-' || item_id, NULL, length(text) FROM benchmark
    """,
)
def normalize_truth(spark, folder):
    described = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("scenario_id")
    )
    executed = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("id"), F.col("text").alias("stdout")
    )
    indicators = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("id"),
        F.concat(F.lit("scenario-"), F.col("item_id").cast("string")).alias("scenario_id"),
        F.length("text").cast("bigint").alias("n_iocs"),
    )
    return metrics.normalize_truth(described, executed, indicators).select(
        "shape", "id", "scenario_id", "stdout", "n_iocs"
    )


# --- acquisition -----------------------------------------------------------------------


def _percentile(p: float) -> str:
    """A percentile of a sorted list, interpolated as Spark does it."""
    at = f"((len(v) - 1) * {p}::DOUBLE)"
    low, high = (f"v[{f}({at})::INT + 1]" for f in ("floor", "ceil"))
    return f"CASE WHEN {low} = {high} THEN {low}::DOUBLE ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END"


AG10 = f"""
    WITH i AS (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                      CAST(l_quantity AS BIGINT) AS small FROM lineitem),
    g AS (SELECT l_returnflag, list_sort(list(cents)) AS v, sum(cents) AS cents, sum(small) AS small, count(*) AS n
          FROM i GROUP BY l_returnflag)
    SELECT l_returnflag AS distro_id, n AS n_images, cents / n AS mean_seconds,
           CAST(small AS DOUBLE) / CAST(cents AS DOUBLE) AS ratio,
           {_percentile(0.5)} AS p50_seconds, {_percentile(0.95)} AS p95_seconds
    FROM g
    """


def _acquisitions(spark, folder, **limits):
    images = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("distro_id"),
        _cents("l_extendedprice").alias("acquisition_seconds"),
        F.col("l_quantity").cast("bigint").alias("ewf_size_bytes"),
        _cents("l_extendedprice").alias("virtual_size_bytes"),
    )
    return metrics.acquisition_stats(images, **limits)


@query("ag10_acquisition_stats", AG10)
def acquisition_stats(spark, folder):
    return _acquisitions(spark, folder)


@query("ag10_acquisition_stats_chunked", AG10)
def acquisition_stats_chunked(spark, folder):
    """The way taken for groups of more rows than a task should sort."""
    return _acquisitions(spark, folder, rows_per_task=50)
