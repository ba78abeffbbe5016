"""Counts, reports, detection metrics and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import has_value
from tracewell.operators.skew import ROWS_PER_TASK, checked_join, values_at_ranks

PROCESS_LIST = "linux.pslist"


# --- tool output -----------------------------------------------------------------


def union_plugins(outputs: dict[str, DataFrame]) -> DataFrame:
    """All plugins' rows as one table with the plugin's name."""
    named = [df.withColumn("plugin", F.lit(name)) for name, df in outputs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def plugin_counts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows per planned run and plugin, 0 where there were none."""
    counts = rows.groupBy("run_id", "plugin").agg(F.count("*").alias("n_rows"))
    return plan.join(counts, ["run_id", "plugin"], "left").withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint"))
    )


def failure_report(results: DataFrame) -> DataFrame:
    """Runs with a failed plugin: how many, and a line ``plugin: error`` for each.

    ``results`` has run_id, plugin and error (null if the plugin went well). A
    plugin is reported once per run, with its first error by text, so a report
    is no longer than the list of plugins.
    """
    failed = (
        results.where("error IS NOT NULL")
        .groupBy("run_id", "plugin")
        .agg(F.min("error").alias("error"))
    )
    line = F.concat(F.col("plugin"), F.lit(": "), F.col("error"))
    return failed.groupBy("run_id").agg(
        F.count("*").alias("n_failed"),
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("report"),
    )


def probe_images(rows: DataFrame, images: DataFrame, plugin: str = PROCESS_LIST) -> DataFrame:
    """Images with the process rows seen in them; passed if one has a PID."""
    seen = (
        rows.where(F.col("plugin") == plugin)
        .groupBy("run_id")
        .agg(
            F.count("*").alias("n_processes"),
            F.bool_or(has_value(F.col("row"), "PID")).alias("__pid"),
        )
    )
    return images.join(seen, "run_id", "left").select(
        *images.columns,
        F.coalesce("n_processes", F.lit(0).cast("bigint")).alias("n_processes"),
        F.coalesce("__pid", F.lit(False)).alias("passed"),
    )


# --- findings ----------------------------------------------------------------------


def findings_document(findings: DataFrame) -> DataFrame:
    """One document per run and scenario, its findings in indicator order.

    A document is as long as the list of indicators of its ground truth.
    """
    finding = F.struct("ordinal", "ioc_id", "type", "matched")
    in_order = F.sort_array(F.collect_list(finding))
    return findings.groupBy("run_id", "scenario_id").agg(
        F.transform(
            in_order, lambda f: F.struct(f["ioc_id"], f["type"], f["matched"])
        ).alias("findings")
    )


def detection_metrics(
    findings: DataFrame, truth: DataFrame, on: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """tp, fn, fp, tn, recall and precision per group.

    ``findings`` has ``matched`` and ``truth`` has ``expected`` by the columns
    ``on``; a pair that one side lacks counts as false there. The columns ``by``
    may come from either; if both have one, each pair takes it from the side that
    knows it.
    """
    on = list(on)
    shared = [c for c in by if c not in on and c in findings.columns and c in truth.columns]
    truth = truth.withColumnsRenamed({c: f"__truth_{c}" for c in shared})
    group = [F.coalesce(c, f"__truth_{c}").alias(c) if c in shared else F.col(c) for c in by]
    both = findings.join(truth, on, "full_outer").select(
        *group,
        F.coalesce("matched", F.lit(False)).alias("__matched"),
        F.coalesce("expected", F.lit(False)).alias("__expected"),
    )
    hit, due = F.col("__matched"), F.col("__expected")
    return (
        both.groupBy(*by)
        .agg(
            F.count_if(hit & due).alias("tp"),
            F.count_if(~hit & due).alias("fn"),
            F.count_if(hit & ~due).alias("fp"),
            F.count_if(~hit & ~due).alias("tn"),
        )
        .withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
        .withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))
    )


def outcome_metrics(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """tp, fn, fp, tn, not_assessed, recall and precision per group, from ``outcome``."""
    of = lambda outcome: F.count_if(F.col("outcome") == outcome)
    names = {"tp": "found", "fn": "missed", "fp": "unexpected", "tn": "absent", "not_assessed": "not_assessed"}
    return (
        findings.groupBy(*by)
        .agg(*[of(outcome).alias(name) for name, outcome in names.items()])
        .withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
        .withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))
    )


def missed_iocs(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs only one side has: ``missed`` if expected, ``unexpected`` if found."""
    # Distinct first: a pair repeated many times is then one row per map task.
    expected, found = expected.distinct(), found.distinct()
    missed = expected.subtract(found).withColumn("status", F.lit("missed"))
    return missed.unionByName(found.subtract(expected).withColumn("status", F.lit("unexpected")))


def run_outcomes(
    runs: DataFrame, returncode: str = "returncode", result: str = "result", cleanup: str = "cleanup"
) -> DataFrame:
    """Adds ``outcome``: what became of a run, and so whether it has ground truth.

    A cleanup run is ``cleaned`` and leaves no document. Any other run has
    ``complete`` truth, or ``empty`` truth if its result (as text) is missing, unreadable
    or an empty object; with a return code other than 0, or none, the latter is a
    ``failed`` run.
    """
    found = F.try_parse_json(result)
    empty = F.coalesce(F.is_variant_null(found), F.lit(True)) | (F.to_json(found) == "{}")
    outcome = (
        F.when(F.coalesce(cleanup, F.lit(False)), "cleaned")
        .when(~empty, "complete")
        .when(F.col(returncode) == 0, "empty")
        .otherwise("failed")
    )
    return runs.withColumn("outcome", outcome)


# --- catalogs -------------------------------------------------------------------------


def technique_rollup(
    steps: DataFrame,
    levels: Sequence[str] = ("tactic_id", "technique_id", "sub_technique_id"),
) -> DataFrame:
    """Step counts over the technique hierarchy with subtotals.

    ``grouping`` tells a subtotal from a level that is null in the data.
    """
    return steps.rollup(*levels).agg(
        F.grouping_id().cast("bigint").alias("grouping"), F.count("*").alias("n_steps")
    )


def catalog_coverage(
    tests: DataFrame,
    dims: Sequence[str] = ("platform", "executor", "elevation_required"),
    guid: str = "guid",
) -> DataFrame:
    """Tests and distinct guids for every combination of the dimensions."""
    return tests.cube(*dims).agg(
        F.grouping_id().cast("bigint").alias("grouping"),
        F.count("*").alias("n_tests"),
        F.countDistinct(guid).alias("n_guids"),
    )


def scenario_keys(registry: DataFrame, key: str = "key") -> DataFrame:
    """Distinct scenario keys in byte order."""
    return registry.select(key).distinct().orderBy(key)


def normalize_truth(
    described: DataFrame | None = None,
    executed: DataFrame | None = None,
    indicators: DataFrame | None = None,
) -> DataFrame:
    """The three shapes of ground truth as one table with ``shape``.

    Any may be missing; columns a shape lacks are null.
    """
    shapes = {"described": described, "executed": executed, "indicators": indicators}
    present = [df.withColumn("shape", F.lit(n)) for n, df in shapes.items() if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


# --- acquisition ---------------------------------------------------------------------


def exact_percentiles(
    df: DataFrame, by: str, value: str, probs: dict[str, float], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Exact percentiles per group, interpolated, one column for each in ``probs``.

    Groups a task can hold are left to Spark's ``percentile``. For the others the
    two ranks next to each percentile are found by selection (``values_at_ranks``),
    and the value between them is interpolated in the same way.
    """
    # A struct, as a null group joins like any other then.
    given = df.select(F.struct(by).alias("__group"), F.col(value).alias("__value")).where("__value IS NOT NULL")
    totals = given.groupBy("__group").agg(F.count("*").alias("__n"))
    hot = totals.where(F.col("__n") > rows_per_task)
    exact = [F.percentile("__value", p).alias(n) for n, p in probs.items()]
    if hot.isEmpty():
        return given.groupBy("__group").agg(*exact).select(f"__group.{by}", *probs)
    place = {n: (F.col("__n") - 1) * F.lit(p) for n, p in probs.items()}
    ranks = F.array_distinct(F.array(*[r for at in place.values() for r in (F.floor(at), F.ceil(at))]))
    wanted = hot.select("__group", F.explode(ranks).alias("__rank"), "__n")
    told = values_at_ranks(given, wanted, rows_per_task)
    # A value for each percentile and side; at most twice as many rows as percentiles.
    by_rank = told.groupBy("__group").agg(
        F.map_from_entries(F.collect_set(F.struct("__rank", F.col("__value").cast("double")))).alias("__at")
    )

    def between(at: Column) -> Column:
        low, high = F.try_element_at("__at", F.floor(at)), F.try_element_at("__at", F.ceil(at))
        mixed = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        return F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise(mixed)

    selected = by_rank.join(hot, "__group").select("__group", *[between(at).alias(n) for n, at in place.items()])
    others = checked_join(given, hot.select("__group"), ["__group"], "left_anti", ["__value"])
    return others.groupBy("__group").agg(*exact).union(selected).select(f"__group.{by}", *probs)


def acquisition_stats(
    images: DataFrame, by: str = "distro_id", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Per group: number, mean and percentiles of seconds, compression ratio."""
    seconds = "acquisition_seconds"
    totals = images.groupBy(by).agg(
        F.count("*").alias("n_images"),
        F.avg(seconds).alias("mean_seconds"),
        F.try_divide(F.sum("ewf_size_bytes"), F.sum("virtual_size_bytes")).alias("ratio"),
    )
    probs = {"p50_seconds": 0.5, "p95_seconds": 0.95}
    percentiles = exact_percentiles(images, by, seconds, probs, rows_per_task)
    same = totals[by].eqNullSafe(percentiles[by])
    return totals.join(percentiles, same, "left").select(totals["*"], *probs)
