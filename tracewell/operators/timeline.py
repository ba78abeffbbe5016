"""Order in time: states, deadlines, runs, steps and the clean baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.integrity import first_match
from tracewell.operators.skew import ROWS_PER_TASK, running

# What the machine must be when an image is taken.
REQUIRED_STATE = {"memory": "on", "disk": "off"}


def baseline_diff(
    base: DataFrame, current: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Entries of either state with ``status``.

    added, removed, modified or unchanged; ``keys`` identify an entry in each
    state, null being a key like any other. An entry that a state lists several
    times counts once, with its least columns. The columns come twice, as
    ``base_*`` and ``current_*``.
    """
    keys, cols = list(keys), list(cols)

    def side(df: DataFrame, name: str) -> DataFrame:
        entry = F.min(F.struct(F.lit(True).alias("given"), *cols)).alias("entry")
        reduced = df.groupBy(*keys).agg(entry)
        return reduced.select(
            F.struct(*keys).alias(f"__{name}_key"),
            *[F.col(f"entry.{c}").alias(f"{name}_{c}") for c in cols],
            F.col("entry.given").alias(f"__{name}"),
        )

    same: Column = F.lit(True)
    for c in cols:
        same = same & F.col(f"base_{c}").eqNullSafe(F.col(f"current_{c}"))
    status = (
        F.when(F.col("__base").isNull(), "added")
        .when(F.col("__current").isNull(), "removed")
        .when(same, "unchanged")
        .otherwise("modified")
    )
    same_key = F.col("__base_key").eqNullSafe(F.col("__current_key"))
    key = F.when(F.col("__base").isNull(), F.col("__current_key")).otherwise(F.col("__base_key"))
    both = side(base, "base").join(side(current, "current"), same_key, "full_outer")
    return both.select(
        *[key.getField(k).alias(k) for k in keys], *[f"base_{c}" for c in cols], *[f"current_{c}" for c in cols], status.alias("status")
    )


def state_as_of(
    events: DataFrame,
    states: Sequence[str] = ("on", "off"),
    tie: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Image events with the power state of their machine at that time.

    ``events`` has vm, ts and kind. ``kept`` says whether the state is the one
    the kind of image needs; without a state before it is not.
    """
    kind = F.col("kind")
    marked = events.withColumn("__state", F.when(kind.isin(*states), kind))
    scanned = running(
        marked, ["vm"], ["ts", *tie], {"state": ("last", "__state")}, rows_per_task
    ).drop("__state")
    needed = F.element_at(
        F.create_map(*[F.lit(x) for pair in REQUIRED_STATE.items() for x in pair]), kind
    )
    return scanned.where(kind.isin(*REQUIRED_STATE)).withColumn(
        "kept", F.coalesce(F.col("state") == needed, F.lit(False))
    )


def ready_within(
    starts: DataFrame, readies: DataFrame, limit: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Adds to each start the first ready of its machine from then on.

    ``starts`` has start_id, vm and ts, ``readies`` vm and ts; ``limit`` is an
    interval such as ``4 hours``. ``ready_ts`` is null and ``timed_out`` true if
    none came in time. Both go through one backward scan per machine: no pairs
    are formed.
    """
    none = lambda column: F.lit(None).cast(starts.schema[column].dataType)
    both = starts.select(
        "vm", "ts", "start_id", F.lit(0).alias("__ready"), none("ts").alias("__ready_ts")
    ).union(readies.select("vm", "ts", none("start_id"), F.lit(1), "ts"))
    # Backwards in time; at one and the same time a ready counts for the start.
    scanned = running(
        both,
        ["vm"],
        ["ts", "__ready"],
        {"ready_ts": ("last", "__ready_ts")},
        rows_per_task,
        descending=True,
    )
    in_time = F.col("ready_ts") <= F.col("ts") + F.expr(f"INTERVAL {limit}")
    return (
        scanned.where("__ready = 0")
        .select("start_id", "vm", "ts", F.when(in_time, F.col("ready_ts")).alias("ready_ts"))
        .withColumn("timed_out", F.col("ready_ts").isNull())
    )


def latest_run(
    runs: DataFrame,
    keys: Sequence[str] = ("distro_id", "scenario_id"),
    ts: str = "ts",
    tie: str = "run_id",
) -> DataFrame:
    """The last run per distro and scenario."""
    return first_match(runs, keys, [F.col(ts).desc(), F.col(tie).desc()])


def step_sequence(
    steps: DataFrame,
    keys: Sequence[str] = ("scenario_id",),
    order: Sequence[str] = ("ordinal",),
    phase: str = "phase",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Steps in order with the phase before and whether the phase changed."""
    scanned = running(steps, keys, order, {"previous_phase": ("previous", phase)}, rows_per_task)
    before = F.col("previous_phase")
    return scanned.withColumn(
        "phase_changed", before.isNotNull() & ~before.eqNullSafe(F.col(phase))
    )


def acquisition_order(images: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per run: times of its memory and disk image, and whether memory came first.

    ``ordered`` is null if one of the two is missing.
    """
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col(ts)))
    return (
        images.groupBy("run_id")
        .agg(at("memory").alias("memory_ts"), at("disk").alias("disk_ts"))
        .withColumn("ordered", F.col("memory_ts") <= F.col("disk_ts"))
    )


def assign_runs(
    events: DataFrame,
    delimiter: str = "revert",
    tie: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds ``run_no``: each revert of a machine opens its next run.

    Events before the first revert are run 0.
    """
    marked = events.withColumn("__start", (F.col("kind") == delimiter).cast("bigint"))
    return running(
        marked, ["vm"], ["ts", *tie], {"run_no": ("sum", "__start")}, rows_per_task
    ).drop("__start")
