"""Joins and ordered scans that hold up when one key has a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.session import work_path

# Rows of one key that a single task may be given.
ROWS_PER_TASK = 2_000_000

# A side is broadcast only if it is proven to stay below both.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32 * 1024 * 1024


def measure(df: DataFrame, **more: Column) -> Row:
    """Rows and characters of a table, and what else is asked, in one job."""
    chars = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    extra = [column.alias(name) for name, column in more.items()]
    return df.agg(F.count("*").alias("rows"), chars.alias("chars"), *extra).first()


def fits(rows: int, chars: int, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of that size may be broadcast."""
    return rows <= max_rows and chars <= BROADCAST_CHARS


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table is proven small. Looks at no more than ``max_rows`` + 1 rows."""
    size = measure(df.limit(max_rows + 1))
    return fits(size["rows"], size["chars"], max_rows)


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int) -> DataFrame:
    """Keys with more rows than one task should take, and how many it needs.

    Counted with partial aggregation, so a hot key costs one row per map task.
    The result has at most ``rows / rows_per_task`` rows.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("__rows"))
        .where(F.col("__rows") > rows_per_task)
        .withColumn("__splits", F.ceil(F.col("__rows") / rows_per_task).cast("int"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    A hot key's left rows are dealt over several tasks, and the right rows of
    that key are repeated once per task. Every other key keeps salt 0. Rows
    without a key match nothing, so they are dealt out freely. Right for inner,
    left, left_semi and left_anti.

    Rows are dealt by the hash of the ``spread`` columns and the number of the
    partition they come from: copies of a row differ in the latter, and a task
    that runs again deals its rows in the same way.

    The right side is never broadcast: Spark's estimate of a derived table (exploded,
    parsed from text) may be a small part of what it holds.
    """
    on = list(on)
    # Bounded by rows / rows_per_task, see hot_keys.
    hot = F.broadcast(
        hot_keys(left.dropna(subset=on), on, rows_per_task).select(*on, "__splits")
    )
    spread_hash = F.xxhash64(*[F.col(c) for c in spread], F.spark_partition_id())
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    salted = left.join(hot, on, "left").withColumn(
        "__salt",
        F.when(no_key, spread_hash)
        .when(F.col("__splits").isNull(), F.lit(0).cast("bigint"))
        .otherwise(F.pmod(spread_hash, F.col("__splits").cast("bigint"))),
    )
    last_salt = F.coalesce(F.col("__splits"), F.lit(1)).cast("bigint") - 1
    repeated = right.join(hot, on, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last_salt))
    )
    return (
        salted.drop("__splits")
        .join(repeated.drop("__splits").hint("merge"), [*on, "__salt"], how)
        .drop("__salt")
    )


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Broadcast the right side if it is proven small, else a salted join."""
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), list(on), how)
    return salted_join(left, right, on, how, spread, rows_per_task)


# --- ordered scans -----------------------------------------------------------


def _hashable(df: DataFrame) -> list[str]:
    """Columns that can be hashed: no maps and no variants in them."""
    return [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def hot_rows(df: DataFrame, keys: Sequence[str], rows_per_task: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows of hot keys, all others, and how many hot ones there are."""
    keys = list(keys)
    hot = hot_keys(df, keys, rows_per_task)
    size = measure(hot, total=F.coalesce(F.sum("__rows"), F.lit(0)))
    if not size["total"]:
        return df.limit(0), df, 0
    # A struct, as a null key joins like any other then. At most
    # rows / rows_per_task keys; beyond the measured bound the join is a shuffle,
    # whose large partitions Spark splits.
    named = hot.select(F.struct(*keys).alias("__hot"))
    named = F.broadcast(named) if fits(size["rows"], size["chars"]) else named
    marked = df.withColumn("__hot", F.struct(*keys))
    return (
        marked.join(named, "__hot", "left_semi").drop("__hot"),
        marked.join(named, "__hot", "left_anti").drop("__hot"),
        size["total"],
    )


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, rows_per_task: int) -> DataFrame:
    """The rows in chunks of at most ``rows_per_task`` that follow keys and order.

    Adds ``__chunk``. Spark's range partitioning finds the bounds, over keys, order
    and ``__tie``, which tells equal rows apart as well: any group can be cut, also
    rows of one time stamp. A partition is sorted and cut into as many chunks as it
    takes, so small chunks do not make many partitions: there are no more than
    the session's shuffle partitions, or one for each ``ROWS_PER_TASK`` rows. The
    chunks are a table in the shared folder, so a row has the same chunk in every
    part of a plan and in every retry.
    """
    spark = df.sparkSession
    path = work_path(spark, "chunks")
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
    partitions = max(1, min(most, -(-rows // rows_per_task)))
    tied = df.withColumn("__tie", F.struct(F.xxhash64(*_hashable(df)).alias("h"), F.monotonically_increasing_id().alias("n")))
    by = [*keys, *order, "__tie"]
    dealt = tied.repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    # The number of the partition, then that of the row in it.
    row = F.monotonically_increasing_id()
    within = row.bitwiseAND(F.lit((1 << 33) - 1))
    chunk = row - within + F.floor(within / F.lit(rows_per_task))
    dealt.withColumn("__chunk", chunk.cast("bigint")).write.parquet(path)
    return spark.read.parquet(path)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, str]],
    rows_per_task: int = ROWS_PER_TASK,
    descending: bool = False,
) -> DataFrame:
    """Running values per key, in order, each row included.

    ``values`` maps a new column to (kind, column), the kind being ``last``
    (latest non-null value so far), ``sum`` or ``previous`` (the value of the
    row before). Rows that ``order`` does not tell apart come in some fixed order.

    Keys of few rows share one window. The rows of hot keys are cut into chunks
    (``ordered_chunks``), as many as it takes; each is scanned by a task of its own,
    and what the earlier chunks left is added from a summary of one row per key and
    chunk.
    """
    keys, order = list(keys), list(order)
    hot, others, rows = hot_rows(df, keys, rows_per_task)
    tie = F.xxhash64(*_hashable(df))
    result = others.withColumns(_local(Window.partitionBy(*keys), [*order, tie], values, descending))
    if rows:
        chunks = ordered_chunks(hot, keys, order, rows, rows_per_task)
        scanned = _carried(chunks, keys, order, values, descending)
        result = result.select(*df.columns, *values).union(scanned.select(*df.columns, *values))
    return result.select(*df.columns, *values)


def _local(groups, order: Sequence[str | Column], values: dict[str, tuple[str, str]], descending: bool) -> dict[str, Column]:
    named = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = groups.orderBy(*[c.desc() if descending else c.asc() for c in named])
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    make = {
        "last": lambda c: F.last(c, ignorenulls=True).over(so_far),
        "sum": lambda c: F.sum(c).over(so_far),
        "previous": lambda c: F.lag(c).over(rows),
    }
    return {name: make[kind](column) for name, (kind, column) in values.items()}


def _carried(
    chunked: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]], descending: bool
) -> DataFrame:
    """Scans of the chunks, and what the chunks before each have left."""
    groups, within = [*keys, "__chunk"], [*order, "__tie"]
    at = F.struct(*within)
    edge = F.min_by if descending else F.max_by
    summary = {
        "last": lambda c: edge(c, F.when(F.col(c).isNotNull(), at)),
        "sum": lambda c: F.sum(c),
        "previous": lambda c: edge(F.struct(c), at),
    }
    side = F.col("__chunk").desc() if descending else F.col("__chunk").asc()
    chunks = Window.partitionBy(*keys).orderBy(side)
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry = {
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "sum": lambda c: F.sum(c).over(before),
        "previous": lambda c: F.lag(c).over(chunks),
    }
    carried = (
        chunked.groupBy(*groups)
        .agg(*[summary[k](c).alias(f"__carry_{n}") for n, (k, c) in values.items()])
        .withColumns({f"__carry_{n}": carry[k](f"__carry_{n}") for n, (k, _) in values.items()})
        .select(F.struct(*groups).alias("__at"), *[f"__carry_{n}" for n in values])
    )
    window = Window.partitionBy(*groups)
    named = [F.col(c).desc() if descending else F.col(c).asc() for c in within]
    local = _local(window, within, values, descending)
    scanned = chunked.withColumns({**local, "__first": F.row_number().over(window.orderBy(*named)) == 1, "__at": F.struct(*groups)})
    combine = {
        "last": lambda n: F.coalesce(n, f"__carry_{n}"),
        "sum": lambda n: F.coalesce(F.col(n) + F.col(f"__carry_{n}"), n, f"__carry_{n}"),
        "previous": lambda n: F.when(
            F.col("__first"), F.col(f"__carry_{n}").getField(values[n][1])
        ).otherwise(F.col(n)),
    }
    return scanned.join(carried, "__at", "left").withColumns({n: combine[k](n) for n, (k, _) in values.items()})


# --- exact ranks -------------------------------------------------------------

# Values an interval is cut at in one round, and how exact they are to be.
CUTS = 63
CUT_ACCURACY = 1_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _inside(given: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows in the open intervals of their group; a null bound is none."""
    joined = checked_join(given, intervals, ["__group"], "inner", ["__value"])
    above = F.col("__low").isNull() | (F.col("__value") > F.col("__low"))
    below = F.col("__high").isNull() | (F.col("__value") < F.col("__high"))
    return joined.where(above & below)


def values_at_ranks(given: DataFrame, wanted: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The value at each rank (from 0) of a group: ``__group``, ``__rank``, ``__value``.

    ``given`` has ``__group`` and ``__value`` (no nulls), ``wanted`` ``__group``,
    ``__rank`` and ``__n``, the rows of the group. An interval of values that holds
    a wanted rank and too many rows is cut at approximate quantiles of its own, and
    its rows are counted between and at the cuts. That says exactly where the rank
    lies: at a cut, which is the value, however often it stands there, or between
    two, where the next round goes on with a small part of the rows. What is left
    is sorted, at most ``rows_per_task`` rows to a task.
    """
    kind = given.schema["__value"].dataType
    nothing = F.lit(None).cast(kind)
    state = _written(
        wanted.select("__group", "__rank", nothing.alias("__low"), nothing.alias("__high"), F.lit(0).cast("bigint").alias("__below"), "__n"),
        "ranks",
    )
    interval = ["__group", "__low", "__high", "__below"]
    grid = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    found, small = [], []
    while True:
        small.append(state.where(F.col("__n") <= rows_per_task))
        large = state.where(F.col("__n") > rows_per_task)
        if large.isEmpty():
            break
        within = _inside(given, large.select(*interval).distinct())
        cuts = F.array_distinct(F.percentile_approx("__value", grid, CUT_ACCURACY))
        # A table, as approximate quantiles may differ when computed again.
        bounds = _written(within.groupBy(*interval).agg(F.array_sort(cuts).alias("__cuts")), "cuts")
        # 2 i between the cuts i - 1 and i, 2 i + 1 at the cut i.
        place = 2 * F.size(F.filter("__cuts", lambda c: c < F.col("__value"))) + F.array_contains("__cuts", F.col("__value")).cast("int")
        upto = F.sum("__here").over(Window.partitionBy("__group", "__below").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
        counted = (
            _inside(given, bounds).groupBy(*interval, "__cuts", place.alias("__place")).agg(F.count("*").alias("__here"))
            .withColumn("__upto", upto + F.col("__below"))
        )
        ranks = large.select("__group", "__below", "__rank")
        met = counted.join(ranks, ["__group", "__below"]).where(
            (F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__here"))
        )
        at = lambda i: F.get("__cuts", i.cast("int"))
        half = F.floor(F.col("__place") / 2)
        exact = F.col("__place") % 2 == 1
        state = _written(
            met.select(
                "__group", "__rank", F.when(exact, at(half)).alias("__value"),
                F.when(half > 0, at(half - 1)).otherwise(F.col("__low")).alias("__low"),
                F.coalesce(at(half), F.col("__high")).alias("__high"),
                (F.col("__upto") - F.col("__here")).alias("__below"), F.col("__here").alias("__n"),
            ),
            "ranks",
        )
        found.append(state.where("__value IS NOT NULL").select("__group", "__rank", "__value"))
        state = state.where("__value IS NULL").drop("__value")
    rest = reduce(DataFrame.union, small)
    counts = _inside(given, rest.select(*interval).distinct()).groupBy("__group", "__below", "__value").agg(F.count("*").alias("__here"))
    upto = F.sum("__here").over(Window.partitionBy("__group", "__below").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0))
    sorted_ = counts.withColumn("__upto", upto + F.col("__below")).join(rest.select("__group", "__below", "__rank"), ["__group", "__below"])
    last = sorted_.where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__here")))
    return reduce(DataFrame.union, found, last.select("__group", "__rank", "__value"))
