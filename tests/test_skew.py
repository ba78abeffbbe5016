"""Joins and scans against plain ones, with a third of all rows on one key."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.operators import skew


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)
    keys = [1] * 100 + [None] * 30 + [rng.randrange(2, 60) for _ in range(170)]
    left = [(k, None if k and k % 7 == 0 else f"b{(k or 0) % 3}", i) for i, k in enumerate(keys)]
    right = [(k, f"b{k % 3}", f"r{j}") for k in range(0, 40) for j in range(k % 3)]
    right += [(1, "b1", "extra"), (None, "b0", "null")]
    return (
        spark.createDataFrame(left, "k int, b string, id int").cache(),
        spark.createDataFrame(right, "k int, b string, r string").cache(),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("on", [["k"], ["k", "b"]])
@pytest.mark.parametrize("rows_per_task", [1, 7, 1000])
def test_salted_join(sides, how, on, rows_per_task):
    left, right = sides
    right = right.select(*on, "r")
    got = skew.salted_join(left, right, on, how, ["id"], rows_per_task)
    want = left.join(right, on, how)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_right_side_is_not_broadcast(spark):
    """Spark takes what is exploded from five rows for five rows."""
    right = spark.range(5).select(F.explode(F.sequence(F.lit(0), F.lit(999))).alias("k"))
    left = spark.range(50).select(F.col("id").cast("int").alias("k"), "id")
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = skew.salted_join(left, right, ["k"], how, ["id"])
        lines = joined._jdf.queryExecution().executedPlan().toString().split("\n")
        salted = [line for line in lines if "Join" in line and "__salt" in line]
        assert salted and all("SortMergeJoin" in line for line in salted)


def test_hot_key_is_dealt_out(sides):
    left, right = sides
    hot = skew.hot_keys(left.dropna(subset=["k"]), ["k"], 10)
    assert rows(hot, "k", "__splits") == [(1, 10)]
    joined = skew.salted_join(left, right, ["k"], "inner", ["id"], 10)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan


def test_checked_join_asks_for_the_size(sides):
    left, right = sides
    small = skew.checked_join(left, right, ["k"], "inner", ["id"])
    large = skew.checked_join(left, right, ["k"], "inner", ["id"], max_rows=3)
    assert "__salt" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in large._jdf.queryExecution().optimizedPlan().toString()
    assert rows(small) == rows(large)


def test_is_small(spark):
    assert skew.is_small(spark.range(10), 10)
    assert not skew.is_small(spark.range(11), 10)
    assert not skew.fits(1, skew.BROADCAST_CHARS + 1)


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp", "timestamp_ntz", "date"])
@pytest.mark.parametrize("rows_per_task", [1, 5, 40, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running(spark, kind, rows_per_task, descending):
    rng = random.Random(rows_per_task)
    data = []
    for i in range(300):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = rng.choice([None, rng.randrange(100)])
        # A burst: many rows of the hot key at nearly the same time.
        at = 500 + rng.randrange(4) if i % 2 else rng.randrange(1000)
        data.append((key, at, i, value))
    df = spark.createDataFrame(data, "key string, n bigint, id bigint, v bigint")
    at = {
        "timestamp": F.timestamp_seconds(F.col("n")),
        "timestamp_ntz": F.timestamp_seconds(F.col("n")).cast("timestamp_ntz"),
        "date": F.date_add(F.lit("2026-01-01").cast("date"), F.col("n").cast("int")),
    }.get(kind, F.col("n").cast(kind))
    df = df.withColumn("at", at)
    values = {"last": ("last", "v"), "total": ("sum", "v"), "before": ("previous", "v")}
    got = skew.running(df, ["key"], ["at", "id"], values, rows_per_task, descending)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("at", "id")]
    w = Window.partitionBy("key").orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns(
        {
            "last": F.last("v", ignorenulls=True).over(so_far),
            "total": F.sum("v").over(so_far),
            "before": F.lag("v").over(w),
        }
    )
    columns = ["key", "id", "last", "total", "before"]
    assert rows(got, *columns) == rows(want, *columns)


def test_order_by_text(spark):
    data = [("k", f"{i % 7}", i) for i in range(40)]
    df = spark.createDataFrame(data, "key string, at string, id int")
    for rows_per_task in (5, 1000):
        got = skew.running(df, ["key"], ["at", "id"], {"before": ("previous", "id")}, rows_per_task)
        order = sorted(data, key=lambda r: r[1:])
        want = dict(zip([r[2] for r in order], [None, *[r[2] for r in order]]))
        assert {r.id: r.before for r in got.collect()} == want


def test_chunks_bound_a_hot_group(spark):
    df = spark.range(1000).select(F.lit("hot").alias("key"), "id", F.col("id").alias("at"))
    hot, others, rows_ = skew.hot_rows(df, ["key"], 100)
    assert rows_ == 1000 and others.isEmpty()
    chunked = skew.ordered_chunks(hot, ["key"], ["at"], rows_, 100)
    assert chunked.groupBy("key", "__chunk").count().agg(F.max("count")).first()[0] <= 200
    hot, others, rows_ = skew.hot_rows(df, ["key"], 1000)
    assert rows_ == 0 and hot.isEmpty() and others.count() == 1000


def test_rows_of_one_time_stamp_are_cut(spark):
    """A third of the rows stand at one time, half of those being one row repeated."""
    data = [("hot", 5, i if i % 2 else 0, 1) for i in range(300)] + [("hot", i % 11, 1000 + i, 1) for i in range(300)]
    df = spark.createDataFrame([*data, ("cold", 1, 1, 1)], "key string, at int, id int, one int").repartition(3)
    hot, _, n = skew.hot_rows(df, ["key"], 40)
    sizes = skew.ordered_chunks(hot, ["key"], ["at"], n, 40).groupBy("__chunk").count().agg(F.max("count")).first()[0]
    assert n == 600 and sizes <= 120
    got = skew.running(df, ["key"], ["at"], {"total": ("sum", "one")}, 40)
    # Each row of a key has its own running total.
    assert sorted(r.total for r in got.where("key = 'hot'").collect()) == list(range(1, 601))
    by_time = got.where("key = 'hot'").groupBy("at").agg(F.max("total").alias("t")).collect()
    assert {r["at"]: r.t for r in by_time} == {a: sum(x[1] <= a for x in data) for a in {x[1] for x in data}}


def test_small_chunks_do_not_make_many_partitions(spark):
    df = spark.range(3000).select(F.lit("hot").alias("key"), F.col("id").alias("at"))
    chunked = skew.ordered_chunks(df, ["key"], ["at"], 3000, 2)
    sizes = chunked.groupBy("__chunk").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("__chunk").collect()
    assert max(r.n for r in sizes) <= 2
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))
    files = chunked.select(F.input_file_name().alias("file")).distinct().count()
    assert files <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_over_two_thousand_chunks(spark):
    n = 2300
    df = spark.range(n).select(F.lit("hot").alias("key"), F.col("id").alias("at"), (F.col("id") % 3).alias("v"))
    values = {"total": ("sum", "v"), "before": ("previous", "at")}
    got = skew.running(df, ["key"], ["at"], values, 1).collect()
    totals, total = {}, 0
    for i in range(n):
        total += i % 3
        totals[i] = total
    assert {r["at"]: r.total for r in got} == totals
    assert all(r.before == (r["at"] - 1 if r["at"] else None) for r in got)


# --- exact ranks ------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["spread", "one hot value", "one hot bucket", "far apart", "all equal"])
def test_values_at_ranks(spark, kind):
    rng = random.Random(3)
    value = {
        "spread": lambda: rng.random(), "one hot value": lambda: rng.choice([7.0] * 8 + [rng.random() * 20]),
        "one hot bucket": lambda: rng.choice([5 + rng.random() * 1e-9] * 20 + [rng.random() * 1e9]),
        "far apart": lambda: 10.0 ** rng.randrange(-300, 300), "all equal": lambda: 4.0,
    }[kind]
    data = [(g, value()) for g, n in (("a", 1500), ("b", 900), (None, 40)) for _ in range(n)]
    given = spark.createDataFrame(data, "g string, __value double").select(F.struct("g").alias("__group"), "__value")
    by = {}
    for g, v in data:
        by.setdefault(g, []).append(v)
    wanted = [((g,), k, len(vs)) for g, vs in by.items() for k in {0, 1, len(vs) // 2, len(vs) - 1}]
    ranks = spark.createDataFrame(wanted, "__group struct<g: string>, __rank bigint, __n bigint")
    for rows_per_task in (3, 100, 10_000):
        got = skew.values_at_ranks(given, ranks, rows_per_task).collect()
        assert {(r["__group"].g, r["__rank"]): r["__value"] for r in got} == {(g, k): sorted(by[g])[k] for (g,), k, _ in wanted}
