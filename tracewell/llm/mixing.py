"""Mixing sources to target weights: budgets flow down a tree, prefixes fill them.

Method: texts are leaves' rows of a tree, such as domain, language, source. A token
budget is divided among the children of each node by weight, but no child gets
more than its subtree can give (its tokens, times the most epochs). What one child
lacks is given to its siblings, again by weight, before it is anything
an ancestor has to place: a node's own share is bounded by what its subtree holds, so
a shortage leaves the node only if all of it is used up. A leaf takes whole epochs
while they fit, and of the next epoch the prefix that fits, in an order seeded by
the epoch. All numbers are whole, so the result is the same on every run.

Prefixes of large leaves: the order is a hash, and its first digits make buckets.
Token sums of buckets tell where a leaf's prefix ends; only that one bucket is put
in order and summed row by row.

Defined cases: a null text has no tokens; a null level is a node of its own; a null id
is ordered like an empty one. Rows that are equal in id and tokens are taken or left
together. Names that no weight is given for weigh 1; a weight of 0 takes nothing.
An empty table gives no rows. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import as_row, from_row, spread, whole, written
from tracewell.llm.textops import SPACE_CHARS

# Hex digits of the order that make the buckets of a leaf.
BUCKET_DIGITS = 3

WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    blanks = F.translate(whole(text), SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1))
    return F.size(F.filter(F.split(blanks, " "), lambda w: w != "")).cast("long")


def weight(name: Column, weights: Mapping[str, int]) -> Column:
    chosen = F.lit(1)
    for value, number in weights.items():
        chosen = F.when(name == F.lit(f"={value}"), F.lit(number)).otherwise(chosen)
    return chosen.cast("long")


def shared_out(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Adds ``got``: each child's part of its parent's budget.

    Children have ``weight``, ``cap`` and their parent's ``budget``. Sorted by how
    soon they are full, the full ones come first; the rest divide what is left.
    """
    among = Window.partitionBy(*parent)
    order = among.orderBy((F.col("cap").cast("double") / F.col("weight")), "node")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = (
        children.where("weight > 0").withColumn("before", before.cast(WIDE)).withColumn("onward", onward.cast(WIDE))
        .withColumn("full", F.expr("cap * onward <= weight * (budget - before)"))
    )
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(among), F.lit(0)).cast(WIDE)
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(among).cast(WIDE)
    return (
        marked.withColumn("taken", taken).withColumn("rest", rest)
        .withColumn("got", F.expr("CASE WHEN full THEN cap ELSE CAST((weight * (budget - taken)) div rest AS BIGINT) END"))
        .drop("before", "onward", "full", "taken", "rest")
    )


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """Tokens each leaf may give. ``leaves``: level columns and ``tokens``."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    root = leaves.agg(F.floor(F.sum("tokens") * percent / 100).cast("long").alias("budget")).withColumn("root", F.lit(1))
    above, path = root, ["root"]
    caps = caps.withColumn("root", F.lit(1))
    for level, given in zip(levels, weights, strict=True):
        children = caps.groupBy(*path, level).agg(F.sum("cap").cast("long").alias("cap"))
        children = children.withColumn("weight", weight(F.col(level), given)).withColumn("node", F.col(level))
        shares = shared_out(children.join(above, path), path)
        path = [*path, level]
        above = shares.select(*path, F.col("got").alias("budget"))
    return above.drop("root")


def order_key(seed: int, epoch: Column, id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"))


def mixed(
    df: DataFrame,
    levels: Sequence[Column],
    weights: Sequence[Mapping[str, int]],
    percent: int,
    id: str = "doc_id",
    text: str = "text",
    name: str = "mix",
    max_epochs: int = 1,
    seed: int = 1,
    keep_text: bool = True,
) -> DataFrame:
    """All rows and columns and a struct ``name``: tokens, budget of the leaf, copies.

    ``copies`` is in how many epochs the row is taken, 0 if in none. ``percent`` of all
    tokens is the budget at the root. Without ``keep_text`` the text is left out.
    """
    keys = [f"level{i}" for i in range(len(levels))]
    columns = [c for c in df.columns if c != name and (keep_text or c != text)]
    named = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?")).alias(k) for k, c in zip(keys, levels, strict=True)]
    counted = spread(df).select(as_row(columns), F.col(f"`{id}`").alias("id"), *named, word_count(F.col(f"`{text}`")).alias("tokens"))
    rows = written(counted, "mixing")
    leaves = rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    share = budgets(leaves, keys, weights, percent, max_epochs)
    plan = leaves.join(share, keys, "left").select(
        *keys, F.coalesce("budget", F.lit(0)).cast("long").alias("budget"),
        F.expr("CASE WHEN tokens > 0 THEN coalesce(budget, 0) div tokens ELSE 0L END").alias("whole"),
        F.expr("CASE WHEN tokens > 0 THEN coalesce(budget, 0) % tokens ELSE 0L END").alias("left"),
    )
    plan = written(plan, "mixing_plan")
    planned = rows.join(plan, keys).withColumn("order", order_key(seed, F.col("whole") + 1, F.col("id")))
    planned = planned.withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    # Where each leaf's prefix ends: the first bucket that does not fit whole.
    sums = planned.groupBy(*keys, "bucket").agg(F.sum("tokens").alias("tokens"), F.max("left").alias("left"))
    upto = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("bucket"))
    ends = sums.withColumn("upto", upto).where("upto > left").groupBy(*keys).agg(
        F.min("bucket").alias("end"), F.min(F.col("upto") - F.col("tokens")).alias("base")
    )
    ends = written(ends, "mixing_ends")
    placed = planned.join(ends, keys, "left")
    inside = F.when(F.col("end").isNull() | (F.col("bucket") < F.col("end")), F.lit(1)).otherwise(F.lit(0))
    plain = placed.where(F.col("end").isNull() | (F.col("bucket") != F.col("end"))).withColumn("in", inside)
    edge = placed.where(F.col("bucket") == F.col("end"))
    running = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("order", "tokens"))
    edge = edge.withColumn("in", F.when(F.col("base") + running <= F.col("left"), F.lit(1)).otherwise(F.lit(0)))
    both = plain.unionByName(edge)
    # A leaf without tokens or weight gives nothing.
    copies = F.when(F.col("budget") > 0, F.col("whole") + F.when(F.col("left") > 0, F.col("in")).otherwise(0)).otherwise(0)
    extra = F.struct(F.col("tokens").alias("tokens"), F.col("budget").alias("budget"), copies.cast("long").alias("copies"))
    return both.select(*from_row(columns), extra.alias(name))
