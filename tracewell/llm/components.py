"""Connected components of a table of links, by star contraction.

Each round sends every node to the smallest node it is linked with, first from
its larger neighbours, then from its smaller ones; the links become stars around
the smallest node of each component in a few rounds. Links are a table all along:
nothing of them comes to the driver but a count. A hot node's links meet only in
a minimum, which is aggregated before the shuffle, and in a join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written


def _least_neighbour(links: DataFrame) -> DataFrame:
    """(node, other) both ways, with the smallest of the node and its neighbours."""
    both = links.union(links.select("b", "a")).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    return both.join(least, "node")


def _round(links: DataFrame) -> DataFrame:
    large = _least_neighbour(links).where("other > node").select(F.col("other").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    # Links now lead from larger to smaller nodes: small star over the smaller side.
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    joined = down.join(least, "a")
    small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(joined.select("a", F.col("low").alias("b")))
    return small.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is its least node.

    ``links`` has two columns of ids; direction, repeats and loops do not matter.
    """
    links = links.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    while True:
        links = written(links, "links")
        # Sums of hashes tell whether a round has changed any link.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        links = _round(links)
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select("component", "component").distinct())
