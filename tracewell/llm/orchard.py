"""Clustering of vectors around centroids, each vector assigned by Orchard's search.

Components become whole numbers, so distances, sums and centroids are exact and the result
does not depend on how the rows are dealt out.

Orchard's search for the nearest centroid: each centroid has the list of all others by rising
distance. A vector starts at some centroid and walks down that one's list. A centroid found to
be closer (or as close, with a smaller number) becomes the current one and its own list is
walked from the start; what was measured before is marked and passed over. The walk stops at
the first entry strictly beyond twice the current distance, as nothing from there on can be
closer or as close. Vectors of a block walk in lockstep. The start is the nearest of about
sqrt(k) evenly numbered centroids.

Each round is one pass over the vectors, written once as longs in the shared folder; a task
returns one sum and count for each cluster, Spark adds them up, and k centroids of ``dims``
numbers reach the driver. The lists (k^2 numbers) are made in each worker, k x dims numbers are
sent. So k is a few thousands at most (``MOST_CENTROIDS``, an error beyond it); hot clusters
cost nothing, as rows are never gathered by cluster.

Rows: a vector that is null, of another length than ``dims``, or with a null, infinite or
not-a-number component is left out. Repeated rows count and are returned as often as they
stand there; a null id is hashed as an empty string; equal hashes are ordered by the bytes of
the components. Fewer vectors than k make fewer centroids; an empty table gives an empty
result. All columns are carried in one struct, whatever their names. A component times
``scale`` beyond ``largest_component`` (2^27 for 64 components), where a squared distance could
leave a long, is an error. There are no texts; vectors are read whole, 4,096 at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import vectors as V
from tracewell.llm.common import as_row, from_row, row_type, written

DIMS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
MOST_CENTROIDS = 4096


def largest_component(dims: int) -> int:
    """No squared distance of vectors up to this size is beyond a long."""
    return math.isqrt((1 << 62) // dims) // 2


class Orchard:
    """Nearest centroids by sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        apart = np.empty((k, k), np.int64)
        for i in range(k):
            apart[i] = ((centroids - centroids[i]) ** 2).sum(axis=1)
        self.lists = np.argsort(apart, axis=1, kind="stable").astype(np.int32)
        self.apart = np.take_along_axis(apart, self.lists, axis=1)
        self.pivots = np.arange(0, k, max(1, math.isqrt(k)))
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller of equals) and squared distance."""
        rows, k = len(x), len(self.centroids)
        seen = np.zeros((rows, k), bool)
        best, distance = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max)
        for p in self.pivots:
            d = ((x - self.centroids[p]) ** 2).sum(axis=1)
            closer = d < distance
            best[closer], distance[closer] = p, d[closer]
            seen[:, p] = True
        self.measured += rows * len(self.pivots)
        place = np.zeros(rows, np.int64)
        walking = np.arange(rows)
        while len(walking):
            at, here = best[walking], place[walking]
            # Squares: d(c, next) > 2 d(x, c) is d2(c, next) > 4 d2(x, c), kept in range by shifting down.
            gap = self.apart[at, here]
            beyond = (gap >> 2 > distance[walking]) | ((gap >> 2 == distance[walking]) & (gap & 3 > 0))
            walking, at, here = walking[~beyond], at[~beyond], here[~beyond]
            other = self.lists[at, here]
            place[walking] += 1
            fresh = np.flatnonzero(~seen[walking, other])
            who, which = walking[fresh], other[fresh]
            seen[who, which] = True
            d = ((x[who] - self.centroids[which]) ** 2).sum(axis=1)
            self.measured += len(who)
            jump = (d < distance[who]) | ((d == distance[who]) & (which < best[who]))
            best[who[jump]], distance[who[jump]], place[who[jump]] = which[jump], d[jump], 0
            walking = walking[place[walking] < k]
        return best, distance


def _longs(batches, dims: int, scale: int):
    for batch in batches:
        places, values = V.matrix(batch.column("in"), dims)
        x = V.floored(values, scale, largest_component(dims))
        yield pa.record_batch([batch.column("row").take(pa.array(places)), batch.column("hash").take(pa.array(places)), V.as_bytes(x)], names=["row", "hash", "x"])


def _sums(batches, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and sums of each cluster in this task's rows, as text of any length."""
    k, dims = centroids.shape
    orchard = Orchard(centroids)
    counts, sums = np.zeros(k, np.int64), [[0] * dims for _ in range(k)]
    for batch in batches:
        for block in V.blocks(V.from_bytes(batch.column(0), dims)):
            cluster, _ = orchard.nearest(block)
            counts += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            ordered = cluster[order]
            firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
            for c, row in zip(ordered[firsts].tolist(), np.add.reduceat(block[order], firsts, axis=0).tolist(), strict=True):
                sums[c] = [a + b for a, b in zip(sums[c], row, strict=True)]
    used = np.flatnonzero(counts).tolist()
    cells = [(c, i, v) for c in used for i, v in enumerate([int(counts[c]), *sums[c]])]
    kinds = [pa.int32(), pa.int32(), pa.string()]
    columns = [[x[0] for x in cells], [x[1] for x in cells], [str(x[2]) for x in cells]]
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "cell", "value"])


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; one without vectors stays."""
    dims = centroids.shape[1]
    parts = table.select("x").mapInArrow(lambda it: _sums(it, centroids), "cluster int, cell int, value string")
    total = parts.groupBy("cluster", "cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value"))
    found = {(r.cluster, r.cell): int(r.value) for r in total.collect()}
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i + 1] // found[c, 0] for i in range(dims)]
    return out


def _assigned(batches, centroids: np.ndarray):
    orchard = Orchard(centroids)
    for batch in batches:
        x = V.from_bytes(batch.column("x"), centroids.shape[1])
        for at in range(0, len(x), V.BLOCK_ROWS):
            cluster, distance = orchard.nearest(x[at : at + V.BLOCK_ROWS])
            part = batch.slice(at, V.BLOCK_ROWS)
            yield pa.record_batch([part.column("row"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["row", "cluster", "distance"])


def clustered(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", name: str = "near", k: int = CENTROIDS,
    rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS,
) -> DataFrame:
    """The rows that have a vector, with all columns and a struct ``name``: cluster, distance
    (squared), cluster_inertia, inertia, centroid_sha256, centroid (its components)."""
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k is 1 to {MOST_CENTROIDS}")
    columns = [c for c in df.columns if c != name]
    as_text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")))
    rows = df.select(as_row(columns), F.sha2(as_text, 256).alias("hash"), F.col(f"`{vector}`").alias("in"))
    table = written(rows.mapInArrow(lambda it: _longs(it, dims, scale), f"{row_type(rows)}, hash string, x binary"), "vectors")
    first = table.select("hash", "x").orderBy("hash", "x").limit(k).collect()
    kind = f"{row_type(rows)}, cluster int, distance long"
    centroids = np.array([np.frombuffer(r.x, "<i8") for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        centroids = moved(table, centroids)
    assigned = written(table.select("row", "x").mapInArrow(lambda it: _assigned(it, centroids), kind), "assigned") if len(first) else table.select(
        "row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")
    )
    # At most k rows: the sums of the clusters and what describes their centroids.
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    about = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest(), row)
        for c, row in enumerate(centroids.tolist())
    ]
    told = df.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    made = F.struct("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid").alias(name)
    return assigned.join(F.broadcast(told), "cluster").select(*from_row(columns), made)
