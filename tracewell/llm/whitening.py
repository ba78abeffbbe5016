"""Whitening of embeddings by the leading principal components.

The eigenvectors of the covariance come from block Jacobi-Davidson and the covariance is
never formed: each product with it is one pass over the vectors, centred row by row.

* The search space is widened by the corrections of all wanted Ritz pairs at once, and of
  ``GUARDS`` more, so that no wanted pair is passed over.
* The correction equation of a pair, projected off the locked vectors and the current Ritz
  vectors, is solved by a few steps of MINRES; the pairs go in lockstep, so a step is one
  pass for all of them.
* Rayleigh-Ritz over the space gives the new pairs. The largest whose residual has reached
  ``TOLERANCE`` of the largest eigenvalue are locked, in order, and the rest of the space
  is kept off them. A full space restarts with its best Ritz vectors.

What a pass sends is the block of vectors (dims x 6 numbers) and what it returns is as large,
from every task, added up by Spark. Distinct vectors are found once by a shuffle and written
as a table in the shared folder.

Rows: a null vector, one with a null, infinite or not-a-number component, and one of another
length than ``dims`` gets no result and is left out. ``dims`` None takes the length of most
vectors. Repeated vectors count once in the fit and each row has its result; null ids and all
other columns are carried in one struct, whatever their names. An empty table gives an empty
one. Components without variance (at most dims * 2^-52 of the whole) can't be whitened and are
left out, so a single distinct vector has no result. Equal eigenvalues: any basis of their
space. ``deviation`` beyond a long is null; an entry times ``scale`` beyond 2^53 is an error.
The table has no texts; a vector is read whole, a block of 4,096 at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import vectors as V
from tracewell.llm.common import as_row, from_row, row_type, written

COMPONENTS = 4
SCALE = 256
GUARDS = 2
INNER_STEPS = 2
MAX_BASIS = 40
TOLERANCE = 64 * 2.0**-52
# Where residuals stop falling this close, rounding of the products is what is left.
FLOOR = 1e-11
MAX_ROUNDS = 400
LARGEST = 1 << 53

Product = Callable[[np.ndarray], np.ndarray]


def minres(product: Product, shifts: np.ndarray, right: np.ndarray, off: Product, steps: int) -> np.ndarray:
    """Approximate solutions of (off A off - shift) t = right, a column each, in lockstep."""
    columns = right.shape[1]
    solution, older, direction, direction_old = (np.zeros_like(right) for _ in range(4))
    now = off(right)
    rest = np.linalg.norm(now, axis=0)
    now = now / np.where(rest > 0, rest, 1)
    c, c_old, s, s_old = np.ones(columns), np.ones(columns), np.zeros(columns), np.zeros(columns)
    beta = np.zeros(columns)
    for _ in range(steps):
        new = off(product(now) - shifts * now)
        alpha = (now * new).sum(axis=0)
        new = off(new - alpha * now - beta * older)
        beta_new = np.linalg.norm(new, axis=0)
        # The new column of the triangular factor, turned by the last two rotations.
        diagonal, above, over = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        length = np.hypot(diagonal, beta_new)
        safe = np.where(length > 0, length, 1)
        c_old, s_old = c, s
        c, s = np.where(length > 0, diagonal / safe, 1), np.where(length > 0, beta_new / safe, 0)
        direction, direction_old = (now - over * direction_old - above * direction) / safe, direction
        solution = solution + np.where(length > 0, c * rest, 0) * direction
        rest = -s * rest
        older, now, beta = now, new / np.where(beta_new > 0, beta_new, 1), beta_new
    return solution


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """A basis of what the block adds to an orthonormal set; twice, against rounding."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(2):
        block = block - against @ (against.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-10 * max(size.max(initial=0), 1e-6)]
    return block[:, : max(0, against.shape[0] - against.shape[1])]


def largest_pairs(
    product: Product, dims: int, wanted: int, inner: int = INNER_STEPS, max_basis: int = MAX_BASIS, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenvalues, unit eigenvectors and residuals of a symmetric positive operator."""
    wanted = min(wanted, dims)
    width = min(wanted + GUARDS, dims)
    max_basis = max(max_basis, 4 * width)
    locked, basis, images = (np.zeros((dims, 0)) for _ in range(3))
    values: list[float] = []
    block = np.random.default_rng(seed).standard_normal((dims, width))
    best, still = np.inf, 0
    for _ in range(MAX_ROUNDS):
        block = _orthonormal(block, np.hstack([locked, basis]))
        if block.shape[1]:
            image = product(block)
            basis = np.hstack([basis, block])
            images = np.hstack([images, image - locked @ (locked.T @ image)])
        small = basis.T @ images
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        scale = max([*values, ritz[0], 1e-300])
        sizes = np.linalg.norm(images[:, :width] - basis[:, :width] * ritz[:width], axis=0) / scale
        still = 0 if sizes[0] < best / 2 else still + 1
        best = min(best, sizes[0])
        whole = basis.shape[1] + locked.shape[1] >= dims
        n = 0
        while n < wanted - len(values) and (sizes[n] <= TOLERANCE or (sizes[n] <= FLOOR and (whole or still > 4))):
            n += 1
        if n:
            locked, values = np.hstack([locked, basis[:, :n]]), [*values, *ritz[:n]]
            basis, images, ritz = basis[:, n:], images[:, n:], ritz[n:]
            images = images - locked @ (locked.T @ images)
            best, still = np.inf, 0
        if len(values) == wanted:
            break
        take = min(wanted - len(values) + GUARDS, basis.shape[1])
        if basis.shape[1] + take > max_basis and not whole:
            basis, images = basis[:, : 2 * width], images[:, : 2 * width]
        near = np.hstack([locked, basis[:, :take]])
        right = basis[:, :take] * ritz[:take] - images[:, :take]
        block = minres(product, ritz[:take], right, lambda y, z=near: y - z @ (z.T @ y), inner)
    else:
        raise ArithmeticError(f"residuals of {sizes} of the largest eigenvalue after {MAX_ROUNDS} rounds")
    # One more Rayleigh-Ritz over the locked vectors puts them in order.
    locked, _ = np.linalg.qr(locked)
    image = product(locked)
    small = locked.T @ image
    found, turn = np.linalg.eigh((small + small.T) / 2)
    found, turn = found[::-1], turn[:, ::-1]
    return found, locked @ turn, np.linalg.norm(image @ turn - (locked @ turn) * found, axis=0) / max(found[0], 1e-300)


@dataclass
class Fit:
    """n distinct vectors, their exact sums, the trace, eigenvalues, components (dims x k)
    and the largest entry of the whitened fit list's covariance minus the identity."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    residuals: np.ndarray
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _packed(batches, dims: int, scale: int):
    for batch in batches:
        _, values = V.matrix(batch.column(0), dims)
        yield pa.record_batch([V.as_bytes(V.floored(values, scale, LARGEST))], names=["x"])


def _totals(block: np.ndarray) -> list[int]:
    """Rows, sum of squares, sums by dimension."""
    if np.abs(block).max(initial=0) < 1 << 20:
        squares, sums = int((block * block).sum()), block.sum(axis=0).tolist()
    else:
        wide = block.astype(object)
        squares, sums = int((wide * wide).sum()), wide.sum(axis=0).tolist()
    return [len(block), squares, *sums]


def fitted(df: DataFrame, vector: str = "embedding", wanted: int = COMPONENTS, scale: int = SCALE, dims: int | None = None) -> Fit | None:
    """The leading components of the distinct scaled vectors; None if there are none."""
    dims = V.common_length(df, vector) if dims is None else dims
    if not dims:
        return None
    longs = df.select(F.col(f"`{vector}`")).mapInArrow(lambda it: _packed(it, dims, scale), "x binary")
    table = written(longs.distinct(), "vectors")
    totals = V.exact_sums(table, dims, _totals)
    if not totals:
        return None
    n, squares, sums = totals[0], totals[1], [totals[i + 2] for i in range(dims)]
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)
    mean = np.array([s / n for s in sums])
    passes = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        width = block.shape[1]

        def work(x):
            centred = x - mean
            return centred.T @ (centred @ block)

        return V.summed(table, dims, work, dims * width).reshape(dims, width) / n

    if trace <= 0:
        return Fit(n, sums, 0.0, np.empty(0), np.empty((dims, 0)), np.empty(0), 0.0, 0)
    values, components, residuals = largest_pairs(product, dims, wanted)
    keep = values > dims * 2.0**-52 * trace
    values, components, residuals = values[keep], components[:, keep], residuals[keep]
    k = len(values)

    def moments(x):
        white = (x - mean) @ components / np.sqrt(values)
        return np.vstack([white.T @ white, white.sum(axis=0)])

    found = V.summed(table, dims, moments, (k + 1) * k).reshape(k + 1, k) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return Fit(n, sums, trace, values, components, residuals, error, passes)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums))
    if largest * largest * x.shape[1] < 1 << 63:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = n * x.astype(object) - np.array(sums, object)
    return [d if d < 1 << 63 else None for d in (away * away).sum(axis=1).tolist()]


def _whiten(batches, fit: Fit, scale: int):
    dims, k = fit.components.shape
    turn = fit.components / np.sqrt(fit.values)
    for batch in batches:
        places, values = V.matrix(batch.column("in"), dims)
        x = V.floored(values, scale, LARGEST)
        for at in range(0, len(x), V.BLOCK_ROWS):
            part = x[at : at + V.BLOCK_ROWS]
            white = (part - fit.mean) @ turn
            ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * k)
            yield pa.record_batch(
                [
                    batch.column("row").take(pa.array(places[at : at + V.BLOCK_ROWS])),
                    pa.array(_deviations(part, fit.n, fit.sums), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(white.ravel())),
                ],
                names=["row", "deviation", "whitened"],
            )


def whitened(
    df: DataFrame, vector: str = "embedding", name: str = "white", wanted: int = COMPONENTS, scale: int = SCALE, dims: int | None = None
) -> DataFrame:
    """The rows that have a vector, with all columns and a struct ``name``: n, deviation,
    whitened and explained (arrays, a value for each component), identity_error."""
    columns = [c for c in df.columns if c != name]
    rows = df.select(as_row(columns), F.col(f"`{vector}`").alias("in"))
    dims = V.common_length(df, vector) if dims is None else dims
    fit = fitted(df, vector, wanted, scale, dims)
    ddl = f"{row_type(rows)}, deviation long, whitened array<double>"
    if fit is None or not len(fit.values):
        out = rows.limit(0).select("row", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        fit = Fit(0, [], 0.0, np.empty(0), np.empty((0, 0)), np.empty(0), 0.0, 0)
    else:
        out = rows.mapInArrow(lambda it: _whiten(it, fit, scale), ddl)
    explained = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values]).cast("array<double>")
    made = F.struct(
        F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )
    return out.select(*from_row(columns), made.alias(name))
