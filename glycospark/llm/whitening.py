"""Whitening of embeddings by a matrix-free Jacobi-Davidson eigensolver.

The covariance is never formed.  All it is needed for are products with a few vectors at a
time, and one pass over the rows gives such a block of products: each task centres its
rows, multiplies them twice and returns one small sum.  The solver itself is small linear
algebra over the dimensions of a vector and runs on the driver, whatever the number of
rows.

One round takes the Ritz pairs of the subspace, locks the leading ones whose residuals are
down to rounding, and solves a projected correction equation for each of the others by a
few steps of MINRES.  All equations step together, so that a step is one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import settle

SCALE, SHIFT = 1024, 100_000
#: Entries are whole numbers below this bound, which doubles hold exactly.
LIMIT = 1 << 53
COMPONENTS = 8
#: Pairs followed beside the wanted ones, steps of MINRES a round, most vectors of the subspace.
GUARD, INNER, SUBSPACE = 4, 4, 96
#: A residual counts as rounding below this share of the largest eigenvalue.
ROUNDING = 1e-13
ROUNDS = 300


class Fit(NamedTuple):
    """Rows and sums of the fit list, and its leading eigenpairs (one column of ``vectors`` each)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


# -- small linear algebra on the driver --------------------------------------------------

Product = Callable[[np.ndarray], np.ndarray]


def minres(rhs: np.ndarray, project: Product, shift: float, steps: int) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """A few steps of MINRES on the projected, shifted matrix.

    Yields the vectors to be multiplied by the matrix, is sent the products, and returns
    the solution.
    """
    x = np.zeros_like(rhs)
    beta = np.linalg.norm(rhs)
    if beta == 0:
        return x
    v_old, v = np.zeros_like(rhs), rhs / beta
    w_old, w = np.zeros_like(rhs), np.zeros_like(rhs)
    eta, c_old, c, s_old, s = beta, 1.0, 1.0, 0.0, 0.0
    floor = beta * 1e-14
    for _ in range(steps):
        product = yield v
        p = project(product - shift * v)
        alpha = v @ p
        p = p - alpha * v - (beta * v_old if v_old.any() else 0)
        p = project(p)
        beta_new = np.linalg.norm(p)
        # the next column of the triangle, by the last two rotations and a new one
        r1 = c * alpha - c_old * s * beta
        r2 = s * alpha + c_old * c * beta
        r3 = s_old * beta
        rho = np.hypot(r1, beta_new)
        if rho == 0:
            break
        c_old, s_old, c, s = c, s, r1 / rho, beta_new / rho
        w_old, w = w, (v - r3 * w_old - r2 * w) / rho
        x = x + c * eta * w
        eta = -s * eta
        if beta_new <= floor or abs(eta) <= floor:
            break
        v_old, v, beta = v, p / beta_new, beta_new
    return x


def _in_step(solvers: list[Generator], times: Product, size: int) -> list[np.ndarray]:
    """Runs the solvers together: what they ask for at the same time is one product."""
    found: list[np.ndarray] = [np.zeros(size)] * len(solvers)
    asked: dict[int, np.ndarray] = {}

    def advance(k: int, answer: np.ndarray | None) -> None:
        try:
            asked[k] = solvers[k].send(answer)
        except StopIteration as end:
            found[k] = end.value

    for k in range(len(solvers)):
        advance(k, None)
    while asked:
        now, asked = asked, {}
        products = times(np.column_stack(list(now.values())))
        for j, k in enumerate(now):
            advance(k, products[:, j])
    return found


def _away_from(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what of ``block`` lies outside ``basis``."""
    out = basis[:, :0]
    for col in block.T:
        full = np.linalg.norm(col)
        for _ in range(3):
            for q in (basis, out):
                col = col - q @ (q.T @ col)
        size = np.linalg.norm(col)
        if full > 0 and size > 1e-10 * full:
            out = np.column_stack([out, col / size])
    return out


def leading_pairs(times: Product, size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix.

    ``times`` multiplies a block of columns by the matrix.  Equal eigenvalues give any
    orthonormal vectors of their space.
    """
    wanted = min(wanted, size)
    follow = min(size, wanted + GUARD)
    basis = _away_from(np.zeros((size, 0)), np.random.default_rng(20_231).standard_normal((size, follow)))
    image = times(basis)
    values, locked = np.zeros(0), np.zeros((size, 0))
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-theta)
        theta, turn = theta[order], turn[:, order]
        ritz, ritz_image = basis @ turn, image @ turn
        left = wanted - len(values)
        some = min(len(theta), left + GUARD)
        residual = ritz_image[:, :some] - ritz[:, :some] * theta[:some]
        residual -= locked @ (locked.T @ residual)
        scale = max([abs(theta[0]) if len(theta) else 0.0, *np.abs(values)])
        small_enough = np.linalg.norm(residual, axis=0) <= ROUNDING * max(scale, np.finfo(float).tiny)
        done = 0
        while done < min(left, some) and small_enough[done]:
            done += 1
        if done:
            values, locked = np.concatenate([values, theta[:done]]), np.column_stack([locked, ritz[:, :done]])
            if len(values) >= wanted:
                # pairs that were locked out of order come into order here
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order]
        keep = slice(done, len(theta) if len(theta) <= SUBSPACE else done + follow)
        basis, image = ritz[:, keep], ritz_image[:, keep]
        open_ = [j for j in range(done, some) if not small_enough[j]]
        rest = np.column_stack([locked, basis])
        solvers = []
        for j in open_:
            near = np.column_stack([locked, ritz[:, j]])
            project = lambda y, near=near: y - near @ (near.T @ y)
            solvers.append(minres(project(-residual[:, j]), project, theta[j], INNER))
        more = _away_from(rest, np.column_stack(_in_step(solvers, times, size))) if solvers else basis[:, :0]
        if not more.shape[1]:
            # the corrections lie in the subspace: fresh products, and a random direction if there is room
            room = size - rest.shape[1]
            more = _away_from(rest, np.random.default_rng(len(values)).standard_normal((size, 1))) if room else basis[:, :0]
            image = times(basis) if basis.shape[1] else image
            image -= locked @ (locked.T @ image)
        if more.shape[1]:
            new = times(more)
            basis, image = np.column_stack([basis, more]), np.column_stack([image, new])
    raise ArithmeticError(f"{wanted - len(values)} of {wanted} eigenpairs did not converge in {ROUNDS} rounds")


# -- passes over the rows ----------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: whole numbers of 64 bits if they fit, else Python's."""
    if n * LIMIT < 1 << 62 or (len(x) and n * int(np.abs(x).max()) < 1 << 61 and max(map(abs, sums)) < 1 << 61):
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _deviations(x, n, sums).astype(np.float64) / n


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], n: int, sums: list[int]) -> np.ndarray:
    """The sum over all rows of ``part(centred rows)``, a matrix with ``width`` columns.

    Each task adds up its own rows; the tasks' matrices are added by Spark, row by row.
    """
    size = len(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_centred(_matrix(batch, size), n, sums))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": np.arange(len(total), dtype=np.int64)} | {f"c{j}": total[:, j] for j in range(width)})

    cols = [f"c{j}" for j in range(width)]
    parts = rows.select("x").mapInArrow(add, ", ".join(["k bigint", *[f"{c} double" for c in cols]]))
    found = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in cols]).orderBy("k").collect()  # one row a dimension
    return np.array([[r[c] for c in cols] for r in found])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x``, the whole numbers of a vector, for rows whose vector can be fitted.

    Left out are vectors that are null or empty, hold null or non-finite entries or such as
    have no exact whole number (``LIMIT``), and vectors of another length than most have
    (of lengths equally frequent, the greater).
    """
    v = F.col(vector_col)
    whole = lambda c: F.floor(c.cast("double") * SCALE)
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * SCALE < LIMIT - 2 * SHIFT)
    good = vectors.where((F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(fits(c), F.lit(False))))
    rows = settle(good.select(F.col(id_col).alias("id"), F.transform(v, lambda c: whole(c).cast("bigint") + SHIFT).alias("x")), "rows")
    lengths = rows.groupBy(F.size("x").alias("k")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "k")).alias("top"), F.count("*").alias("kinds")).first()
    return rows if lengths["kinds"] < 2 else rows.where(F.size("x") == lengths["top"]["k"])


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                # halves, so that no sum of a batch leaves 64 bits
                high, low = x >> 32, x & 0xFFFFFFFF
                yield pa.RecordBatch.from_pydict({"k": np.arange(x.shape[1]), "n": np.full(x.shape[1], len(x)), "high": high.sum(axis=0), "low": low.sum(axis=0)})

    parts = rows.select("x").mapInArrow(add, "k bigint, n bigint, high bigint, low bigint")
    big = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = parts.groupBy("k").agg(big("n").alias("n"), big("high").alias("high"), big("low").alias("low")).orderBy("k").collect()  # one row a dimension
    return (int(found[0]["n"]) if found else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def fit(rows: DataFrame, wanted: int) -> Fit:
    n, sums = _totals(rows)
    if not n:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    size = len(sums)
    trace = float(_summed(rows, 1, lambda y: np.array([[np.square(y).sum()]]), n, sums)[0, 0]) / n

    def times(block: np.ndarray) -> np.ndarray:
        return _summed(rows, block.shape[1], lambda y: y.T @ (y @ block), n, sums) / n

    if trace == 0:
        return Fit(n, sums, np.zeros(min(size, wanted)), np.eye(size)[:, :wanted], 0.0)
    values, vectors = leading_pairs(times, size, wanted)
    return Fit(n, sums, values, vectors / np.linalg.norm(vectors, axis=0), trace)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per fitted row and component: id, component, n, deviation, whitened, explained, identity_error.

    A vector's entries become whole numbers, ``floor(SCALE * c) + SHIFT``.  The components
    are the leading eigenvectors of their covariance; ``whitened`` is the centred vector
    along one, over the root of its eigenvalue.  ``identity_error`` is how far the
    covariance of the whitened values is from the identity, measured in one more pass.

    * Rows with null, empty, partly null, non-finite or too large vectors, or with a length
      unlike most, are neither fitted nor returned (``usable``).
    * There are as many components as a vector has entries, if those are fewer.
    * Along a component of no variance (an eigenvalue that is 0 to rounding) whitened is
      null; identity_error covers the others.  If no vector differs, explained is 0.
    * deviation is exact, and null where it leaves 64 bits.
    * Repeated rows count and are returned each; a null id is kept.  Equal eigenvalues leave
      the choice of vectors in their space open; it is one choice for all rows.
    * An empty table gives an empty result; other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    n, sums, values, axes, trace = fit(rows, components)
    size = len(sums)
    alive = values > (values[0] * size * np.finfo(float).eps if len(values) else 0)
    weights = axes[:, alive] / np.sqrt(values[alive])
    error = None
    if weights.shape[1]:

        def second(y: np.ndarray) -> np.ndarray:
            w = y @ weights
            return np.vstack([w.T @ w, w.sum(axis=0)])

        total = _summed(rows, weights.shape[1], second, n, sums) / n
        error = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(weights.shape[1])).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _deviations(_matrix(batch, size), n, sums)
            peak = max(abs(int(d.max())), abs(int(d.min())))
            exact = np.square(d if d.dtype == object or peak * peak * size < 1 << 62 else d.astype(object)).sum(axis=1)
            whitened = np.full((len(d), len(values)), np.nan)
            whitened[:, alive] = (d.astype(np.float64) / n) @ weights
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "deviation": pa.array([int(e) if e < 1 << 63 else None for e in exact], pa.int64()),
                    "w": pa.array(whitened.tolist(), pa.list_(pa.float64())),
                }
            )

    kind = vectors.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(project, f"id {kind}, deviation bigint, w array<double>") if n else rows.select("id", F.lit(None).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("w"))
    shares = F.array(*[F.lit(float(e / trace) if trace else 0.0) for e in values]).cast("array<double>")
    out = out.select("id", "deviation", F.posexplode("w").alias("k", "v"))
    at: Column = F.get(shares, F.col("k"))
    return out.select(
        F.col("id").alias(id_col),
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.nanvl("v", F.lit(None).cast("double")).alias("whitened"),
        at.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
