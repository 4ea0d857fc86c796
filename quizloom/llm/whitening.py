"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries c become whole numbers x = floor(256 c). Each distinct x vector is fitted once: X has a row a
vector, less the means. Unit vectors v (as long as a row) and u (as long as the table) are made in turn: u from
X v less the last u, v from Xᵀ u less the last v. Their lengths are the diagonals of a small bidiagonal matrix,
whose singular values and right vectors give the components.

Each step is one pass over the fitted rows, without an exchange of rows. An entry of u is a row's product with
a vector as short as a row, so u isn't stored: the pass makes a row's entry of X v and of all earlier u, and adds
up Xᵀ of it, its length and its products with the earlier u, which are taken off (full reorthogonalisation; v's
are, too, where they are held, on the driver). What a task returns are two vectors and a number.

Steps end once the components have converged and what is left of the trace is less than the last of them,
so that no equal one is missed; after as many steps as a vector has entries they are exact. Where a vector is
used up, the next begins anew, orthogonal to all before.

Nulls: vectors that are null or hold null or non-finite entries take no part, nor do those of another length
than most, or with an entry beyond ±2^44 (x has to be exact in double precision). Zero vectors do. Rows with a null
id or a repeated id each have their own rows in the result. Components without any spread (e at most 1e-12 of the
largest) are left out, so a table of equal rows, or an empty one, gives no rows. A deviation that doesn't fit a long is
null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.common import materialise, tidy
from quizloom.llm.vectors import matrix

#: Rows of X that a task holds as doubles at once.
ROWS = 4096
#: What an exchange of the vectors' whole numbers keeps exact.
LARGEST = float(1 << 44)
#: What counts as nothing next to the largest singular value, and how far a component may be off.
NOTHING, CLOSE = 1e-13, 1e-13


def whole(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x (array<bigint>): rows that take part, by their whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    fit = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & fit & (F.size("v") > 0))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c * 256).cast("long")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (sizes["d"] if sizes else 0))


def parts(column: pa.Array) -> Iterator[np.ndarray]:
    for lo in range(0, len(column), ROWS):
        yield matrix(column.slice(lo, ROWS))


def totals(fit: DataFrame) -> tuple[int, list[int], list[int]]:
    """Rows, and for each place the sum and the sum of squares of x, exactly."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.column("x").slice(lo, ROWS)
                x = part.flatten().to_numpy().reshape(len(part), -1)
                if np.abs(x).max() >= 1 << 24:  # beyond it, squares of ROWS rows may not fit a long
                    x = x.astype(object)
                n += len(x)
                more = [[int(s) for s in x.sum(0)], [int(s) for s in (x * x).sum(0)]]
                sums, squares = more if sums is None else ([a + b for a, b in zip(s, m)] for s, m in zip((sums, squares), more))
        for place, (s, q) in enumerate(zip(sums or [], squares or [])):
            kind = pa.decimal128(38, 0)
            yield pa.record_batch({"place": pa.array([place], pa.int32()), "n": pa.array([n], pa.int64()), "s": pa.array([s]).cast(kind) if abs(s) < 1 << 62 else pa.array([_decimal(s)], kind), "q": pa.array([_decimal(q)], kind)})

    found = fit.mapInArrow(rows, "place int, n long, s decimal(38,0), q decimal(38,0)").groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("place").collect()
    return found[0]["n"] if found else 0, [int(r["s"]) for r in found], [int(r["q"]) for r in found]


def _decimal(n: int):
    import decimal

    return decimal.Decimal(n)


def added(sums: DataFrame) -> np.ndarray:
    """The tasks' rows added up, in one task that holds a row at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(matrix(batch.column("sums")).sum(0) for batch in batches if batch.num_rows)
        yield pa.record_batch({"sums": pa.array([total], pa.list_(pa.float64()))})

    return np.array(sums.repartition(1).mapInArrow(rows, "sums array<double>").collect()[0]["sums"])  # whole, so that workers live on


def product(fit: DataFrame, mean: np.ndarray, v: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For w = (X - mean) v: (X - mean)ᵀ w, the products of w with each (X - mean) column of before, and w's squared length.

    One pass, of which each task returns a row.
    """
    d = len(mean)
    shared = fit.sparkSession.sparkContext.broadcast((mean, v, before))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, v, before = shared.value
        out = np.zeros(2 * d + 1)
        for batch in batches:
            for x in parts(batch.column("x")):
                x = x - mean
                w = x @ v
                out[:d] += x.T @ w
                out[d : d + before.shape[1]] += (x @ before).T @ w
                out[-1] += w @ w
        yield pa.record_batch({"sums": pa.array([out], pa.list_(pa.float64()))})

    found = added(fit.mapInArrow(rows, "sums array<double>"))
    shared.unpersist()
    return found[:d], found[d : d + before.shape[1]], float(found[-1])


def _orthogonal(v: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    if to:
        basis = np.stack(to)
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
    return v


def bidiagonal(fit: DataFrame, mean: np.ndarray, trace: float, components: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of X - mean, falling, and their right vectors, as columns.

    trace: the sum of all squared singular values.
    """
    d, random = len(mean), np.random.default_rng(seed)

    def fresh(to: list[np.ndarray]) -> np.ndarray:
        v = _orthogonal(random.standard_normal(d), to)
        return v / np.linalg.norm(v)

    scale = np.sqrt(trace)
    vs, ps, alphas, betas = [fresh([])], [], [], []
    while True:
        v, k = vs[-1], len(vs)
        along = v - betas[-1] * ps[-1] if betas else v  # X along = X v - beta u
        back, overlap, square = product(fit, mean, along, np.stack(ps, 1) if ps else np.zeros((d, 0)))
        if ps:  # what rounding left of the earlier u goes
            along = along - np.stack(ps, 1) @ overlap
            back = back - np.stack(backs, 1) @ overlap
            square -= overlap @ overlap
        alpha = np.sqrt(max(square, 0.0))
        if alpha <= NOTHING * scale:
            alpha, p, back = 0.0, np.zeros(d), np.zeros(d)
        else:
            p, back = along / alpha, back / alpha
        backs = [*backs, back] if ps else [back]
        ps.append(p)
        alphas.append(alpha)
        rest = _orthogonal(back - alpha * v, vs)
        beta = float(np.linalg.norm(rest))
        if beta <= NOTHING * scale:
            beta = 0.0
        small = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(small)
        top = min(components, d)
        off = beta * np.abs(left[-1, :top])
        sure = k >= top and (off <= CLOSE * values[0]).all() and trace - (values * values).sum() < (values[top - 1] ** 2)
        if k == d or sure:
            return (values * values)[:top], (np.stack(vs, 1) @ right.T)[:, :top]
        vs.append(rest / beta if beta else fresh(vs))
        betas.append(beta)


def covariance(fit: DataFrame, mean: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of the columns of (X - mean) to, whose own means are taken off."""
    r = to.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 + r + r * r)
        for batch in batches:
            for x in parts(batch.column("x")):
                y = (x - mean) @ to
                out += np.r_[len(y), y.sum(0), (y.T @ y).ravel()]
        yield pa.record_batch({"sums": pa.array([out], pa.list_(pa.float64()))})

    found = added(fit.mapInArrow(rows, "sums array<double>"))
    n, s = found[0], found[1 : 1 + r]
    return found[1 + r :].reshape(r, r) / n - np.outer(s, s) / n**2


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over places of (n x - S)^2, exactly; None where it doesn't fit a long."""
    rough = ((n * x.astype(float) - sums.astype(float)) ** 2).sum(1)
    if len(rough) and rough.max() < 1 << 60 and n * np.abs(x).max() < 1 << 60:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - sums) ** 2).sum(1)
    return [int(e) if e < 1 << 63 else None for e in exact]


@tidy
def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row that takes part and component."""
    spark = rows.sparkSession
    good = materialise(whole(rows, id_col, vector_col), "whole")
    fit = materialise(good.select("x").distinct(), "fit")
    n, sums, squares = totals(fit)
    kind = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    spread = sum(n * q - s * s for s, q in zip(sums, squares))  # trace(V) * n * n
    if not spread:
        return spark.createDataFrame([], f"{id_col} long, {kind}")
    mean = np.array([s / n for s in sums])
    values, vectors = bidiagonal(fit, mean, spread / n, components)
    keep = values > 1e-12 * values[0]
    e, vectors = values[keep] / n, vectors[:, keep]
    to = vectors / np.sqrt(e)
    explained = e / (spread / n**2)
    error = float(np.abs(covariance(fit, mean, to) - np.eye(len(e))).max())
    shared = spark.sparkContext.broadcast((n, np.array(sums, object), mean, to, explained, error))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, to, explained, error = shared.value
        r = to.shape[1]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                m = part.num_rows
                x = part.column("x").flatten().to_numpy().reshape(m, -1)
                y = (x - mean) @ to
                deviation = pa.array(deviations(x, n, sums), pa.int64())
                at = pa.array(np.repeat(np.arange(m), r))
                columns = [part.column("id").take(at), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), m)), pa.array(np.full(m * r, n)), deviation.take(at), pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * r, error))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(projected, f"{id_col} long, {kind}")
