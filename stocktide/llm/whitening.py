"""Embedding whitening with eigenvectors refined in mixed precision.

Method. Entries are put on a whole-number grid, so number and sums of the vectors are exact. The covariance is summed by the tasks
about the rounded mean: whole numbers in doubles, which are exact and do not depend on the order of the tasks until they pass 2**53.
Its eigenvectors are found in float32 and then corrected in extended precision by Ogita and Aishima's iteration, which consists
of matrix products only: with R = I - X'X and S = X'VX, X becomes X + XE, where E_ij = (S_ij + l_j R_ij) / (l_j - l_i) for
eigenvalues that lie apart by more than the error bound and R_ij / 2 for those that do not. For the latter, a cluster, only the
space that it spans is found that way; inside it V less the cluster's mean eigenvalue is projected on that space, where the
eigenvalues lie apart in proportion, solved in double precision and refined by the same iteration (a sub-solve).

Per vector everything is one pass over the table; what comes to the driver is bounded by the square of the vectors' length.

Defined results: a vector that is null or empty, or holds a null or a value that is not finite or not below ``LARGEST`` (whole
numbers beyond it do not fit a long), is dropped, and so is one whose length is not the most frequent one (of equally frequent
ones the longest); an empty table gives an empty result; a component without variance (its eigenvalue is at most ``FLAT`` of the
largest) has a null whitened value and does not count in ``identity_error``; without any variance ``explained`` is null; a
deviation past a long is null; repeated rows, ids and null ids keep a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.text import named_columns
from stocktide.session import stage_table

COMPONENTS, SCALE, SHIFT, LARGEST, FLAT, ROUNDS = 8, 1024, 100_000, 2.0 ** 30, 1e-12, 12


# --- eigenvectors ----------------------------------------------------------------------------------------------------------

def _correction(s: np.ndarray, r: np.ndarray, norm, noise) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, E, which pairs are clustered) of one step, from S = X'AX, R = I - X'X, a norm of A and the least gap above rounding."""
    value = np.diag(s) / (1 - np.diag(r))
    bound = max(2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + norm * np.sqrt((r ** 2).sum())), noise)
    gap = value[None, :] - value[:, None]
    close = np.abs(gap) <= bound
    return value, np.where(close, r / 2, (s + value[None, :] * r) / np.where(close, 1, gap)), close


def _clusters(value: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring eigenvalues that the bound does not tell apart, of two or more."""
    order = np.argsort(-value, kind="stable")
    apart = [not close[a, b] for a, b in zip(order, order[1:], strict=False)]
    return [run for run in np.split(order, np.flatnonzero(apart) + 1) if len(run) > 1]


def _sub_solve(a: np.ndarray, x: np.ndarray, value: np.ndarray, noise) -> np.ndarray:
    """Turn the basis ``x`` of one cluster to its eigenvectors."""
    def shifted():
        s = x.T @ (a @ x - value.mean() * x)
        return (s + s.T) / 2

    one, t = np.eye(x.shape[1], dtype=a.dtype), shifted()
    size = np.abs(t).max()
    if size == 0:
        return x
    x = x @ np.linalg.eigh((t / size).astype(np.float64))[1].astype(a.dtype)
    for _ in range(2):
        t, r = shifted(), one - x.T @ x
        x = x + x @ _correction(t, r, np.sqrt((t ** 2).sum()), noise)[1]
    for _ in range(2):
        x = x + x @ (one - x.T @ x) / 2
    return x


def eigenvectors(v: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns, largest entry positive) of a symmetric matrix."""
    size = np.abs(v).max(initial=0)
    if not size:
        return np.zeros(len(v)), np.eye(len(v))
    a = v.astype(np.longdouble) / np.longdouble(size)
    norm, one = np.sqrt((a ** 2).sum()), np.eye(len(v), dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    noise = 1000 * len(v) * np.finfo(np.longdouble).eps * norm
    last = np.inf
    for _ in range(rounds):
        value, e, close = _correction(x.T @ a @ x, one - x.T @ x, norm, noise)
        x = x + x @ e
        for run in _clusters(value, close):
            x[:, run] = _sub_solve(a, x[:, run], value[run], noise)
        now = float(np.abs(e).max())
        if now < 1e-17 or now >= last and now < 1e-12:
            break
        last = now
    for _ in range(2):  # what the last correction's square left of X'X
        x = x + x @ (one - x.T @ x) / 2
    value = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-value, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(v))])
    return np.maximum(value[order] * np.longdouble(size), 0).astype(np.float64), x.astype(np.float64)


# --- the corpus ------------------------------------------------------------------------------------------------------------

def _sound(e: Column) -> Column:
    """Whether a vector takes part."""
    fits = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.coalesce((F.size(e) > 0) & fits, F.lit(False))


def _grid(vectors: pa.Array, scale: int, shift: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(len(vectors), -1) + shift


@dataclass
class Whitening:
    """The fitted model: ``n`` vectors with exact ``sums``, covariance trace, and the leading eigenvalues and eigenvectors."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    scale: int = SCALE
    shift: int = SHIFT

    def centre(self) -> np.ndarray:
        """The rounded mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def has_variance(self) -> np.ndarray:
        return self.values > FLAT * self.values.max(initial=0)

    def explained(self, k: int) -> float | None:
        return float(self.values[k] / self.trace) if self.trace > 0 else None


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """The rows that take part as (vec_id, embedding), and their vectors' length (0: there are none)."""
    named_columns(vectors, vec_id, embedding)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).filter(_sound(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("length")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    length = top["length"] if top else 0
    return rows.filter(F.size("embedding") == length), length


def _totals(parts: DataFrame, kind: str) -> list:
    """Sums over all tasks of the arrays ``part``, by place."""
    cells = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    return [r["value"] for r in cells.orderBy("at").collect()]


def fit_whitening(rows: DataFrame, length: int, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Two passes over all vectors: exact sums, then the covariance about the rounded mean."""
    if not length:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _grid(batch.column(0), scale, shift)
                total += np.append(x.sum(axis=0), len(x))
        yield pa.RecordBatch.from_pydict({"part": [total.tolist()]})

    only = rows.select("embedding")
    *found, n = (int(v) for v in _totals(only.mapInArrow(sums, "part array<long>"), "decimal(38,0)"))
    model = Whitening(n, found, 0.0, np.zeros(0), np.zeros((length, 0)), scale, shift)
    centre = model.centre()
    upper = np.triu_indices(length)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length))
        for batch in batches:
            if batch.num_rows:
                z = (_grid(batch.column(0), scale, shift) - centre).astype(np.float64)
                total += z.T @ z
        yield pa.RecordBatch.from_pydict({"part": [total[upper].tolist()]})

    square = _totals(only.mapInArrow(products, "part array<double>"), "double")
    off = [s - n * int(c) for s, c in zip(found, centre, strict=True)]
    v = np.zeros((length, length))
    for i, j, p in zip(*upper, square, strict=True):
        v[i, j] = v[j, i] = (n * int(p) - off[i] * off[j]) / n ** 2  # whole numbers up to the one division
    values, vectors = eigenvectors(v)
    model.trace, model.values, model.vectors = float(np.trace(v)), values[:components], vectors[:, :components]
    return model


def _deviations(z: np.ndarray, n: int, off: np.ndarray) -> list[int | None]:
    """Exact sum of (n x - S)^2 per vector, from z = x - centre and off = S - n centre; null past a long."""
    reach = n * (int(np.abs(z).max(initial=0)) + 1)
    if reach * reach * z.shape[1] < 2 ** 63:
        return ((n * z - off) ** 2).sum(axis=1).tolist()
    exact = ((n * z.astype(object) - off.astype(object)) ** 2).sum(axis=1)
    return [v if v < 2 ** 63 else None for v in exact]


def whitened_vectors(rows: DataFrame, model: Whitening) -> DataFrame:
    """Rows (vec_id, deviation, whitened: one value per component, null for a component without variance)."""
    centre, off = model.centre(), np.array([s - model.n * int(c) for s, c in zip(model.sums, model.centre(), strict=True)], np.int64)
    usable = model.has_variance()
    scaled = model.vectors[:, usable] / np.sqrt(model.values[usable])
    shape = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = _grid(part.column(1), model.scale, model.shift) - centre
                out = np.full((len(z), len(usable)), None, object)
                out[:, usable] = (z - off / model.n) @ scaled
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_deviations(z, model.n, off), pa.int64()),
                                                  pa.array(out.tolist(), shape.field(2).type)], schema=shape)

    return rows.select("vec_id", "embedding").mapInArrow(turned, "vec_id long, deviation long, whitened array<double>")


def identity_error(table: DataFrame, usable: list[int]) -> float | None:
    """Largest absolute entry of the whitened values' covariance less the identity; None without a component."""
    if not usable:
        return None
    mean = table.agg(*[F.avg(F.get("whitened", F.lit(k))).alias(f"m{k}") for k in usable]).first()
    value = {k: F.get("whitened", F.lit(k)) - F.lit(mean[f"m{k}"]) for k in usable}
    pairs = [(i, j) for i in usable for j in usable if i <= j]
    found = table.agg(*[F.avg(value[i] * value[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"p{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one per remaining vector and component."""
    rows, length = _usable(vectors, vec_id, embedding)
    model = fit_whitening(rows, length, components)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], shape)
    table = stage_table(whitened_vectors(rows, model), "whitened")
    error = identity_error(table, np.flatnonzero(model.has_variance()).tolist())
    shares = F.array(*[F.lit(model.explained(k)).cast("double") for k in range(len(model.values))])
    long = table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
