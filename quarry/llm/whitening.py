"""Whitening of embeddings by an exact mean and a two-pass covariance.

Entries become integers (``quantised``), so the first pass' sums are exact whatever order tasks end in. The second centres
each batch by them and sums its outer products by one matrix product; tasks' sums meet in ``treeAggregate``, never more
than a square of the dimension at a time. The driver decomposes that square and sends the projection back; a third pass
measures the covariance of what it makes.

Cases: a null vector, and one with null or non-finite entries, is dropped; so is one with an entry of ``MOST`` or
more, which no long can hold, and a vector of another length than most (of lengths equally common, the shorter), as it lies
in another space; repeated rows and null ids are rows like others; ties of eigenvalues stand in any order; a component
without variance can't be scaled, so its ``whitened`` is null; a deviation beyond the range of a long is null; an empty table gives no rows. Other
columns, whatever their names, are ignored. Vectors of any length up to some thousands are meant: a task holds its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE, SHIFT = 64.0, 1_000_000
MOST_COMPONENTS = 32
#: Entries from here on are no longs once they are scaled.
MOST = 2.0**55
#: Rows that a task multiplies at once.
ROWS = 4096
#: An eigenvalue under this share of the largest is rounding, not variance.
NOTHING = 1e-12


def finite(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that have a vector of the common length and finite entries alone."""
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < MOST)))
    common = kept.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return kept.where(F.size("embedding") == (common.d if common else 0))


def quantised(column: pa.ListArray, dim: int) -> np.ndarray:
    """The entries as longs, a row for each vector."""
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False))
    return scaled.astype(np.int64).reshape(-1, dim) + SHIFT


def _summed(vectors: DataFrame, dim: int, partial, width: int, dtype) -> tuple[int, np.ndarray]:
    """Number of vectors, and the sum of ``partial`` over blocks of them; tasks' sums are merged as a tree."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                x = quantised(batch.column(0).slice(i, ROWS), dim)
                n, total = n + len(x), total + partial(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    parts = vectors.select("embedding").mapInArrow(each, "n long, total binary").rdd
    add = lambda a, r: (a[0] + r[0], a[1] + np.frombuffer(bytes(r[1]), dtype))
    merge = lambda a, b: (a[0] + b[0], a[1] + b[1])
    return parts.treeAggregate((0, np.zeros(width, dtype)), add, merge, depth=3)


def _wide(x: np.ndarray) -> np.ndarray:
    """Sums of columns, as a high and a low half each, so that neither overflows."""
    return np.concatenate(((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the mean's whole part is taken away in integers, so nothing of the large shift is left to round."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def fit(vectors: DataFrame, components: int = MOST_COMPONENTS) -> dict:
    """``n``, ``dim``, integer ``sums``, ``eigenvalues`` (falling), unit eigenvectors as columns, ``explained`` and
    ``projection`` (columns scaled to variance 1; zero where there is none) of ``finite`` vectors."""
    first = vectors.select(F.size("embedding").alias("d")).first()
    if not first:
        return {"n": 0, "dim": 0}
    dim = first.d
    n, halves = _summed(vectors, dim, _wide, 2 * dim, np.int64)
    sums = [int(h) * (1 << 32) + int(low) for h, low in zip(halves[:dim], halves[dim:], strict=True)]

    def outer(x: np.ndarray) -> np.ndarray:
        c = _centred(x, n, sums)
        return (c.T @ c).ravel()

    covariance = _summed(vectors, dim, outer, dim * dim, np.float64)[1].reshape(dim, dim) / n
    values, eigenvectors = np.linalg.eigh((covariance + covariance.T) / 2) if dim else (np.empty(0), np.empty((0, 0)))
    values, eigenvectors = values[::-1][:components], eigenvectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    varies = values > NOTHING * max(trace, 0.0)
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    return {"n": n, "dim": dim, "sums": sums, "eigenvalues": values, "varies": varies, "explained": np.where(varies, values, 0.0) / trace if trace > 0 else np.zeros(len(values)), "projection": eigenvectors * scale}


def identity_error(vectors: DataFrame, model: dict) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over components with variance."""
    n, dim, sums, projection = model["n"], model["dim"], model["sums"], np.ascontiguousarray(model["projection"][:, model["varies"]])
    k = projection.shape[1]
    if not n or not k:
        return 0.0

    def outer(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ projection
        return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0)))

    total = _summed(vectors, dim, outer, k * k + k, np.float64)[1] / n
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row the sum over dimensions of (n*x - S)^2, exactly; null beyond a long."""
    most = max((abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        off = x * n - np.array(sums, np.int64)
        if float((off.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) < 2.0**62:
            return (off * off).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(vectors: DataFrame, model: dict) -> DataFrame:
    """(vec_id, component, deviation, whitened, explained): each vector on each component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            k = len(m["eigenvalues"]) if m["n"] else 0
            step = max(1, ROWS // max(1, k))
            for i in range(0, batch.num_rows if k else 0, step):
                x = quantised(batch.column(1).slice(i, step), m["dim"])
                w = _centred(x, m["n"], m["sums"]) @ m["projection"]
                at = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, step).take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(deviations(x, m["n"], m["sums"]), pa.int64()).take(pa.array(at)),
                        pa.array(w.ravel(), mask=np.tile(~m["varies"], len(x))),
                        pa.array(np.tile(m["explained"], len(x))),
                    ],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    return vectors.select("vec_id", "embedding").mapInArrow(each, f"vec_id {kind}, component int, deviation long, whitened double, explained double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = finite(table(spark, sf_dir, "embeddings"))
    model = fit(vectors)
    error = identity_error(vectors, model) if model["n"] else 0.0
    return whiten(vectors, model).select("vec_id", "component", F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
