"""Embedding whitening: exact fixed-point sums over distinct vectors, pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

# A component c counts as the integer floor(SCALE * c) + SHIFT, held within SHIFT +- LARGEST.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 52
_WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


@dataclass
class Whitening:
    """n distinct vectors with sums of their integers less SHIFT; components (columns) by falling eigenvalue of the covariance; its trace;
    the largest absolute entry of the whitened vectors' covariance less the identity."""

    dim: int
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the integer part of the mean is taken off exactly first."""
        whole = [s // self.n for s in self.sums]
        rest = [(s - w * self.n) / self.n for s, w in zip(self.sums, whole)]
        return (x - np.array(whole, np.int64)).astype(float) - np.array(rest)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums) squared, exactly; null beyond a long."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * self.dim < 1 << 63:
            return (((x * self.n) - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def integers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, integers less SHIFT) of an Arrow column of vectors. Vectors that are null, empty or hold a null, NaN or infinity
    are left out."""
    lists = column.cast(pa.large_list(pa.float64()))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        c = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null becomes NaN
        good = np.isfinite(c).all(1)
        with np.errstate(over="ignore"):
            yield int(dim), at[good], np.clip(np.floor(SCALE * c[good]), -LARGEST, LARGEST).astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Equal vectors, and only they, have equal bytes: the narrowest integers that hold a vector, led by their width."""
    most = np.maximum(x.max(1), ~x.min(1)) if len(x) else np.zeros(0, np.int64)
    width = (most >= 1 << 15).astype(int) + (most >= 1 << 31)
    out: list = [b""] * len(x)
    for k, t in enumerate(_WIDTHS):
        for i in np.flatnonzero(width == k):
            out[i] = bytes([t.itemsize]) + x[i].astype(t).tobytes()
    return out


def _unpacked(keys: list[bytes], dim: int) -> np.ndarray:
    x = np.zeros((len(keys), dim), np.int64)
    for t in _WIDTHS:
        at = [i for i, k in enumerate(keys) if k[0] == t.itemsize]
        if at:
            x[at] = np.frombuffer(b"".join(keys[i][1:] for i in at), t).reshape(-1, dim)
    return x


def _distinct(vectors: DataFrame, column: str) -> DataFrame:
    """dim, key, n (rows) of every distinct vector. Repeats meet map-side first, so a vector that many rows share is no hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, _, x in integers(b.column("v")):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim), pa.int32()), pa.array(_packed(x), pa.binary())], ["dim", "key"])

    keys = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "dim int, key binary")
    return keys.groupBy("dim", "key").agg(F.count("*").alias("n"))


def _cells(keys: DataFrame, dim: int, seen) -> np.ndarray:
    """Sum of seen(x).T @ seen(x) over the vectors: one matrix a task, summed cell by cell; as many rows as cells come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for b in batches:
            d = seen(_unpacked(b.column("key").to_pylist(), dim))
            total = total + d.T @ d
        if isinstance(total, np.ndarray):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    got = keys.select("key").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = max((r["j"] for r in got), default=-1) + 1
    out = np.zeros((k, k))
    for r in got:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L @ L.T, one column per pivot, largest remaining diagonal first: triangular in the order of the pivots. It ends where
    what remains is rounding."""
    d = len(a)
    left = a.diagonal().copy()
    least = 1e-14 * d * left.max(initial=0.0)
    out, open_rows = np.zeros((d, d)), np.ones(d, bool)
    for k in range(d):
        p = int(np.where(open_rows, left, -1.0).argmax())
        if not open_rows[p] or left[p] <= least:
            return out[:, :k]
        column = (a[:, p] - out[:, :k] @ out[p, :k]) / np.sqrt(left[p])
        column[~open_rows] = 0.0
        column[p] = np.sqrt(left[p])
        open_rows[p] = False
        out[:, k] = column
        left -= column ** 2
    return out


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of factor @ factor.T: pairs of columns are rotated until all are orthogonal. A sweep is a
    round robin, so the pairs of a round are disjoint and turn together."""
    a = factor.copy()
    r = a.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            i, j = seats[:len(seats) // 2], seats[len(seats) // 2:][::-1]
            real = (i < r) & (j < r)
            i, j = i[real], j[real]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            go = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if go.any():
                turned = True
                zeta = (yy[go] - xx[go]) / (2 * xy[go])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a[:, i[go]], a[:, j[go]] = c * x[:, go] - s * y[:, go], s * x[:, go] + c * y[:, go]
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
        if not turned:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, a[:, order] / norms[order]


def fit(vectors: DataFrame, column: str, most: int = 16) -> Whitening | None:
    """The whitening of the distinct integer vectors (see SCALE), at most `most` components.

    Vectors that are null, empty, or hold a null or non-finite entry take no part; of several dimensions the commonest among all rows counts
    (ties: the larger). Copies of a vector count once. Without vectors there is no model (None); directions without variance are no
    components. The driver holds matrices of dimension x dimension, whatever the number of rows.
    """
    distinct = base.stored(_distinct(vectors, column), "distinct")
    sizes = distinct.groupBy("dim").agg(F.sum("n").alias("rows"), F.count("*").alias("n")).collect()
    if not sizes:
        return None
    top = max(sizes, key=lambda r: (r["rows"], r["dim"]))
    dim, n = top["dim"], top["n"]
    keys = distinct.where(F.col("dim") == dim)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x = _unpacked(b.column("key").to_pylist(), dim)
            high += (x >> 26).sum(0)
            low += (x & (1 << 26) - 1).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(high), pa.array(low)], ["j", "high", "low"])

    # Two halves of each integer, so that no sum leaves the range of a long.
    parts = keys.select("key").mapInArrow(add, "j int, high long, low long").groupBy("j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = {r["j"]: (r["high"] << 26) + r["low"] for r in parts.collect()}
    model = Whitening(dim, n, [sums[j] for j in range(dim)], np.zeros((dim, 0)), np.zeros(0), 0.0)
    scatter = _cells(keys, dim, model.centred)
    values, vectors_of = one_sided_jacobi(pivoted_cholesky(scatter))
    model.values, model.components = values[:most] / n, vectors_of[:, :most]
    model.trace = float(scatter.trace()) / n
    if len(model.values):
        model.identity_error = float(np.abs(_cells(keys, dim, model.project) / n - np.eye(len(model.values))).max())
    return model


def whiten(vectors: DataFrame, column: str, model: Whitening | None) -> DataFrame:
    """The rows that take part (see fit), in all their columns, with `deviation` (exact; null beyond a long) and `whitened`, the vector's
    projections on the components in units of their deviations. Repeated rows stay; an empty table, or no model, gives no rows; input columns
    named like an output are replaced. No shuffle."""
    kept = [F.col(f"`{c}`") for c in vectors.columns if c not in ("deviation", "whitened")]
    if model is None:
        return vectors.where("false").select(*kept, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            deviation: list = [None] * len(column)
            place = np.full(len(column), -1)
            values = np.zeros((0, len(model.values)))
            for dim, rows, x in integers(column):
                if dim == model.dim:
                    place[rows], values = np.arange(len(rows)), model.project(x)
                    for i, d in zip(rows, model.deviation(x)):
                        deviation[i] = d
            flat = values[place[place >= 0]].ravel()
            ends = np.cumsum(np.r_[0, (place >= 0) * values.shape[1]]).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(place >= 0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                             ["used", "deviation", "whitened"])

    # Marked so that the filter below does not work it out a second time.
    worth = F.arrow_udf(run, "struct<used: boolean, deviation: bigint, whitened: array<double>>").asNondeterministic()
    out = vectors.withColumn("_whitened", worth(F.col(f"`{column}`").cast("array<double>"))).where("_whitened.used")
    return out.select(*kept, "_whitened.deviation", "_whitened.whitened")
