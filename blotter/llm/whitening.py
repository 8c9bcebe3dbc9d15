"""Embedding whitening from exact, bit-sliced cross-products.

Each entry ``c`` of a vector becomes the integer ``x = floor(64 * c) + 1000000``.
The fit list holds each distinct x vector once: rows are encoded as bytes of the
least width that holds a vector, so equal vectors are equal bytes, and a distinct
on these (aggregated before the shuffle) makes the list, a written table.

Scatter: a block of rows is shifted by its least value per dimension, and each bit
of each dimension becomes a plane, packed across the rows into 64-bit words. The
sum of products of two dimensions is the sum over their planes of the popcount of
the AND, weighted by the powers of two; the shift is undone by integer algebra.
Blocks add up in Python integers, tasks in 30-bit limbs that Spark sums, so the
sums and cross-products of all rows are exact whatever their number.

Centring is exact too: ``n * Q - S S'`` in integers, divided once by ``n ** 2``,
goes to ``eigh``. The whitened fit list is then read once more and its covariance
measured against the identity.

Driver and workers hold matrices of dimensions squared; rows stay on executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import materialize

SCALE, OFFSET = 64, 1_000_000
BLOCK = 8192  # rows that are packed together
LIMB, LIMBS = 30, 7
_LOW = (1 << LIMB) - 1


def quantised(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, v)`` for each length of vector: the numbers of the rows that hold
    only finite entries, and their ``floor(64 * c)`` as 64-bit integers (entries
    beyond 2 ** 62 stay at that bound)."""
    values = pc.cast(vectors.values, pa.float64())
    c = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    offs = np.asarray(vectors.offsets, dtype=np.int64)
    starts, ends = offs[:-1], offs[1:]
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    good = np.flatnonzero(known & (bad[ends] == bad[starts]))
    sizes = (ends - starts)[good]
    for d in np.unique(sizes).tolist():
        rows = good[sizes == d]
        v = np.floor(SCALE * c[starts[rows, None] + np.arange(d)])
        yield rows, np.clip(v, -2.0 ** 62, 2.0 ** 62).astype(np.int64)


_WIDTHS = (1, 2, 4, 8)


def to_bytes(v: np.ndarray) -> list[bytes]:
    """A byte of the least width (1, 2, 4, 8) that holds a row, then its entries."""
    most = np.where(v < 0, ~v, v).max(axis=1, initial=0)
    width = np.array(_WIDTHS)[np.searchsorted([1 << 7, 1 << 15, 1 << 31], most, side="right")]
    out = np.empty(len(v), dtype=object)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw, size = v[at].astype(f"<i{w}").tobytes(), w * v.shape[1]
        out[at] = [bytes([w]) + raw[i * size:(i + 1) * size] for i in range(len(at))]
    return out.tolist()


def from_bytes(keys: pa.Array) -> Iterator[np.ndarray]:
    """The matrices of x, one for each length and width among the keys."""
    groups: dict[tuple[int, int], list[bytes]] = {}
    for raw in keys.to_pylist():
        groups.setdefault((raw[0], len(raw)), []).append(raw[1:])
    for (w, size), rows in groups.items():
        v = np.frombuffer(b"".join(rows), dtype=f"<i{w}").astype(np.int64)
        yield v.reshape(len(rows), (size - 1) // w) + OFFSET


@F.arrow_udf(T.BinaryType())
def vector_key(vectors: pa.Array) -> pa.Array:
    out: list[bytes | None] = [None] * len(vectors)
    for rows, v in quantised(vectors):
        for i, raw in zip(rows.tolist(), to_bytes(v)):
            out[i] = raw
    return pa.array(out, pa.binary())


def cross_products(x: np.ndarray) -> np.ndarray:
    """``x' x`` of integers from bit planes, exact (Python integers)."""
    m, d = x.shape
    low = x.min(axis=0)
    u = x - low  # entries are within 2 ** 63 of each other
    bits = [int(t).bit_length() for t in u.max(axis=0)]
    planes, weights, owner = [], [], []
    for b in range(max(bits, default=0)):
        dims = [i for i in range(d) if bits[i] > b]
        packed = np.packbits((u[:, dims] >> b).astype(np.uint8) & 1, axis=0)
        words = np.zeros((-(-len(packed) // 8) * 8, len(dims)), dtype=np.uint8)
        words[:len(packed)] = packed
        planes.append(np.ascontiguousarray(words.T).view(np.uint64))
        owner += dims
        weights += [1 << b] * len(dims)
    exact = m * (1 << 2 * max(bits, default=0)) < 1 << 62
    lift = np.zeros((len(owner), d), dtype=np.int64 if exact else object)
    lift[np.arange(len(owner)), owner] = weights
    both = np.zeros((len(owner), len(owner)), dtype=np.int64)
    if planes:
        plane = np.concatenate(planes)
        for p in range(len(plane)):
            both[p, p:] = np.bitwise_count(plane[p] & plane[p:]).sum(axis=1, dtype=np.int64)
        both += np.triu(both, 1).T
    q = (lift.T @ (both if exact else both.astype(object)) @ lift).astype(object)
    shift, sums = low.astype(object), u.astype(object).sum(axis=0) if not exact else u.sum(axis=0).astype(object)
    return q + np.outer(shift, sums) + np.outer(sums, shift) + m * np.outer(shift, shift)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(dim, i, j, limbs)`` of a task: its cross-products for i <= j, its
    sums at j = -1, its number of rows at i = j = -1."""
    total: dict[int, list] = {}
    waiting: dict[int, list[np.ndarray]] = {}

    def add(d: int, x: np.ndarray) -> None:
        for at in range(0, len(x), BLOCK):
            part = x[at:at + BLOCK]
            n, s, q = total.get(d, (0, 0, 0))
            total[d] = [n + len(part), s + part.astype(object).sum(axis=0), q + cross_products(part)]

    for batch in batches:
        for x in from_bytes(batch.column(0)):
            d = x.shape[1]
            waiting.setdefault(d, []).append(x)
            if sum(map(len, waiting[d])) >= BLOCK:
                add(d, np.concatenate(waiting.pop(d)))
    for d, parts in waiting.items():
        add(d, np.concatenate(parts))
    for d, (n, s, q) in total.items():
        rows = [(-1, -1, n), *((i, -1, s[i]) for i in range(d)), *((i, j, q[i, j]) for i in range(d) for j in range(i, d))]
        cols = [pa.array([d] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1))]
        for k in range(LIMBS):  # the last limb has the sign
            cols.append(pa.array([int(r[2]) >> LIMB * k if k == LIMBS - 1 else int(r[2]) >> LIMB * k & _LOW for r in rows], pa.int64()))
        yield pa.RecordBatch.from_arrays(cols, names=["dim", "i", "j", *(f"l{k}" for k in range(LIMBS))])


@dataclass
class Whitener:
    """``n`` fit vectors of one length, their exact sums, the map to ``components``
    (columns, unit eigenvectors over the root of their eigenvalues) and the
    variance that each explains."""

    n: int
    sums: list[int]
    maps: np.ndarray
    explained: np.ndarray

    @classmethod
    def fit(cls, n: int, sums: list[int], cross: np.ndarray, k: int) -> Whitener:
        centred = n * cross - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object))
        cov = np.array([[int(v) / (n * n) for v in row] for row in centred.tolist()])  # one rounding
        e, u = np.linalg.eigh(cov)
        e, u, trace = e[::-1], u[:, ::-1], float(np.trace(cov))
        keep = np.flatnonzero(e > len(e) * np.finfo(float).eps * max(e[0], 0.0))[:k]
        return cls(n, sums, u[:, keep] / np.sqrt(e[keep]), e[keep] / trace if trace else e[keep])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: 64-bit where that holds it, else Python integers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        small = most < 1 << 62
        return x * self.n - np.array(self.sums, dtype=np.int64) if small else x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def deviation(self, y: np.ndarray) -> list[int]:
        """Sum of squares of each row of :meth:`centred`."""
        most = int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1])
        y = y.astype(np.int64 if most < 1 << 62 else object)
        return [int(v) for v in (y * y).sum(axis=1)]

    def whiten(self, y: np.ndarray) -> np.ndarray:
        y, z = (y / self.n).astype(np.float64), np.zeros((len(y), self.maps.shape[1]))
        for d, column in enumerate(self.maps):  # a fixed order: a row's values don't depend on its batch
            z += y[:, d, None] * column
        return z


def fit(fit_list: DataFrame, components: int) -> dict[int, Whitener]:
    """A whitener for each length of vector in a table of distinct keys."""
    limbs = [f"l{k}" for k in range(LIMBS)]
    parts = fit_list.mapInArrow(_scatter, "dim int, i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    rows = parts.groupBy("dim", "i", "j").agg(*(F.sum(c).alias(c) for c in limbs)).collect()  # dimensions squared
    out, by = {}, {}
    for r in rows:
        by.setdefault(r.dim, {})[r.i, r.j] = sum(r[c] << LIMB * k for k, c in enumerate(limbs))
    for d, value in by.items():
        if d:
            cross = np.array([[value[min(i, j), max(i, j)] for j in range(d)] for i in range(d)], dtype=object)
            out[d] = Whitener.fit(value[-1, -1], [value[i, -1] for i in range(d)], cross, components)
    return out


def identity_errors(fit_list: DataFrame, models) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the
    identity, by length of vector (rows are centred exactly before they are mapped)."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in from_bytes(batch.column(0)):
                if x.shape[1] in models.value:
                    m = models.value[x.shape[1]]
                    z = m.whiten(m.centred(x))
                    total[x.shape[1]] = total.get(x.shape[1], 0) + z.T @ z
        rows = [(d, a, b, z[a, b]) for d, z in total.items() for a in range(len(z)) for b in range(a, len(z))]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["dim", "a", "b", "v"]).astype(
            {"dim": "int32", "a": "int32", "b": "int32", "v": "float64"}), preserve_index=False)

    sums = fit_list.mapInArrow(products, "dim int, a int, b int, v double").groupBy("dim", "a", "b").agg(F.sum("v").alias("v"))
    out: dict[int, float] = {}
    for r in sums.collect():  # components squared
        out[r.dim] = max(out.get(r.dim, 0.0), abs(r.v / models.value[r.dim].n - (r.a == r.b)))
    return out


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """``(id, n, deviation, whitened, explained, identity_error)`` per vector.

    ``deviation`` is the exact sum of ``(n * x - S) ** 2`` (a decimal, null beyond 38
    digits); ``whitened`` and ``explained`` are arrays with an entry for each of the
    first ``components`` components.

    Rows whose vector is null or holds a null or a non-finite entry are dropped.
    Repeated vectors count once in the fit and have a row each in the result, null
    ids too. Vectors of different lengths are whitened apart, each length by its own
    fit. Components without variance (fewer distinct vectors than components,
    constant dimensions) are left out, so a lone vector has empty arrays; so has an
    empty vector, with a deviation of 0. Equal eigenvalues may take any order. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    keys = rows.select(vector_key("vector").alias("key")).where("key is not null").distinct()
    fit_list = materialize(keys, "vectors")
    models = spark.sparkContext.broadcast(fit(fit_list, components))
    errors = identity_errors(fit_list, models)
    id_type = rows.schema["id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            for at, v in quantised(vectors):
                m = models.value.get(v.shape[1])
                some = ids.take(pa.array(at))
                if m is None:  # vectors without entries
                    dev, z, shares = [0] * len(at), np.zeros((len(at), 0)), np.zeros(0)
                    n = 0
                else:
                    y = m.centred(v + OFFSET)
                    dev, z, shares, n = m.deviation(y), m.whiten(y), m.explained, m.n
                k = z.shape[1]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(t.ravel(), pa.float64()))
                         for t in (z, np.tile(shares, (len(at), 1)))]
                yield pa.RecordBatch.from_arrays(
                    [some, pa.array([n] * len(at), pa.int64()), pa.array([None if t >= 10 ** 38 else t for t in dev], pa.decimal128(38, 0)), *lists,
                     pa.array([errors.get(v.shape[1], 0.0)] * len(at), pa.float64())],
                    names=["id", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(apply, f"id {id_type}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnRenamed("id", id_col)


def components_of(table: DataFrame, components: int = 16) -> DataFrame:
    """The query's rows: one per vector and component. A deviation beyond a long is null."""
    out = whiten(table, components=components)
    parts = F.arrays_zip("whitened", "explained")
    return out.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error",
                      F.posexplode(parts).alias("at", "part")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"), "identity_error")
