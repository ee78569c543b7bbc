"""Whitening of embeddings from bit-sliced, exact cross-products.

Every entry becomes an integer. Per dimension the least value is subtracted, and bit
``b`` of that shifted dimension, taken over 64 rows, is one machine word: a *plane*. The
number of set bits in the AND of two planes counts the rows that have both bits, so the
cross-product of dimensions ``i`` and ``j`` is the sum of ``2**(a + b) * popcount(plane
(i, a) & plane (j, b))``. A last dimension, whose single plane is all ones, gives sums and
row count in the same pass. Counts are added per *limb* (weights ``2**0 .. 2**23`` in the
first, and so on), which keeps every partial sum inside 64 bits; the driver puts the limbs
together as unbounded integers, centres them (``n * C - S S'``) and only then turns to
floating point for the eigenvectors.

Work is spread by Spark: ranges per task, distinct vectors by a shuffle of packed codes
with equal ones merged before it, one small triangle of sums per task, and a pass over all
rows for the result. Only matrices of dimension squared reach the driver.

Defined cases: a row is dropped if its vector is null or empty, holds a null or non-finite
entry or one of 2**62 or more after scaling, or has another length than most vectors (the
larger on a tie). Null and repeated ids are kept, a row each. No rows left: empty result.
A component whose eigenvalue is not above rounding (as with one distinct vector) has null
``whitened`` and takes no part in ``identity_error``; all vectors equal: null ``explained``.
A ``deviation`` beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.llm import words as w
from roomledger.session import checkpoint_dir

SCALE = 256
LARGEST = 2.0**62
BLOCK = 1 << 14  # rows whose planes are held at a time
LIMB = 24


class Ranges(NamedTuple):
    """Least and greatest integer of every dimension."""

    low: np.ndarray
    high: np.ndarray

    @property
    def bits(self) -> np.ndarray:
        return np.array([max(1, int(h - l).bit_length()) for l, h in zip(self.low, self.high, strict=True)])

    @property
    def code(self) -> np.dtype:
        most = int(self.bits.max())
        return np.dtype(next(f"<u{k}" for k in (1, 2, 4, 8) if most <= 8 * k))


def integers(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Valid rows of a list column, their lengths, and all their entries in a row as integers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.cast(vectors.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(flat * scale)
        good = np.abs(scaled) < LARGEST  # false for nan and infinities
    at = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.flatnonzero((w.per_row(~good, at) == 0) & (sizes > 0))
    keep = np.zeros(len(sizes), dtype=bool)
    keep[rows] = True
    return rows, sizes[rows], scaled[np.repeat(keep, sizes)].astype(np.int64)


def _of_length(vectors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    rows, sizes, flat = integers(vectors, scale)
    fits = sizes == dim
    return rows[fits], flat[np.repeat(fits, sizes)].reshape(-1, dim)


def ranges(df: DataFrame, scale: int = SCALE) -> Ranges | None:
    """Ranges over all rows of the usual length, or None without a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            _, sizes, flat = integers(batch.column(0), scale)
            for dim in np.unique(sizes).tolist():
                x = flat[np.repeat(sizes == dim, sizes)].reshape(-1, dim)
                n, low, high = seen.get(dim, (0, x[0], x[0]))
                seen[dim] = [n + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))]
        for dim, (n, low, high) in seen.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "n": n, "low": low.tolist(), "high": high.tolist()}], out)

    out = pa.schema([("dim", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
    found = df.select("vector").mapInArrow(run, "dim long, n long, low array<long>, high array<long>").checkpoint()
    usual = found.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if usual is None:
        return None
    ends = (
        found.filter(F.col("dim") == usual["dim"])
        .select(F.posexplode(F.arrays_zip("low", "high")).alias("d", "x"))
        .groupBy("d")
        .agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        .orderBy("d")
        .collect()
    )
    return Ranges(*(np.array([r[k] for r in ends], dtype=np.int64) for k in ("low", "high")))


def distinct_codes(df: DataFrame, span: Ranges, scale: int = SCALE) -> DataFrame:
    """Each distinct vector once, as the bytes of its shifted integers."""
    dim, low, kind = len(span.low), span.low, span.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _of_length(batch.column(0), dim, scale)
            data = np.ascontiguousarray((x - low).astype(kind))
            width = dim * kind.itemsize
            at = np.arange(len(x) + 1, dtype=np.int64) * width
            codes = pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([codes.cast(pa.binary())], names=["code"])

    return df.select("vector").mapInArrow(run, "code binary").distinct()


def _decoded(codes: pa.Array, dim: int, kind: np.dtype) -> np.ndarray:
    raw, _ = w.buffers(codes)
    return np.frombuffer(np.ascontiguousarray(raw).tobytes(), dtype=kind).reshape(-1, dim)


def planes(u: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of all dimensions, then the plane of ones, as 64-bit words over the rows."""
    n, words = len(u), -(-len(u) // 64)
    out = np.zeros((int(bits.sum()) + 1, words * 8), dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum(bits)])
    columns = np.ascontiguousarray(u.T)
    for b in range(int(bits.max())):
        some = np.flatnonzero(bits > b)
        packed = np.packbits(((columns[some] >> u.dtype.type(b)) & u.dtype.type(1)).astype(np.uint8), axis=1)
        out[first[some] + b, : packed.shape[1]] = packed
    ones = np.packbits(np.ones(n, dtype=np.uint8))
    out[-1, : len(ones)] = ones
    return out.view(np.uint64)


def add_products(u: np.ndarray, bits: np.ndarray, into: np.ndarray) -> None:
    """Adds the cross-products of a block of rows to ``into[limb, i, j]``, ``i <= j``."""
    plane, every = planes(u, bits), np.append(bits, 1)
    first = np.concatenate([[0], np.cumsum(every)])
    weight = np.concatenate([np.arange(k) for k in every])
    for i, own in enumerate(every.tolist()):
        rest, at = plane[first[i] :], first[i:-1] - first[i]
        for a in range(own):
            count = np.bitwise_count(rest & rest[a]).sum(axis=1, dtype=np.int64)
            power = weight[first[i] :] + a
            for limb in range(int(power.max()) // LIMB + 1):
                here = np.where(power // LIMB == limb, count << (power % LIMB), 0)
                into[limb, i, i:] += np.add.reduceat(here, at)


def cross_products(codes: DataFrame, span: Ranges) -> tuple[int, list[int], list[list[int]]]:
    """Row count, sums and the upper triangle of cross-products of the shifted vectors, exact."""
    dim, bits, kind = len(span.low), span.bits, span.code
    limbs = 2 * (int(bits.max()) - 1) // LIMB + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((limbs, dim + 1, dim + 1), dtype=np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_decoded(batch.column(0), dim, kind))
            if sum(map(len, held)) >= BLOCK:
                u = np.concatenate(held)
                for lo in range(0, len(u), BLOCK):
                    add_products(u[lo : lo + BLOCK], bits, total)
                held = []
        if held and sum(map(len, held)):
            add_products(np.concatenate(held), bits, total)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x.astype(np.int32)) for x in at), pa.array(total[at])], names=["limb", "i", "j", "value"]
        )

    summed = codes.mapInArrow(run, "limb int, i int, j int, value long").groupBy("limb", "i", "j").agg(F.sum("value").alias("value"))
    cross = [[0] * (dim + 1) for _ in range(dim + 1)]
    for limb, i, j, value in summed.collect():
        cross[i][j] += value << (LIMB * limb)
    return cross[dim][dim], [cross[i][dim] for i in range(dim)], [row[:dim] for row in cross[:dim]]


class Model(NamedTuple):
    """``sums`` are those of the shifted vectors; columns of ``axes`` are unit eigenvectors."""

    span: Ranges
    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        return self.values > len(self.sums) * np.finfo(float).eps * max(float(self.values[0]), 0.0)


def fit(codes: DataFrame, span: Ranges, components: int = 4) -> Model:
    """Eigenvectors of the covariance of the distinct vectors, by falling eigenvalue."""
    n, sums, cross = cross_products(codes, span)
    dim = len(sums)
    cov = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            # Centred as integers; the one rounding is in the quotient.
            cov[i, j] = cov[j, i] = (n * cross[i][j] - sums[i] * sums[j]) / (n * n)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    most = np.abs(axes).argmax(axis=0)
    axes = axes * np.sign(axes[most, np.arange(axes.shape[1])])
    return Model(span, n, np.array(sums, dtype=object), values, axes, float(np.trace(cov)))


def _small(model: Model) -> bool:
    """Whether ``n * u`` of every shifted entry fits 63 bits."""
    return max(1, model.n) * (int((model.span.high - model.span.low).max()) + 1) < 2**62


def _centred(u: np.ndarray, model: Model) -> np.ndarray:
    """``n * u - sum(u)``, exact: 64-bit integers where they fit, else Python's."""
    if _small(model):
        return u.astype(np.int64) * model.n - model.sums.astype(np.int64)
    return u.astype(object) * model.n - model.sums


def whitened(u: np.ndarray, model: Model) -> np.ndarray:
    usable = model.usable
    spread = np.sqrt(np.where(usable, model.values, 1.0))
    out = (_centred(u, model).astype(float) / model.n) @ model.axes / spread
    out[:, ~usable] = np.nan
    return out


def deviations(u: np.ndarray, model: Model) -> list[int | None]:
    """Sums of squares of ``n * x - S``; None beyond 64 bits."""
    centred = _centred(u, model)
    rough = (centred.astype(float) ** 2).sum(axis=1)
    if _small(model) and rough.max(initial=0.0) < 2.0**62:
        return (centred * centred).sum(axis=1).tolist()
    out: list[int | None] = [None] * len(u)
    for k in np.flatnonzero(rough < 2.0**63 * 1.001).tolist():
        exact = sum(int(c) ** 2 for c in centred[k])
        out[k] = exact if exact < 2**63 else None
    return out


def identity_error(codes: DataFrame, model: Model) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, over the fit list."""
    usable = np.flatnonzero(model.usable)
    if not len(usable):
        return None
    dim, kind, k = len(model.sums), model.span.code, len(usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            z = whitened(_decoded(batch.column(0), dim, kind), model)[:, usable]
            z = np.column_stack([z, np.ones(len(z))])
            total += z.T @ z
        i, j = np.nonzero(np.ones_like(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "value"]
        )

    total = np.zeros((k + 1, k + 1))
    for i, j, value in codes.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        total[i, j] = value
    # The vectors are centred already; what rounding leaves of their mean goes here.
    mean = total[:k, k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """One row per valid vector and component, see the module's text.

    Columns: the key, ``component`` (from 1), ``n`` (distinct vectors), ``deviation``,
    ``whitened``, ``explained`` (share of the variance), ``identity_error``.
    """
    checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    kind = rows.schema["id"].dataType
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    types = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(a, b) for a, b in zip(names, types, strict=True))])
    span = ranges(rows, scale)
    if span is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
    codes = distinct_codes(rows, span, scale).checkpoint()
    model = fit(codes, span, components)
    error = identity_error(codes, model)
    dim, k = len(span.low), len(model.values)
    explained = [None] * k if model.trace <= 0 else (np.maximum(model.values, 0.0) / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _of_length(batch.column(1), dim, scale)
            u = x - span.low
            z = whitened(u, model).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(z), model.n, dtype=np.int64)),
                    pa.array(deviations(u, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(z, mask=np.isnan(z)),
                    pa.array(explained * len(at), pa.float64()),
                    pa.array([error] * len(z), pa.float64()),
                ],
                names=["id", *names],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)
