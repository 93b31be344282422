"""Whitened embeddings by matrix-free block Lanczos.

The covariance matrix is never formed.  Each step multiplies it with a block of
vectors by one distributed pass, ``XᵀXv`` over centred rows, summed by Spark; the
driver holds only the block basis, ``dims`` times at most ``dims`` numbers.  New
directions are orthogonalised twice against the whole basis; where a block breaks
down random directions restart it, and iteration ends when the residuals of all
wanted components are down to rounding and a fresh random block finds nothing
more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .neardup import matrix, usable

#: Rows in a block of the stored integer matrix.
ROWS = 4096
#: Beyond it a double has no place for every integer.
EXACT = float(2 ** 53)


def packed(scale: float, shift: int):
    """Rows of vectors -> blocks of integers floor(scale * c) + shift, with sums and bounds per dimension."""
    def block(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        low, high = x.min(axis=0), x.max(axis=0)
        small = max(abs(int(low.min())), abs(int(high.max()))) < 2 ** 31
        row = {"n": (len(x), pa.int64()), "ids": (ids, pa.list_(pa.int64())), "x": (x.astype(np.int32 if small else np.int64).tobytes(), pa.binary()),
               "wide": (not small, pa.bool_()), "sums": (x.sum(axis=0), pa.list_(pa.int64())),
               "low": (low, pa.list_(pa.int64())), "high": (high, pa.list_(pa.int64()))}
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in row.values()], list(row))

    def run(batches):
        ids, parts, n = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                wide = scale * matrix(pa.chunked_array([part["embedding"]]))
                if (np.abs(wide) > EXACT).any():
                    raise ValueError("whitening: an entry is too large for an exact integer")
                parts.append(np.floor(wide).astype(np.int64) + shift)
                ids += part["vec_id"].to_pylist()
                n += part.num_rows
                if n >= ROWS:
                    yield block(ids, parts)
                    ids, parts, n = [], [], 0
        if n:
            yield block(ids, parts)
    return run


class Centred:
    """The stored blocks with what centres them: sums S over n rows, kept as the
    whole part and the rest of S / n, so that x - S / n loses no digits."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.sums = blocks, n, sums
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([(s - n * w) / n for s, w in zip(sums, self.whole.tolist())])

    def rows(self) -> Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray]]:
        """Of a stored block, the integers less the whole part, and the centred rows."""
        whole, rest = self.whole, self.rest

        def read(x: bytes, wide: bool):
            y = np.frombuffer(x, dtype=np.int64 if wide else np.int32).reshape(-1, len(whole)) - whole
            return y, y - rest
        return read

    def summed(self, each: Callable, size: int) -> np.ndarray:
        """Sum over all blocks of ``each(integers, centred)``, a vector of ``size`` numbers:
        summed in each task, then by Spark per position."""
        read = self.rows()

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for x, wide in zip(batch["x"], batch["wide"]):
                    total += each(*read(x.as_py(), wide.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "v"])

        got = self.blocks.select("x", "wide").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(size)
        for row in got:
            out[row["at"]] = row["v"]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance matrix times a block, without the matrix."""
        return self.summed(lambda _, x: (x.T @ (x @ q)).ravel(), q.size).reshape(q.shape) / self.n


def fresh(block: np.ndarray, basis: np.ndarray, draw: Callable[[int], np.ndarray], least: float) -> np.ndarray:
    """Orthonormal directions of ``block`` outside the basis.  Directions shorter than
    ``least`` are a breakdown: random ones take their place, while any are left."""
    room = basis.shape[0] - basis.shape[1]
    width = min(block.shape[1], room)
    outside = lambda b: b - basis @ (basis.T @ b)
    u, s, _ = np.linalg.svd(outside(outside(block)), full_matrices=False)
    new = u[:, :width][:, s[:width] > least]
    while new.shape[1] < width:
        full = np.concatenate([basis, new], axis=1)
        v = draw(width - new.shape[1])
        for _ in range(2):
            v = v - full @ (full.T @ v)
        new = np.concatenate([new, np.linalg.qr(v)[0]], axis=1)
    for _ in range(2):  # full reorthogonalisation
        new = np.linalg.qr(outside(new))[0]
    return new


def lanczos(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = 16, tolerance: float = 1e-14,
            seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors as columns; ``times`` multiplies it with a block of columns.

    Projections on the whole basis are kept, so Ritz values and true residuals need
    no further pass.  When all residuals are within ``tolerance`` of the largest
    eigenvalue, a random block joins the basis: only if that moves nothing, no
    repeated eigenvalue was missed, and iteration ends.  It ends in any case when the
    basis spans the space.
    """
    random = np.random.default_rng(seed)
    draw = lambda k: random.standard_normal((dims, k))
    wanted, basis, image = min(wanted, dims), np.zeros((dims, 0)), np.zeros((dims, 0))
    step, settled = draw(min(block, dims)), None
    while True:
        scale = np.abs(image).max(initial=0.0)
        new = fresh(step, basis, draw, 1e-10 * scale)
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, times(new)], axis=1)
        h = basis.T @ image
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        full, largest = basis.shape[1] >= dims, max(abs(values[0]), 1e-300)
        residual = np.linalg.norm(image @ vectors - (basis @ vectors) * values, axis=0)
        done = basis.shape[1] >= wanted and (residual <= tolerance * dims * largest).all()
        if full or done and settled is not None and np.abs(settled - values).max() <= 10 * tolerance * dims * largest:
            return values, basis @ vectors
        settled = values if done else None
        step = draw(new.shape[1]) if done else image[:, -new.shape[1]:]


def whiten(vectors: DataFrame, components: int = 32, block: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """``vectors(vec_id long, embedding)`` -> ``vec_id, component, n, deviation, whitened,
    explained, identity_error``: a row per vector and component, up to ``components``.

    An entry c counts as the integer x = floor(scale * c) + shift.  The fit list is
    all vectors that take part, repeated ones included: n of them, with sums S.
    Components are the unit eigenvectors of their covariance (divisor n), numbered
    from 1 by falling eigenvalue e.  ``deviation`` is the sum over dimensions of
    (n x - S)^2, exact, null where that does not fit a long; ``whitened`` is x - S / n
    on the component, over sqrt(e); ``explained`` is e over the trace, which the
    deviations give; ``identity_error`` is the largest absolute entry of whitened's
    covariance, taken in passes of its own, minus the identity.

    Vectors that are null, empty, or hold null or non-finite entries take no part.
    Vectors of another length than the most frequent one (the longer at a tie) take
    no part either.  Directions without variance, with eigenvalues not above 1e-11 of
    the largest, cannot be whitened and have no rows; so one vector, or equal ones,
    give none.  Empty tables give no rows.  Null and repeated ids keep their rows.
    Entries beyond 2**53 / scale, or sums beyond a long, raise ValueError.
    Extra columns are ignored.
    """
    used = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("embedding").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") > 0))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    common = used.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    dims = common[0]["dims"]
    blocks = materialize(used.where(F.size("embedding") == dims).mapInArrow(
        packed(scale, shift), "n long, ids array<long>, x binary, wide boolean, sums array<long>, low array<long>, high array<long>"))
    n = blocks.agg(F.sum("n")).first()[0]
    each = blocks.select(F.posexplode(F.arrays_zip("sums", "low", "high")).alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("v.sums").cast("decimal(38,0)")).alias("s"), F.min("v.low").alias("low"), F.max("v.high").alias("high")).orderBy("at").collect()
    sums = [int(r["s"]) for r in each]
    if max(max(abs(r["low"]), abs(r["high"])) * n for r in each) >= 2 ** 62:
        raise ValueError("whitening: sums of so many entries of this size do not fit a long")
    data = Centred(blocks, n, sums)
    values, axes = lanczos(data.times, dims, components, block)
    there = values > 1e-11 * max(values[0], 0.0)
    values, axes = values[there], axes[:, there]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    onto = axes / np.sqrt(values)
    left = np.array([s - n * w for s, w in zip(sums, data.whole.tolist())], dtype=np.int64)
    # trace(V) = sum of deviations / n^3, from the centred integers; the mean of whitened, to centre it
    found = data.summed(lambda y, x: np.concatenate([[np.square((n * y - left).astype(np.float64)).sum()], (x @ onto).sum(axis=0)]), 1 + k)
    trace, mean = found[0] / float(n) ** 3, found[1:] / n

    def products(_, x):
        w = x @ onto - mean
        return (w.T @ w).ravel()

    error = float(np.abs(data.summed(products, k * k).reshape(k, k) / n - np.eye(k)).max())
    shares, read = values / trace, data.rows()

    def project(batches):
        for batch in batches:
            for ids, raw, wide in zip(batch["ids"], batch["x"], batch["wide"]):
                y, x = read(raw.as_py(), wide.as_py())
                far = n * y - left
                size = np.square(far.astype(np.float64)).sum(axis=1)
                deviation = pa.array((far * far).sum(axis=1), mask=size >= 2.0 ** 63)
                who, m = np.repeat(np.arange(len(y)), k), len(y) * k
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(pa.array(who)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(m, n)),
                    deviation.take(pa.array(who)), pa.array((x @ onto).ravel()), pa.array(np.tile(shares, len(y))), pa.array(np.full(m, error))],
                    [f.split(" ")[0] for f in schema.split(", ")])

    return blocks.select("ids", "x", "wide").mapInArrow(project, schema)
