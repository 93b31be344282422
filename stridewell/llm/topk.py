"""Exact top-k inner products over a bit-sliced index.

Rows are hashed into blocks of a bounded size.  In a block each attribute is a
stack of bitmaps, one per bit.  A query adds the slices, weighted by the bits of
its own components, with carry-save bitmap arithmetic; the sum is again
bit-sliced, and the best rows are selected from its most significant slice
downward.  Rows at the boundary are scored exactly.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .neardup import matrix, usable

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class SlicedIndex:
    """Bitmaps of a block of integer rows.  ``bits`` slices are kept per
    attribute; lower bits are left to the exact step."""

    def __init__(self, rows: np.ndarray, bits: int):
        n, dims = rows.shape
        self.rows, self.low = rows, rows.min(axis=0)
        y = (rows - self.low).astype(np.uint64)
        width = max(1, int(y.max()).bit_length())
        self.shift = max(0, width - bits)
        y >>= np.uint64(self.shift)
        self.width, words = width - self.shift, -(-n // 64)
        bitmap = np.zeros((dims, self.width, words * 64), dtype=bool)
        for b in range(self.width):
            bitmap[:, b, :n] = ((y >> np.uint64(b)) & np.uint64(1)).T
        self.slices = np.packbits(bitmap, axis=2, bitorder="little").view(np.uint64)
        self.valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|q| * y), with y complemented where q is negative:
        the inner product up to a constant, lowest slice first."""
        size = np.abs(query).astype(np.uint64)
        signed = self.slices ^ np.where(query < 0, FULL, np.uint64(0))[:, None, None]
        levels: list[list[np.ndarray]] = []

        def put(level: int, bitmaps: np.ndarray) -> None:
            while len(levels) <= level:
                levels.append([])
            levels[level].append(bitmaps)

        for k in range(int(size.max()).bit_length()):
            dims = np.flatnonzero((size >> np.uint64(k)) & np.uint64(1))
            for b in range(self.width if len(dims) else 0):
                put(k + b, signed[dims, b])
        out, level = [], 0
        while level < len(levels):
            x = np.concatenate(levels[level]) if levels[level] else np.zeros((1, len(self.valid)), np.uint64)
            while len(x) > 1:
                g = max(1, len(x) // 3)
                a, b = x[:g], x[g:2 * g]
                half, carry = a ^ b, a & b
                if len(x) > 2:
                    c = x[2 * g:3 * g]
                    carry = carry | (c & half)
                    half = half ^ c
                put(level + 1, carry)
                x = np.concatenate([half, x[3 * g:]]) if len(x) > 3 * g else half
            out.append(x[0])
            level += 1
        return out

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Row numbers that hold the k best, and all that may tie or pass them."""
        sums, none = self.sums(query), np.zeros_like(self.valid)
        sure, even, bound, n = none, self.valid, 0, 0
        for level in reversed(range(len(sums))):
            upper = even & sums[level]
            more = int(np.bitwise_count(upper).sum())
            bound <<= 1
            if n + more >= k:  # the k-th row has this bit
                even, bound = upper, bound | 1
            else:
                sure, even, n = sure | upper, even & ~sums[level], n + more
        spread = int(np.abs(query).sum()) * ((1 << self.shift) - 1) >> self.shift
        if self.shift:  # dropped bits may lift a row by so much: take all from bound - spread on
            bound -= spread + 1
            if bound <= 0:
                sure, even = self.valid, none
            else:
                sure, even = none, self.valid
                for level in reversed(range(len(sums))):
                    if bound >> level & 1:
                        even = even & sums[level]
                    else:
                        sure, even = sure | (even & sums[level]), even & ~sums[level]
        return np.flatnonzero(np.unpackbits((sure | even).view(np.uint8), bitorder="little"))

    def best(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.candidates(query, k + int((ids == own).sum()))
        at = at[ids[at] != own]
        score = self.rows[at] @ query
        order = np.lexsort((ids[at], -score))[:k]
        return ids[at][order], score[order]


def build_block(bits: int, scale: float):
    """The index of a block of rows, as one value."""
    def run(group):
        ints = np.floor(scale * matrix(group["embedding"])).astype(np.int64)
        index = SlicedIndex(ints, bits)
        for kind in (np.int16, np.int32):  # the smallest integers that hold the rows
            if np.abs(ints).max(initial=0) <= np.iinfo(kind).max:
                index.rows = ints.astype(kind)
                break
        return pa.table({"block": group["block"][:1], "dim": group["dim"][:1],
                         "data": pa.array([pickle.dumps((index, group["vec_id"].to_numpy()))], pa.binary())})
    return run


def search_block(k: int, scale: float):
    """The best rows of a block for some queries; the block's index is one of the rows."""
    def run(group):
        out = {"query_id": [], "vec_id": [], "score": []}
        here = group["data"].is_valid()
        blocks, asked = group.filter(here), group.filter(pc.invert(here))
        if blocks.num_rows and asked.num_rows:
            index, kept = pickle.loads(blocks["data"][0].as_py())
            index.rows = index.rows.astype(np.int64)
            queries = np.floor(scale * matrix(asked["embedding"])).astype(np.int64)
            for own, query in zip(asked["vec_id"].to_numpy(), queries):
                who, score = index.best(query, kept, own, k)
                out["query_id"].append(np.full(len(who), own))
                out["vec_id"].append(who)
                out["score"].append(score)
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *v]) for c, v in out.items()})
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, bits: int = 12,
          block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of ``vectors`` for
    each row of ``queries`` (both vec_id long, embedding array) by integer inner
    product of floor(scale * component), ties to the smaller vec_id.

    A query meets no row of its own id, and only rows of as many components.
    Vectors that are null, empty, without id, or hold null or non-finite
    components take no part, as query or candidate; zero vectors do.  Repeated
    rows are candidates each; a repeated query id is answered once.  Scores and
    components times ``scale`` must fit a long.  Empty tables: no rows.  Extra
    columns are ignored.  A block's index is built once and sent to every query
    block; each such pair is a group of bounded size and returns k rows a query.
    """
    def parts(df):
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") > 0)).select(
            "vec_id", "embedding", F.size("embedding").alias("dim"))

    rows, asked = parts(vectors), parts(queries).dropDuplicates(["vec_id"])
    blocks = max(1, -(-rows.count() // block_rows))
    chunks = max(1, -(-asked.count() // query_rows))

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    index = materialize(rows.withColumn("block", block).groupBy("block", "dim").applyInArrow(build_block(bits, scale), "block int, dim int, data binary"))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    none = lambda kind: F.lit(None).cast(kind)
    kind = rows.schema["embedding"].dataType
    dealt = index.select("block", each(chunks, "chunk"), "dim", none("long").alias("vec_id"), none(kind).alias("embedding"), "data").unionAll(
        asked.select(each(blocks, "block"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"), "dim", "vec_id", "embedding", none("binary")))
    found = dealt.groupBy("block", "chunk", "dim").applyInArrow(search_block(k, scale), "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
