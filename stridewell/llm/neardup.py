"""Near-duplicate embeddings: int8 tile products with rigorous error bounds.

Exact copies collapse first.  The rest of a label is hashed into tiles of a
bounded number of rows, and every pair of tiles is one group: the int8 values
are multiplied (in float32, where such sums are exact), per-vector error bounds
say which pairs can reach the threshold, and only those are computed again in
double precision.  A group returns a row per vector, not per pair: its number
of links and the smallest id that it reaches there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

#: float32 holds integers exactly up to 2**24: int8 products of so many components.
EXACT_DIMS = 2 ** 24 // 127 ** 2


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long list values as a matrix of doubles."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 values, scale, length of scale * values, length of the rest."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, k:k + EXACT_DIMS].astype(np.float32) @ b[:, k:k + EXACT_DIMS].astype(np.float32).T
    return out


def linked(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of unit matrices whose cosine reaches the threshold; i < j if ``same``."""
    (qx, sx, nx, ex), (qy, sy, ny, ey) = quantise(x), quantise(y)
    near = int8_products(qx, qy) * sx[:, None] * sy[None, :]
    # |x.y - near| <= |x'||dy| + |dx||y'| + |dx||dy|, and a little for rounding
    slack = nx[:, None] * ey[None, :] + ex[:, None] * ny[None, :] + ex[:, None] * ey[None, :] + 1e-9
    i, j = np.nonzero(near + slack >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    sure = (near[i, j] - slack[i, j]) >= threshold
    for k in range(0, len(i), 16_384):
        open_ = k + np.flatnonzero(~sure[k:k + 16_384])
        sure[open_] = np.einsum("ij,ij->i", x[i[open_]], y[j[open_]]) >= threshold
    return i[sure], j[sure]


def tile_pair(threshold: float):
    def run(key, group):
        i, j = key[2].as_py(), key[3].as_py()
        ids, tile, copies = (group[c].to_numpy() for c in ("rep", "tile", "copies"))
        x = matrix(group["embedding"])
        x /= np.abs(x).max(axis=1)[:, None]  # else squares of very small or large ones leave the range
        x /= np.linalg.norm(x, axis=1)[:, None]
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        a, b = linked(x[left], x[right], threshold, i == j)
        a, b = left[a], right[b]
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        low = ids.copy()
        while len(a):
            least = np.minimum(low[a], low[b])
            if (least == low[a]).all() and (least == low[b]).all():
                break
            np.minimum.at(low, a, least)
            np.minimum.at(low, b, least)
        hit = links > 0
        return pa.table({"rep": ids[hit], "links": links[hit].astype(np.int64), "low": low[hit]})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile_rows: int = 2048) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    ``vectors`` needs vec_id (long), embedding (array of float or double) and
    label; further columns are ignored.  Vectors with equal, non-null labels
    and equally many components are compared by cosine; those that are null,
    empty, zero or hold null or non-finite components, or have no id, link with
    nothing and stand alone (0 links, kept).  Exact copies link with each
    other; every row counts, repeated ones too.  Rows of one id are compared
    each by its own vector; an id's rows that are their component's smallest
    are all kept.  Empty table: no rows.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    good = (rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
                       & F.exists("embedding", lambda x: x != 0)))
    good = good.withColumn("h", F.xxhash64("label", "embedding"))
    keys = ["label", "h", "embedding"]
    # a number for each vector of a label: ids may occur again
    reps = materialize(good.groupBy(*keys).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
                       .withColumn("dim", F.size("embedding")).withColumn("rep", F.monotonically_increasing_id()))
    tiles = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    # one row per vector and pair of tiles: as many as rows times tiles of its label
    dealt = (reps.join(tiles, ["label", "dim"])
             .withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                     "tile", "rep", "copies", "embedding"))
    found = materialize(dealt.groupBy("label", "dim", "i", "j")
                        .applyInArrow(tile_pair(threshold), "rep long, links long, low long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(reps.select(F.col("rep").alias("id")),
                        found.where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    placed = reps.join(links, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep")
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    known = (placed.join(least, "component")
             .select(*keys, F.col("least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked_rows = good.join(known, keys).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
                                   & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    out = linked_rows.unionAll(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
