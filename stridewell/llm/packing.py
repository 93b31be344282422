"""Packing documents into length buckets with the least padding.

The global histogram of lengths (combined before the shuffle) decides the
bucket bounds by dynamic programming; inside each bucket rows in hash order
fill batches of a token budget.  Row numbers come from counts per hash range,
so a bucket that holds most rows is never gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Lengths up to FINE have a histogram cell each; above, an octave has STEPS cells.
FINE, STEPS = 1024, 64


def cell_of(length: Column) -> Column:
    """Histogram cell: the length itself up to FINE, then cells of relative
    width 1/STEPS, so that the histogram has at most FINE + STEPS * 53 cells
    whatever the lengths."""
    octave = F.floor(F.log2(length / F.lit(float(FINE))))
    inside = F.floor((length / (F.lit(float(FINE)) * F.pow(F.lit(2.0), octave)) - 1) * STEPS)
    return F.when(length <= FINE, length).otherwise(FINE + 1 + octave * STEPS + inside).cast("long")


def optimal_bounds(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths that minimise padding.

    ``longest``, ``count`` and ``total``: largest length, rows and sum of
    lengths of each histogram cell, ascending.  best[j] is the least padding of
    the first j cells in so many buckets; a bucket over cells i..j-1 pads its
    rows to longest[j-1].
    """
    m = len(count)
    if not m:
        return []
    n, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])
    top = np.concatenate([[0], longest]).astype(float)
    best, cuts = np.full(m + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
        new[0] = 0.0
        for j in range(1, m + 1):
            cost = best[:j] + top[j] * (n[j] - n[:j]) - (s[j] - s[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        cuts.append(cut)
    bounds, j = [], m
    for cut in reversed(cuts):
        if j:
            bounds.append(int(longest[j - 1]))
            j = int(cut[j])
    return sorted(set(bounds))


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 16_384,
         seed: int = 17, rows_per_cell: int = 2_000) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_len, batch, slot, padding`` for every
    row of ``docs``.

    ``length``: a column of token counts; by default the words of ``text``.
    Null texts or lengths count 0 and stand in the first bucket.  A batch holds
    floor(budget / bucket_len) rows, one at least, so a text longer than the
    budget has a batch of its own and is never cut.  ``batch`` counts from 0
    within the bucket, ``slot`` within the batch.  Repeated rows are packed
    each; ties in hash order are broken by doc_id, then length.  Other columns
    are ignored.  Empty table: no rows.
    """
    if length is None:
        length = word_count(F.col("text"))
    base = materialize(docs.select("doc_id", F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"),
                                   F.xxhash64(F.lit(seed), "doc_id").alias("key")))
    hist = (base.groupBy(cell_of(F.col("n_tokens")).alias("cell"))
            .agg(F.max("n_tokens").alias("longest"), F.count("*").alias("n"), F.sum("n_tokens").alias("s"))
            .orderBy("cell").collect())  # bounded: see cell_of
    bounds = optimal_bounds(np.array([r.longest for r in hist]), np.array([r.n for r in hist]),
                            np.array([r.s for r in hist]), buckets)
    rows, bits = sum(r.n for r in hist), 4
    while 2 ** bits * rows_per_cell < rows:
        bits += 1
    bucket, size = F.lit(len(bounds) - 1), F.lit(bounds[-1] if bounds else 0)
    for k in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
        size = F.when(F.col("n_tokens") <= bounds[k], F.lit(bounds[k])).otherwise(size)
    base = (base.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", size.cast("long"))
            .withColumn("cell", F.shiftright("key", 64 - bits)))
    cells = base.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("bucket", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("bucket", "cell").orderBy("key", "doc_id", "n_tokens")
    place = base.withColumn("own", F.row_number().over(own)).join(cells, ["bucket", "cell"])
    nth = F.col("ahead") + F.col("own") - 1
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1).cast("long"))))
    return place.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(nth / room).cast("long").alias("batch"),
                        (nth % room).cast("long").alias("slot"),
                        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
