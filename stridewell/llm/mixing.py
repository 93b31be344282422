"""Mixing sources to target weights.

Each document gets a hash-random key; within each source documents stand in
the order of their keys.  The key's leading hex digits cut that order into
ranges (cells), so no sampling is needed to range-sort: word sums per cell are
combined before the shuffle, summed up over the cells of a source, and each
cell then sums up its own rows.  No task sees a whole source, so a source with
a third or all of the rows spreads over all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, word_count

#: Weights dealt to the sources in order, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """``sizes(nosrc, src, source_size)``, one row per source -> plus ``target``.

    ``share`` times all sizes goes to the sources by weight; a target stops at
    ``cap`` times its source's size and the excess is shared again by weight
    until none is above.  That fixed point is min(cap * size, level * weight)
    with one level for all, found from the sources sorted by where each stops.
    The windows run over one row per source, never over documents.
    """
    order = Window.orderBy("nosrc", "src")
    deal = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", F.get(deal, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    w = w.withColumn("stop", F.lit(cap) * F.col("source_size")).withColumn("at", F.col("stop") / F.col("weight"))
    full, below = Window.orderBy("at", "nosrc", "src"), Window.partitionBy()
    w = (w.withColumn("stops", F.sum("stop").over(full.rowsBetween(Window.unboundedPreceding, -1)))
          .withColumn("gone", F.sum("weight").over(full.rowsBetween(Window.unboundedPreceding, -1)))
          .withColumn("total", F.sum("source_size").over(below)).withColumn("all_w", F.sum("weight").over(below)))
    level = ((F.lit(share) * F.col("total") - F.coalesce("stops", F.lit(0.0)))
             / (F.col("all_w") - F.coalesce("gone", F.lit(0.0))))
    # the first source, in order of stops, that the level of the rest doesn't fill
    w = w.withColumn("level", F.min(F.when(level <= F.col("at"), F.struct(F.col("at"), F.col("nosrc"), F.col("src"), level.alias("level")))).over(below)["level"])
    return w.select("nosrc", "src", "source_size", F.least("stop", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: str = "mix", rows_per_cell: int = 2_000,
        key: Column | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    ``docs`` needs doc_id, source, text; further columns are ignored, so names
    may clash.  size: words of the text, 0 for null.  A source's budget is its
    target rounded down; whole epochs are taken of every document, the rest is
    cut at exactly the budget in key order, so the last document may be taken
    in part and no document beyond ``cap`` (2) times its size.  Null sources are
    one source, standing last.  Repeated rows count each; equal keys are
    ordered by doc_id (nulls first), then size, so reruns agree.  Empty table:
    no rows.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) if key is None else key
    base = materialize(docs.select(
        "doc_id", F.col("source").isNull().alias("nosrc"), F.coalesce("source", F.lit("")).alias("src"),
        hashed.alias("key"), word_count(F.col("text")).alias("size")))
    digits, rows = 1, base.count()
    while 16 ** digits * rows_per_cell < rows:
        digits += 1
    base = base.withColumn("cell", F.substring("key", 1, digits))
    cells = base.groupBy("nosrc", "src", "cell").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("nosrc", "src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    plan = targets(cells.groupBy("nosrc", "src").agg(F.sum("words").alias("source_size")), share, cap)
    cells = cells.join(plan, ["nosrc", "src"])
    own = (Window.partitionBy("nosrc", "src", "cell").orderBy("key", "doc_id", "size")
           .rowsBetween(Window.unboundedPreceding, -1))
    out = base.withColumn("before", F.coalesce(F.sum("size").over(own), F.lit(0))).join(cells, ["nosrc", "src", "cell"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("ahead") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row once per epoch that takes it, whole or,
    at the cut, as the text up to its last taken word.  Same columns as
    ``docs``.  Where ids are null or occur again, rows are numbered and take
    their hash-random keys from those numbers."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
        own = numbered.withColumnRenamed("doc_id", "_own").withColumnRenamed("_row", "doc_id")
        return mixed_documents(own, **options).drop("doc_id").withColumnRenamed("_own", "doc_id").select(docs.columns)
    plan = mix(docs, **options).where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    text = docs["text"]
    shown = docs.join(plan, docs["doc_id"] == F.col("_id"))
    shown = shown.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_size")).cast("long"))))
    left = F.col("_taken") - F.col("_part") * F.col("_size")
    # at most one row of a source is cut, so the slow expression runs for few
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, left.cast("int")), "")
    cut = F.when(left >= F.col("_size"), text).otherwise(head)
    new = shown.withColumn("_text", cut)
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return new.select(*[fresh[c].alias(c) if c in fresh else docs[c] for c in docs.columns])
