"""From raw documents to packed training batches, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's documents; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.llm import mixing, ngramjoin, packing, repeats, toxicity
from stridewell.llm.common import materialize


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no stage uses under names that clash with nothing."""
    used = ("doc_id", "text", "source", "n_chars")
    return docs.toDF(*[c if c in used else f"_extra{i}" for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = plain(docs)
    clean = toxicity.score(own, model, *own.columns).where("predicted = 0")
    return clean.select(own.columns).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar n-gram sets join, the one with the
    smallest id stays; null ids stand last.  Rows with equal or null ids are
    judged each by its own text, so of equal rows one stays."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        found = ngramjoin.ngram_components(docs)
        return docs.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    rows = materialize(plain(docs).withColumn("_row", F.monotonically_increasing_id()))
    found = ngramjoin.similar_sets(rows.select(F.col("_row").alias("uid"), F.col("text").cast("binary").alias("text")))
    first = found.join(rows.select(F.col("_row").alias("uid"), "doc_id"), "uid").groupBy("grp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    keep = first.select(F.col("first.uid").alias("_row"))
    return rows.join(keep, "_row", "left_semi").drop("_row").toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that an earlier document or place has go, characters whole
    or not at all; texts with nothing left stay, empty."""
    own = plain(docs)
    carry = tuple(c for c in own.columns if c not in ("doc_id", "text", "n_chars"))
    cut = repeats.remove_repeats(own, carry=carry, whole=True)
    cut = cut.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(own.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target takes them; the document at
    the cut in part."""
    return mixing.mixed_documents(plain(docs)).toDF(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document stands in length buckets and batches."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: The classifier and the bucket bounds have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
