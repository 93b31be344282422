"""Helpers shared by the corpus operators: shared storage, words, components."""

from __future__ import annotations

import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh_path

#: A word is a run of bytes that are neither space nor one of the controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
PIECES, FAN = 16, 256  # parts in which parameters are averaged, so many tasks' at a time
PARTS = "piece int, task long, windows long, data binary"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python so many rows at a time: with Spark's default of
    10,000, a batch of long texts takes a good part of an executor's memory.  A
    size that the user has chosen stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and
    what was computed survives a lost executor."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``, once nothing reads it again."""
    for table in tables:
        remove(table.sparkSession, table._written_to)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of intermediate data."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def averaged(parts: DataFrame) -> DataFrame:
    """``piece, task, windows, data``: the mean of the tasks' float32 arrays of a
    piece, weighted by windows; at most FAN of them meet in a task at a time."""
    def mean(group):
        w = group["windows"].to_numpy().astype(np.float64)
        rows = [np.frombuffer(x.as_py(), np.float32) for x in group["data"]]
        data = sum(k * x for k, x in zip(w / w.sum(), rows)).astype(np.float32)
        return pa.table({"piece": group["piece"][:1], "task": group["task"][:1], "windows": pa.array([int(w.sum())]), "data": pa.array([data.tobytes()], pa.binary())})

    for _ in range(3):  # up to FAN ** 3 tasks
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("piece", "task").applyInArrow(mean, PARTS)
    return parts


def packed_parts(arrays: list[np.ndarray], task: int, weight: int) -> pa.RecordBatch:
    """A task's parameters as rows of ``averaged``."""
    data = [x.tobytes() for x in np.array_split(np.concatenate([a.ravel() for a in arrays]).astype(np.float32), PIECES)]
    return pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([task] * PIECES, pa.int64()), pa.array([weight] * PIECES, pa.int64()),
                                       pa.array(data, pa.binary())], ["piece", "task", "windows", "data"])


def mean_of_tasks(parts: DataFrame, like: list[np.ndarray]) -> list[np.ndarray] | None:
    """The tasks' mean as arrays of the shapes of ``like``; None if no task has any."""
    got = {r.piece: r.data for r in averaged(parts).collect()}  # the parameters once
    if not got:
        return None
    flat, at, out = np.frombuffer(b"".join(bytes(got[k]) for k in range(PIECES)), np.float32), 0, []
    for x in like:
        out.append(flat[at:at + x.size].reshape(x.shape).copy())
        at += x.size
    return out


def give_back() -> None:
    """The memory that a worker no longer uses goes to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda *_: 0)(0)


def lean(run):
    """``run`` over batches; the memory that a worker no longer uses goes back when it ends,
    as the worker lives on for other tasks."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def lean_group(run):
    """``run`` over a group's table, and memory goes back after each group."""
    def wrapped(group):
        try:
            return run(group)
        finally:
            give_back()
    return wrapped


def keep_memory(size: int = 64 << 20) -> None:
    """In a worker that makes arrays of up to ``size`` bytes again and again: what is freed
    serves the next ones, rather than to go to the system and come back page by page."""
    if sys.platform == "linux":
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)(option, size)


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components: ``vertices(id)`` and ``edges(a, b)`` of longs ->
    ``(id, component)``, the component's smallest id.

    Alternating large-star and small-star steps: each is a minimum per node
    (combined before the shuffle) and a join; no neighbour list is ever
    collected.  Ends when a round changes nothing; raises if ``rounds`` do not
    suffice, which needs a path of more than 2**rounds links.  Vertices
    without edges stand alone.  Null ends and loops count as no edge.
    """
    e = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u > v").distinct()
    )
    if e.isEmpty():
        return vertices.select("id", F.col("id").alias("component"))
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour links to the smallest around
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        # small star: every smaller neighbour and the node itself link to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                    F.count_distinct("u")).first()
        # a forest of stars: every node has one parent, and no parent is a child
        if tuple(now) == last and now[0] == now[2]:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components: not settled after the given rounds")
    return (vertices.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left")
            .select("id", F.coalesce("component", "id").alias("component")))
