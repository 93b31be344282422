"""Writers, and rows for callers outside Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what is there; nulls are kept as keys."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """An indented JSON array per part file, replacing what is there; nulls are kept
    as keys.  A part without rows is an empty array or an empty file."""
    def lines(batches):
        held = None  # the last row, until it is known whether another follows
        for batch in batches:
            out = []
            for row in batch["value"].to_pylist():
                out.append("[" if held is None else f"  {held},")
                held = row
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        end = ["[]"] if held is None else [f"  {held}", "]"]
        yield pa.RecordBatch.from_arrays([pa.array(end, pa.string())], ["value"])

    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    text.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_json_file(df: DataFrame, path: str) -> None:
    """One indented JSON array in one file, replacing what is there; nulls are kept as
    keys.  No rows give an empty array.

    Tasks write their rows as parts.  The commit step joins the parts in order
    through the file system, a buffer at a time, under another name, and renames the
    whole file: a reader sees the old array or the new one.
    """
    spark = df.sparkSession
    jvm, conf, parts = spark._jvm, spark._jsc.hadoopConfiguration(), f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    text = df.select(F.concat(F.lit("  "), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value"))
    text.write.option("lineSep", ",\n").option("compression", "none").text(parts)
    hadoop = jvm.org.apache.hadoop.fs
    target, folder = hadoop.Path(path), hadoop.Path(parts)
    system = target.getFileSystem(conf)
    files = sorted(((f.getPath(), f.getLen()) for f in system.listStatus(folder) if f.getLen() and f.getPath().getName().startswith("part-")), key=lambda f: f[0].getName())
    joined = hadoop.Path(f"{parts}/joined")
    out = system.create(joined)
    write = lambda t: out.write(bytearray(t.encode()))
    write("[\n" if files else "[")
    for i, (part, size) in enumerate(files):
        source = system.open(part)
        # the last row of all has no separator behind it
        jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - 2 * (i + 1 == len(files)))
        source.close()
    write("\n]\n" if files else "]\n")
    out.close()
    system.delete(target, True)
    if not system.rename(joined, target):
        raise OSError(f"{path} cannot be put in place")
    system.delete(folder, True)


def write_lookup(df: DataFrame, table: str, path: str, key: str, buckets: int = 16, group_bytes: int = 128 << 20) -> None:
    """A table of the catalog for look-ups by ``key``: bucketed and sorted by it, with bloom
    filters, so a look-up opens one bucket's files and, of these, only row groups that
    may hold the key."""
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.block.size", group_bytes).option("parquet.page.size", min(group_bytes, 1 << 20)).saveAsTable(table))


def look_up(spark: SparkSession, table: str, key: str, *values: str) -> DataFrame:
    """The rows of a table of ``write_lookup`` whose key is one of some values."""
    wanted = F.col(key) == values[0] if len(values) == 1 else F.col(key).isin(*values)
    return spark.table(table).where(wanted)


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def publish(df: DataFrame, view: str) -> DataFrame:
    """Keep a result for repeated reading under a name; ``withdraw`` ends that."""
    df = df.persist()
    df.createOrReplaceTempView(view)
    return df


def withdraw(df: DataFrame, view: str) -> None:
    df.sparkSession.catalog.dropTempView(view)
    df.unpersist()


def payload(df: DataFrame) -> Iterator[dict]:
    """Rows as dicts, a partition at a time; meant for summaries."""
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)


def payload_pages(df: DataFrame, key: str, size: int = 1000) -> Iterator[list[dict]]:
    """Rows as dicts, in pages by a unique ``key``, nulls left out: each page is a top-k of
    the keys after the last page's, so the caller never holds more than a page, may
    stop at any, and a lost page is asked for again."""
    after = None
    while True:
        rest = df.where(F.col(key).isNotNull()) if after is None else df.where(F.col(key) > F.lit(after))
        rows = [r.asDict(recursive=True) for r in rest.orderBy(key).limit(size).collect()]
        if rows:
            yield rows
        if len(rows) < size:
            return
        after = rows[-1][key]
