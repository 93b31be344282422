"""Activities exported by tracking services, as JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns that are kept of a service's activity.
EXPORT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("start_date", T.StringType()), T.StructField("elapsed_time", T.DoubleType()),
    T.StructField("distance", T.DoubleType()), T.StructField("average_heartrate", T.DoubleType())])
#: Lines that are no row of an array.
FRAME = ("", "[", "]", "[]")


def even_rows(row: Column) -> tuple[Column, Column]:
    """Whether a line's brackets are even, from a brace to a brace; whether it may hold
    several objects.  What stands in quotes does not count."""
    plain = F.regexp_replace(row, r'"(?:[^"\\]|\\.)*+"', "")
    number = lambda c: F.length(plain) - F.length(F.replace(plain, F.lit(c), F.lit("")))
    even = plain.startswith("{") & plain.endswith("}") & (number("{") == number("}")) & (number("[") == number("]"))
    simple = row.rlike(r"^\{[^{}\[\]]*\}$")
    return simple | even, ~simple & plain.rlike(r"\}\s*,\s*\{")


def whole_rows(lines: DataFrame) -> bool:
    """Whether arrays have whole objects on every line.  JSON has no line break within
    quotes, so a line tells by itself whether its brackets are even; in an array where all
    lines' are, none begins or ends within an object."""
    at = lambda *c: F.count_if(F.col("row").isin(*c))
    all_even, opened, closed = lines.agg(F.bool_and(F.col("row").isin(*FRAME) | even_rows(F.col("row"))[0]), at("[", "[]"), at("]", "[]")).first()
    return bool(all_even) and opened == closed > 0


def read_export(spark: SparkSession, path: str, schema: T.StructType = EXPORT, array: bool = True) -> DataFrame:
    """One indented array per file (``array``) or a JSON object per line.  A broken
    record gives a row of nulls rather than an end of the job.

    Arrays with whole objects on each line, as the sinks write them, are read line by
    line, so many tasks share a file; a file of objects over several lines is read by
    one task."""
    if array:
        text = spark.read.text(path)
        folders = [c for c in text.columns if c != "value"]
        lines = text.select(F.btrim("value", F.lit(" \t\r\n,\ufeff")).alias("row"), *folders)
        if whole_rows(lines):
            one = F.array(F.from_json("row", schema))
            many = F.from_json(F.concat(F.lit("["), "row", F.lit("]")), T.ArrayType(schema))
            rows = F.when(even_rows(F.col("row"))[1], many).otherwise(one)
            return lines.where(~F.col("row").isin(*FRAME)).select(F.explode_outer(rows).alias("r"), *folders).select("r.*", *folders)
    return spark.read.schema(schema).option("multiLine", array).option("mode", "PERMISSIVE").json(path)


def no_activities(spark: SparkSession) -> DataFrame:
    """For a service without a connection: no rows, with the schema."""
    return spark.createDataFrame([], EXPORT)
