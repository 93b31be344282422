"""From session messages and samples to activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..schemas import ACTIVITY_COLUMNS, METRICS, SESSION_FIELDS
from ..scratch import fresh_path


def fold_sessions(sessions: DataFrame, fields: tuple[str, ...] = tuple(SESSION_FIELDS)) -> DataFrame:
    """One row per name: each field from the last message that carries its key,
    even if its value there is null; ``keys`` tells which fields any carries."""
    has = lambda k: F.array_contains("present", k)
    folds = [F.max_by(F.struct(F.col(k).alias("v")), F.when(has(k), F.col("seq"))).alias(k) for k in fields]
    keys = [F.bool_or(F.coalesce(has(k), F.lit(False))).alias(f"has_{k}") for k in fields]
    one = sessions.groupBy("name").agg(*folds, *keys)
    return one.select("name", *[F.col(k)["v"].alias(k) for k in fields],
                      F.filter(F.array(*[F.when(F.col(f"has_{k}"), F.lit(k)) for k in fields]), lambda x: x.isNotNull()).alias("keys"))


def sample_arrays(records: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per name: an array per metric in file order, as long as the file has
    samples, with nulls in the gaps; null where no sample has the metric."""
    rows = F.array_sort(F.collect_list(F.struct("idx", *metrics)))
    keys = [F.bool_or(F.coalesce(F.array_contains("present", m), F.lit(False))).alias(f"has_{m}") for m in metrics]
    one = records.groupBy("name").agg(rows.alias("samples"), *keys)
    # a field of an array of structs is the array of that field
    return one.select("name", *[F.when(F.col(f"has_{m}"), F.col(f"samples.{m}")).alias(m) for m in metrics])


def sample_chunks(records: DataFrame, metrics: tuple[str, ...] = METRICS, chunk: int = 10_000) -> DataFrame:
    """The arrays of ``sample_arrays`` in pieces: ``name, chunk`` (from 0) and per metric an
    array of at most ``chunk`` samples, for names with more samples than a row should
    hold.  Laid end to end by ``chunk`` they are the whole arrays: as long as each other,
    in file order, null throughout where no sample of the name has the metric.

    Samples are sorted over all tasks by name and order; how many of a name stand in
    the ranges before a sample's own gives its place.  No name is gathered anywhere.
    """
    keys = records.groupBy("name").agg(*[F.bool_or(F.coalesce(F.array_contains("present", m), F.lit(False))).alias(f"has_{m}") for m in metrics])
    # kept as it lies: ranges, and the order in them, must not be drawn twice
    path = fresh_path(records.sparkSession)
    (records.select("name", "idx", *metrics).repartitionByRange("name", "idx").sortWithinPartitions("name", "idx")
     .select("name", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"), *metrics).write.parquet(path))
    rows = records.sparkSession.read.parquet(path)
    counts = rows.groupBy("name", "range").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("name").alias("_name"), F.col("range").alias("_range"), "least", before.alias("before"))
    placed = rows.join(starts, F.col("name").eqNullSafe(F.col("_name")) & (F.col("range") == F.col("_range")))
    place = F.col("before") + F.col("at") - F.col("least")
    pieces = placed.groupBy("name", F.floor(place / chunk).cast("int").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), *metrics))).alias("samples"))
    own = keys.withColumnRenamed("name", "_name")
    return pieces.join(own, F.col("name").eqNullSafe(F.col("_name"))).select(
        "name", "chunk", *[F.when(F.col(f"has_{m}"), F.col(f"samples.{m}")).alias(m) for m in metrics])


def scored(sessions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Sessions of supported sports (``sport``, ``elapsed`` seconds, ``avg_heart_rate``)
    with minutes and load; other columns stay."""
    s = sessions.where(S.supported(F.col("sport"), weights)).withColumn("duration_min", S.minutes(F.col("elapsed")))
    return s.withColumn("trimp", S.trimp(F.col("duration_min"), F.col("avg_heart_rate"), F.col("sport"), weights)).withColumnRenamed("sport", "activity_type").drop("elapsed")


def activities(sessions: DataFrame, records: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """The 20 columns of activities of supported sports.

    A missing elapsed time or heart rate counts 0; one that is there but null
    stays null.  Without ``records`` the arrays are null and no sample is read.
    """
    s = fold_sessions(sessions)
    there = lambda k: F.array_contains("keys", k)
    elapsed = F.when(there("total_elapsed_time"), F.col("total_elapsed_time")).otherwise(F.lit(0.0))
    rate = F.when(there("avg_heart_rate"), F.col("avg_heart_rate")).otherwise(F.lit(0.0))
    s = scored(s.select("name", "sport", "sub_sport", "timestamp", elapsed.alias("elapsed"), rate.alias("avg_heart_rate"),
                        F.col("total_distance").alias("distance"), F.col("total_calories").alias("calories")), weights)
    if records is None:
        kind = lambda m: "array<int>" if m == "heart_rate" else "array<double>"
        return s.select(*[F.col(c) if c in s.columns else F.lit(None).cast(kind(c)).alias(c) for c in ACTIVITY_COLUMNS])
    return s.join(sample_arrays(records), "name", "left").select(*ACTIVITY_COLUMNS)


def gps_track(records: DataFrame) -> DataFrame:
    """Samples with both coordinates, in degrees."""
    both = records.na.drop(how="any", subset=["position_lat", "position_long"])
    return both.select("name", "idx", S.degrees(F.col("position_lat")).alias("lat"), S.degrees(F.col("position_long")).alias("lon"))


def chosen(records: DataFrame, enhanced: str, plain: str, out: str) -> DataFrame:
    """``name, idx, out``: the enhanced column where the activity has it anywhere,
    else the plain one."""
    has = records.groupBy("name").agg(*[F.bool_or(F.coalesce(F.array_contains("present", c), F.lit(False))).alias(f"has_{k}")
                                        for k, c in (("e", enhanced), ("p", plain))])
    return records.join(has, "name").select(
        "name", "idx", S.prefer(F.col(enhanced), F.col(plain), F.col("has_e"), F.col("has_p")).alias(out))


def elevation(records: DataFrame) -> DataFrame:
    return chosen(records, "enhanced_altitude", "altitude", "elevation")


def speed_kmh(records: DataFrame) -> DataFrame:
    speed = chosen(records, "enhanced_speed", "speed", "speed").where(F.col("speed").isNotNull() & ~F.isnan("speed"))
    return speed.select("name", "idx", S.kmh(F.col("speed")).alias("speed_kmh"))
