"""Stand-ins: the driver's tables hold no workouts, so events are read as
activities: user -> athlete, value -> minutes, the number in props -> heart rate,
event type -> sport (two types are of no supported sport)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activities as A
from ..schemas import METRICS, metric_type

SPORTS = {"click": "running", "view": "cycling", "purchase": "swimming"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sport = F.lit("generic")
    for kind, name in SPORTS.items():
        sport = F.when(F.col("event_type") == kind, name).otherwise(sport)
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("user_id").alias("athlete_id"), F.concat(F.lit("e"), F.col("event_id"), F.lit(".fit")).alias("name"),
        sport.alias("sport"), F.lit(None).cast("string").alias("sub_sport"), F.col("ts").alias("timestamp"),
        (F.col("value") * 60.0).alias("elapsed"), F.get_json_object("props", "$.k").cast("double").alias("avg_heart_rate"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scored(raw_activities(spark, sf_dir)).select("event_id", "athlete_id", "name", "activity_type", "sub_sport", "timestamp", "duration_min", "avg_heart_rate", "trimp")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events each as the messages of one file."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("o"), F.floor(F.col("event_id") / 4), F.lit(".fit")).alias("name"), (F.col("event_id") % 4).cast("int").alias("seq"),
        F.col("user_id").cast("long").alias("s"), (F.col("event_id") * 7).cast("long").alias("p"), F.floor("value").cast("double").alias("q"),
        "event_type", "ts")


def file_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session messages: some keys are missing in some, and some heart rates are
    there but null."""
    odd, s = F.col("seq") % 2 == 1, F.col("s")
    key = lambda name, where: F.when(where, F.lit(name))
    sport = F.lit("rowing")
    for kind, name in SPORTS.items():
        sport = F.when(F.col("event_type") == kind, name).otherwise(sport)
    return messages(spark, sf_dir).select(
        "name", "seq", sport.alias("sport"), F.col("event_type").alias("sub_sport"), F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        (F.col("q") * 60.0).alias("total_elapsed_time"), F.when(odd, (F.col("p") % 200).cast("double")).alias("avg_heart_rate"),
        s.cast("double").alias("total_distance"), F.lit(None).cast("double").alias("total_calories"),
        F.array_compact(F.array(F.lit("sport"), F.lit("timestamp"), key("sub_sport", odd), key("total_elapsed_time", s % 3 != 0),
                                key("avg_heart_rate", s % 2 == 0), F.lit("total_distance"))).alias("present"))


def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with power and heart rate."""
    power, rate = F.col("s") % 4 != 0, F.col("p") % 3 == 0
    values = {"power": F.when(power, F.col("q")), "heart_rate": F.when(rate, (F.col("p") % 200).cast("int"))}
    return messages(spark, sf_dir).select(
        "name", F.col("seq").alias("idx"), *[values.get(m, F.lit(None).cast(metric_type(m))).alias(m) for m in METRICS],
        F.array_compact(F.array(F.when(power, F.lit("power")), F.when(rate, F.lit("heart_rate")))).alias("present"))


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a tracking service exports activities."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("long").alias("id"), F.when(F.col("event_id") % 9 != 0, F.concat(F.lit('a "quoted" ride, '), "event_type")).alias("name"),
                    F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("start_date"), F.col("value").alias("elapsed_time"),
                    (F.col("value") * 2).alias("distance"), F.get_json_object("props", "$.k").cast("double").alias("average_heartrate"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of their user: file order is (ts, event_id), numbers of 0
    are gaps."""
    k = F.nullif(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("name"), F.struct("ts", "event_id").alias("idx"), k.alias("power"),
        F.array(F.lit("power")).alias("present"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples with coordinates and speeds; users of odd number have the
    enhanced columns, and every tenth sample lacks them."""
    odd, gap = F.col("user_id") % 2 == 1, F.col("event_id") % 10 == 0
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("idx"),
        F.when(~gap, F.col("event_id") * 1000.0).alias("position_lat"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") * -500.0).alias("position_long"),
        F.col("value").alias("speed"), F.when(odd & ~gap, F.col("value") + 1).alias("enhanced_speed"),
        (F.col("value") * 2).alias("altitude"), F.when(odd & ~gap, F.col("value") * 3).alias("enhanced_altitude"),
        F.when(odd, F.array(F.lit("speed"), F.lit("enhanced_speed"), F.lit("altitude"), F.lit("enhanced_altitude")))
        .otherwise(F.array(F.lit("speed"), F.lit("altitude"))).alias("present"))


def fit_messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of a user as the messages of one file: every event is a sample, every
    fifth a session too; a third of the samples have a heart rate, seconds are whole."""
    e = table(spark, sf_dir, "events")
    i, at = F.col("event_id"), F.date_trunc("second", "ts").cast("timestamp_ntz")
    name, order = F.concat(F.lit("u"), "user_id", F.lit(".fit")).alias("name"), F.struct("ts", "event_id")
    records = e.select(name, order.alias("idx"), at.alias("timestamp"), (i % 500 / 8).alias("speed"), F.floor("value").cast("double").alias("power"),
                       F.when(i % 2 == 0, i % 200).cast("int").alias("heart_rate"),
                       F.array_compact(F.array(F.lit("timestamp"), F.lit("speed"), F.lit("power"), F.when(i % 3 == 0, F.lit("heart_rate")))).alias("present"),
                       F.when(i % 4 == 0, F.create_map(F.lit("field_200"), F.col("value"))).alias("others"))
    sport = F.lit("generic")
    for kind, label in SPORTS.items():
        sport = F.when(F.col("event_type") == kind, label).otherwise(sport)
    sessions = e.where(i % 5 == 0).select(
        name, order.alias("seq"), sport.alias("sport"), at.alias("timestamp"), (i % 7200 + F.lit(0.5)).alias("total_elapsed_time"),
        F.when(i % 2 == 0, i % 200).cast("double").alias("avg_heart_rate"), i.cast("double").alias("total_distance"),
        F.array_compact(F.array(F.lit("sport"), F.lit("timestamp"), F.lit("total_elapsed_time"), F.lit("total_distance"),
                                F.when(i % 3 == 0, F.lit("avg_heart_rate")))).alias("present"))
    return sessions, records
