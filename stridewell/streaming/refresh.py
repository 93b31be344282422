"""Daily load kept current from a stream of activities.

The reference computes once at start; here new activities may arrive as files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import MetricsStore


def daily_stream(activities: DataFrame, late: str = "3 days") -> DataFrame:
    """``athlete_id, date, trimp`` of a stream with a timestamp column; a day's sum is
    final once the watermark, ``late`` behind the newest activity, has passed it."""
    load = F.when(~F.isnan("trimp"), F.col("trimp"))
    return (activities.where(F.col("timestamp").isNotNull())
            .withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
            .groupBy("athlete_id", F.window("timestamp", "1 day").alias("day"))
            .agg(F.coalesce(F.sum(load), F.lit(0.0)).alias("trimp"))
            .select("athlete_id", F.to_date("day.start").alias("date"), "trimp"))


def append_daily(activities: DataFrame, path: str, checkpoint: str, late: str = "3 days") -> StreamingQuery:
    """Write finished days as Parquet, each once; stops when the input is read."""
    return (daily_stream(activities, late).writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def refresh_store(activities: DataFrame, store: MetricsStore, checkpoint: str) -> StreamingQuery:
    """Keep a store of metrics current from a stream of activities, late ones included.

    Each micro-batch is a batch of the store under the stream's own number, so one that
    is given again after a lost driver replaces itself and nothing counts twice.
    Stops when the input is read; started again it goes on with new files.
    """
    def take(batch: DataFrame, number: int) -> None:
        store.apply(batch, number)

    return (activities.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
