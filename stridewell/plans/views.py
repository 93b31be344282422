"""What a dashboard asks for."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import load
from ..schemas import SUMMARY_COLUMNS


class Analysis(NamedTuple):
    activities: DataFrame
    metrics: DataFrame


def summary(activities: DataFrame) -> DataFrame:
    return activities.select(*SUMMARY_COLUMNS)


def analysis(activities: DataFrame, by: tuple[str, ...] = ()) -> Analysis:
    """Activity summaries, and training metrics with dates as text."""
    m = load.training_metrics(activities, by)
    return Analysis(summary(activities), m.withColumn("date", S.iso_date(F.col("date"))))


def single_activity(activities: DataFrame, name: str) -> DataFrame:
    """The activity of that name, no row if there is none; of several the earliest."""
    return activities.where(F.col("name") == name).orderBy("timestamp", "trimp").limit(1)


def activity_or_error(activities: DataFrame, name: str) -> dict:
    """The activity of that name as a dict; LookupError if there is none."""
    found = single_activity(activities, name).collect()
    if not found:
        raise LookupError(f"no activity {name!r}")
    return found[0].asDict(recursive=True)


def answered(activities: DataFrame, asked: DataFrame) -> DataFrame:
    """``name, found`` for each row of ``asked(name)``; a null name is not found."""
    there = activities.select("name").distinct().withColumn("found", F.lit(True))
    return asked.join(there, "name", "left").select("name", F.coalesce("found", F.lit(False)).alias("found"))


def recent(activities: DataFrame, n: int = 3) -> DataFrame:
    """The latest ``n`` activities; undated ones last, ties by name."""
    return activities.orderBy(F.col("timestamp").desc_nulls_last(), "name").limit(n)


def latest(metrics: DataFrame, by: tuple[str, ...] = ("athlete_id",)) -> DataFrame:
    """Each athlete's last day: a maximum, combined before the shuffle."""
    rest = [c for c in metrics.columns if c not in by]
    return metrics.groupBy(*by).agg(F.max_by(F.struct(*rest), "date").alias("r")).select(*by, "r.*")
