"""Load multipliers from a table, each valid from a day on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A table of weights of at most so many bytes goes to every executor.
SMALL = 8 << 20


def measured(weights: DataFrame) -> int:
    """Bytes of the table, counted: its text, and 40 for the rest of a row."""
    return weights.agg(F.coalesce(F.sum(F.octet_length("sport") + 40), F.lit(0))).first()[0]


def weigh(activities: DataFrame, weights: DataFrame, sport: str = "activity_type", time: str = "timestamp", small: int = SMALL) -> DataFrame:
    """``activities`` with ``weight``: of the rows of ``weights(sport, valid_from date,
    weight)`` of the same sport the one with the latest ``valid_from`` that is not after
    the activity's day; of two of one day the larger weight.

    Null for sports without one, days before the first, and activities without a
    time.  Rows of weights with a null in any column do not count.  No row is
    repeated or dropped.  A table of at most ``small`` bytes, which are counted
    first, is broadcast as one history per sport; a larger one is cut at months
    and joined by sport and month, so no activity meets more than a month's rows.
    """
    own = weights.select("sport", F.col("valid_from").cast("date").alias("valid_from"), F.col("weight").cast("double").alias("weight")).na.drop()
    own = own.groupBy("sport", "valid_from").agg(F.max("weight").alias("weight"))
    day = F.to_date(F.col(time))
    if measured(own) <= small:
        history = own.groupBy(F.col("sport").alias("_sport")).agg(F.array_sort(F.collect_list(F.struct("valid_from", "weight"))).alias("_all"))
        joined = activities.join(F.broadcast(history), F.col(sport) == F.col("_sport"), "left")
        valid = F.filter("_all", lambda x: x["valid_from"] <= day)
        return joined.withColumn("weight", F.try_element_at(valid, F.lit(-1))["weight"]).drop("_sport", "_all")
    month = lambda d: F.year(d) * 12 + F.month(d)
    last = activities.agg(F.max(day)).first()[0]
    until = F.lead(F.date_sub("valid_from", 1)).over(Window.partitionBy("sport").orderBy("valid_from"))
    spans = own.withColumn("until", F.coalesce(until, F.greatest(F.lit(last).cast("date"), F.col("valid_from"))))
    cut = spans.select(F.col("sport").alias("_sport"), F.col("valid_from").alias("_from"), F.col("until").alias("_until"), F.col("weight"),
                       F.explode(F.sequence(month(F.col("valid_from")), month(F.col("until")))).alias("_month"))
    there = (F.col(sport) == F.col("_sport")) & (month(day) == F.col("_month")) & day.between(F.col("_from"), F.col("_until"))
    return activities.join(cut, there, "left").select(*[F.col(f"`{c}`") for c in activities.columns], "weight")
