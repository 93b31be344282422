"""Metrics kept as tables and refreshed by batches of activities.

Under the store's folder ``loads`` has each batch's daily sums, ``metrics`` every
athlete's days by month, ``state`` each athlete's last day with its averages.  A
batch recomputes only its own athletes, from the first day that it changes on:
from ``state`` where that day is new, else from the day before in ``metrics``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import load as L
from ..sources.files import exists, remove

#: Folders that the state is dealt over.
PARTS = 16


def month(date) -> F.Column:
    return F.date_format(date, "yyyy-MM")


class MetricsStore:
    """``spans`` and ``by`` are the store's for good.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = ("athlete_id",), spans: tuple[int, int] = (S.SHORT_SPAN, S.LONG_SPAN)):
        self.spark, self.path, self.by, self.spans = spark, path.rstrip("/"), by, spans
        self.pending = f"{self.path}/_pending"

    def table(self, name: str) -> DataFrame | None:
        path = f"{self.path}/{name}"
        return self.spark.read.option("basePath", path).parquet(path) if exists(self.spark, path) else None

    def metrics(self) -> DataFrame:
        """``by, date, trimp, atl, ctl, tsb, status`` of every day; None before the first batch."""
        found = self.table("metrics")
        return found and L.judged(found.select(*self.by, "date", "trimp", "atl", "ctl"))

    def latest(self) -> DataFrame:
        """Each athlete's last day, from the state alone."""
        found = self.table("state")
        return found and L.judged(found.select(*self.by, "date", "atl", "ctl"))

    def apply(self, activities: DataFrame, batch: int) -> None:
        """Take in a batch, late activities included.  The same number again replaces
        that batch, so one that broke off can simply be given again."""
        self.publish()
        own = f"{self.path}/loads/batch={batch}"
        before = self.spark.read.parquet(own).select(*self.by, "date") if exists(self.spark, own) else None
        if before is not None:  # days may go with it: its athletes are computed anew
            before = self.staged(before.select(*self.by, F.lit("1000-01-01").cast("date").alias("date")).distinct(), "replaced")
        loads = L.daily_load(activities, self.by).withColumn("month", month("date"))
        loads.write.mode("overwrite").partitionBy("month").parquet(own)
        changed = self.spark.read.schema(loads.schema).parquet(own).select(*self.by, "date")
        self.recompute(changed if before is None else changed.unionByName(before))
        remove(self.spark, f"{self.pending}")

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.pending}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def recompute(self, changed: DataFrame) -> None:
        since = changed.groupBy(*self.by).agg(F.min("date").alias("since"))
        state, metrics = self.table("state"), self.table("metrics")
        keys = [F.col(c).alias(f"_{c}") for c in self.by]
        match = L.equal(self.by)
        starts = None
        if state is not None:
            ends = state.select(*keys, F.col("date").alias("_date"), F.col("atl").alias("_atl"), F.col("ctl").alias("_ctl"))
            known = self.staged(since.join(ends, match, "left").select(*self.by, "since", "_date", "_atl", "_ctl"), "known")
            late = known.where("_date >= since").select(*self.by, "since")
            on_time = known.where("_date < since").select(*self.by, F.col("_date").alias("date"), F.col("_atl").alias("atl"), F.col("_ctl").alias("ctl"))
            first = late.agg(F.min("since")).first()[0]
            starts = on_time
            if first is not None:  # the day before each late one, from its month and later ones only
                days = metrics.where(F.col("month") >= F.date_format(F.date_sub(F.lit(first), 1), "yyyy-MM"))
                days = days.select(*keys, F.col("date").alias("_date"), "atl", "ctl")
                starts = starts.unionByName(late.join(days, match & (F.col("_date") == F.date_sub("since", 1))).select(*self.by, F.col("_date").alias("date"), "atl", "ctl"))
            starts = self.staged(starts, "starts")
        renamed = since.select(*keys, "since")
        loads = self.table("loads").where(F.col("month") >= month(F.lit(since.agg(F.min("since")).first()[0])))
        # an athlete without a start is computed from the first day on, which is not before ``since``
        daily = loads.join(renamed, match).where("date >= since").groupBy(*self.by, "date").agg(F.sum("trimp").alias("trimp"))
        fresh = self.staged(L.atl_ctl(daily, self.by, self.spans, starts).withColumn("month", month("date")), "fresh")
        part = F.pmod(F.xxhash64(*self.by), F.lit(PARTS)).cast("int").alias("part")
        last = fresh.groupBy(*self.by).agg(F.max_by(F.struct("date", "atl", "ctl"), "date").alias("end")).select(*self.by, "end.*", part)
        begins = fresh.select(*self.by, F.col("date").alias("since")).unionByName(since).groupBy(*self.by).agg(F.min("since").alias("begin"))
        begins = self.staged(begins, "begins").select(*keys, "begin")
        least = begins.agg(F.min("begin")).first()[0]
        if least is None:
            return
        kept, months, parts = fresh, None, None
        if metrics is not None:  # rows of the touched months that stay: other athletes', and days before
            old = metrics.where(F.col("month") >= month(F.lit(least)))
            months = old.select("month").distinct()
            kept = fresh.unionByName(old.join(begins, match, "left").where("begin is null or date < begin").select(*fresh.columns))
            parts = since.select(part).distinct()
            others = state.join(begins, match, "left_anti").join(parts, "part", "left_semi").select(*last.columns)
            last = last.unionByName(others)
        for name, key, rows, touched in (("metrics", "month", kept, months), ("state", "part", last, parts)):
            rows = self.staged(rows, name)
            if touched is not None:
                self.staged(touched.join(rows, key, "left_anti"), f"{name}_gone")
        self.staged(begins, "done")
        self.publish()

    def publish(self) -> None:
        """Put what is staged into its place: partitions that it has are replaced, others
        stay.  If that broke off, the next batch does it again first."""
        if exists(self.spark, f"{self.pending}/done/_SUCCESS"):  # written last
            for name, key in (("metrics", "month"), ("state", "part")):
                staged = self.spark.read.parquet(f"{self.pending}/{name}")
                staged.repartition(F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{self.path}/{name}")
                if exists(self.spark, f"{self.pending}/{name}_gone"):  # few: partitions that were left without rows
                    for row in self.spark.read.parquet(f"{self.pending}/{name}_gone").collect():
                        remove(self.spark, f"{self.path}/{name}/{key}={row[key]}")
        remove(self.spark, self.pending)
