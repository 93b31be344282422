"""Daily load, its moving averages and their balance, per athlete.

Activities shrink to one row per athlete and day before anything is gathered.  An
athlete's days are cut at fixed dates into stretches, which are worked on apart: a
moving average over a stretch is an affine map of the average before it, so the
maps of all stretches, two numbers each, are composed in order, and every stretch
then starts from its own average.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S

#: Days in a stretch, which is one row; days of it that are gathered at a time.
STRETCH, STEP = 4096, 64


def daily_load(activities: DataFrame, by: tuple[str, ...] = ("athlete_id",)) -> DataFrame:
    """``by, date, trimp``: sums of dated activities; NaN counts as missing, and a
    day of missing loads as 0."""
    dated = activities.where(F.col("timestamp").isNotNull())
    load = F.when(~F.isnan("trimp"), F.col("trimp"))
    return (dated.groupBy(*by, F.to_date("timestamp").alias("date"))
            .agg(F.coalesce(F.sum(load), F.lit(0.0)).alias("trimp")))


def date_bounds(daily: DataFrame, by: tuple[str, ...] = ("athlete_id",)) -> DataFrame:
    return daily.groupBy(*by).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def equal(by: tuple[str, ...], more: tuple[str, ...] = ()) -> Column:
    """Keys ``by``, null equal to null, and ``more`` equal to those of another table that are
    named with a dash before them."""
    return functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col(c) == F.col(f"_{c}") for c in more])


def stretches(daily: DataFrame, by: tuple[str, ...], spans: tuple[int, int] | None = None, starts: DataFrame | None = None) -> DataFrame:
    """``by, known, before`` and, with ``spans``, ``atl, ctl``: one row per athlete and
    stretch with known days, ``known`` their (date, trimp) in order, ``before`` the last
    known day of the athlete's stretch before it and ``atl, ctl`` the averages of that
    day; in the first the row of ``starts(by, date, atl, ctl)``, null without one."""
    # never null, so that the join puts no filter on one of its sides and both share one shuffle
    number = F.coalesce(F.floor(F.unix_date("date") / STRETCH).cast("int"), F.lit(0))
    known = daily.groupBy(*by, number.alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("date", "trimp"))).alias("known"))
    first, last = F.get("known", 0), F.element_at("known", -1)
    parts = [F.col("stretch"), first["date"].alias("first"), first["trimp"].alias("load"), last["date"].alias("last")]
    rates = [2.0 / (n + 1) for n in spans] if spans else []
    if spans:
        # the average after the stretch is rest * (average before it) + sum, the sum taken day by day
        day = lambda x: F.unix_date(x["date"])

        def total(rate):
            keep = F.lit(1 - rate)
            return F.aggregate("known", F.struct(F.lit(0.0).alias("v"), (day(first) - 1).alias("d")), lambda s, x: F.struct(
                (s["v"] * F.pow(keep, day(x) - s["d"]) + F.lit(rate) * x["trimp"]).alias("v"), day(x).alias("d")))["v"]

        for i, rate in enumerate(rates):
            parts += [F.pow(F.lit(1 - rate), day(last) - day(first) + 1).alias(f"rest{i}"), total(rate).alias(f"sum{i}")]
    each = known.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("all"))
    kind = "struct<stretch:int,before:date" + ",y0:double,y1:double>" * bool(spans) + ">" * (not spans)
    state = f"struct<out:array<{kind}>,before:date" + ",y0:double,y1:double>" * bool(spans) + ">" * (not spans)
    names = ["before"] + ["y0", "y1"] * bool(spans)

    def step(s, x):
        after = [x["last"].alias("before")]
        for i, rate in enumerate(rates):
            gap = F.datediff(x["first"], s["before"]) - 1  # days without load between the stretches
            start = F.coalesce(s[f"y{i}"] * F.pow(F.lit(1 - rate), gap), x["load"])
            after.append((x[f"rest{i}"] * start + x[f"sum{i}"]).alias(f"y{i}"))
        own = F.struct(x["stretch"], *[s[n].alias(n) for n in names])
        return F.struct(F.concat(s["out"], F.array(own)).alias("out"), *after)

    given = [F.lit(None).alias(n) for n in names]
    if starts is not None:
        own = starts.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(c).alias(f"_{n}") for c, n in zip(("date", "atl", "ctl"), names)])
        each = each.join(own, equal(by), "left")
        given = [F.col(f"_{n}").alias(n) for n in names]
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("out"), *given).cast(state)
    starts = each.select(*by, F.inline(F.aggregate("all", empty, step)["out"]))
    renamed = starts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("stretch").alias("_stretch"), *names)
    return known.join(renamed, equal(by, ("stretch",))).select(*by, "known", "before", *[F.col(f"y{i}").alias(n) for i, n in enumerate(("atl", "ctl")) if spans])


def filled(known: Column, before: Column) -> Column:
    """Every day from the one after ``before`` (or the first known) to the last known, as
    (date, trimp), days that are not known with 0."""
    ahead = F.transform(known, lambda x, i: F.struct(
        F.when(i > 0, F.date_add(F.get(known, i - 1)["date"], 1)).otherwise(F.coalesce(F.date_add(before, 1), x["date"])).alias("start"),
        x["date"].alias("date"), x["trimp"].alias("trimp")))
    return F.flatten(F.transform(ahead, lambda x: F.transform(
        F.sequence(x["start"], x["date"]), lambda d: F.struct(d.alias("date"), F.when(d == x["date"], x["trimp"]).otherwise(F.lit(0.0)).alias("trimp")))))


def dense_daily(daily: DataFrame, by: tuple[str, ...] = ("athlete_id",)) -> DataFrame:
    """``by, date, trimp`` for every day from the first to the last."""
    return stretches(daily, by).select(*by, F.inline(filled(F.col("known"), F.col("before"))))


def smoothed(days: Column, atl: Column, ctl: Column, spans: tuple[int, int] = (S.SHORT_SPAN, S.LONG_SPAN)) -> Column:
    """Exponentially weighted means over an array of consecutive (date, trimp): each day
    moves the means ``atl`` and ``ctl`` of the day before by 2 / (span + 1); where these are
    null the first day's load starts both.

    The work is in proportion to the days: these are cut into steps, the means at
    each step's end come first, and the days of a step are gathered on their own.
    """
    a, b = (2.0 / (n + 1) for n in spans)
    means, row = "struct<atl:double,ctl:double>", "struct<date:date,trimp:double,atl:double,ctl:double>"

    def let(value: Column, body) -> Column:  # evaluates the value once
        return F.get(F.transform(F.array(value), body), 0)

    def moved(s, x):
        new = lambda rate, old: F.when(old.isNull(), x["trimp"]).otherwise(F.lit(1 - rate) * old + F.lit(rate) * x["trimp"])
        return new(a, s["atl"]).alias("atl"), new(b, s["ctl"]).alias("ctl")

    def gathered(part, start):
        seed = F.array(F.struct(F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("trimp"), start["atl"], start["ctl"]).cast(row))
        seen = F.aggregate(part, seed, lambda seen, x: F.concat(seen, F.array(F.struct(
            x["date"].alias("date"), x["trimp"].alias("trimp"), *moved(F.element_at(seen, -1), x)))))
        return F.slice(seen, 2, STEP)

    def scan(steps):
        first = F.array(F.struct(atl.cast("double").alias("atl"), ctl.cast("double").alias("ctl")).cast(means))
        starts = F.aggregate(steps, first, lambda s, part: F.concat(s, F.array(
            F.aggregate(part, F.element_at(s, -1), lambda m, x: F.struct(*moved(m, x))))))
        return let(starts, lambda at: F.flatten(F.transform(steps, lambda part, i: gathered(part, F.get(at, i)))))

    cut = lambda days: F.transform(F.sequence(F.lit(0), F.floor((F.size(days) - 1) / STEP).cast("int")), lambda i: F.slice(days, i * STEP + 1, F.lit(STEP)))
    return let(days, lambda days: let(cut(days), scan))


def atl_ctl(daily: DataFrame, by: tuple[str, ...] = ("athlete_id",), spans: tuple[int, int] = (S.SHORT_SPAN, S.LONG_SPAN),
            starts: DataFrame | None = None) -> DataFrame:
    """``by, date, trimp, atl, ctl`` for every day; athletes in ``starts(by, date, atl, ctl)`` go
    on from that day, whose row is not repeated."""
    known = stretches(daily, by, spans, starts)
    return known.select(*by, F.inline(smoothed(filled(F.col("known"), F.col("before")), F.col("atl"), F.col("ctl"), spans)))


def training_metrics(activities: DataFrame, by: tuple[str, ...] = ("athlete_id",)) -> DataFrame:
    """``by, date, trimp, atl, ctl, tsb, status``; no rows without dated activities.
    With ``by`` empty all activities are one athlete's."""
    if not by:
        return training_metrics(activities.withColumn("athlete_id", F.lit(0)), ("athlete_id",)).drop("athlete_id")
    return judged(atl_ctl(daily_load(activities, by), by))


def judged(means: DataFrame) -> DataFrame:
    """With the balance and its zone."""
    m = means.withColumn("tsb", F.col("ctl") - F.col("atl"))
    return m.withColumn("status", S.zone(F.col("tsb")))
