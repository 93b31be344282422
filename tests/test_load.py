import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stridewell.functions import scoring as S
from stridewell.operators import activities as A
from stridewell.operators import load as L
from stridewell.plans import views
from stridewell.schemas import RECORDS, SESSIONS

ALL = ["sport", "timestamp", "total_elapsed_time", "avg_heart_rate"]
DAY = {d: dt.datetime(2024, 3, d, 8) for d in range(1, 8)}


def session(name, sport, elapsed, hr, ts, seq=0, present=None, **more):
    return {"name": name, "seq": seq, "sport": sport, "sub_sport": None, "timestamp": ts, "total_elapsed_time": elapsed,
            "avg_heart_rate": hr, "total_distance": None, "total_calories": None, "present": present or ALL, **more}


GOLDEN = [
    session("a.fit", "running", 3600.0, 150.0, DAY[1]), session("b.fit", "cycling", 5400.0, None, DAY[1]),
    session("c.fit", "swimming", 1800.0, 0.0, DAY[3]), session("d.fit", "running", 7200.0, 165.0, DAY[6]),
    session("e.fit", "generic", 3600.0, 150.0, DAY[4]), session("f.fit", "cycling", 3600.0, 100.0, None)]
TRIMP = {"a.fit": 108.0, "b.fit": 90.0, "c.fit": 24.0, "d.fit": 237.6, "f.fit": 60.0}
METRICS = [
    (198.0, 198.0, 198.0, 0.0, "Neutral"),
    (0.0, 148.5, 188.79069767441862, 40.290697674418624, "Transition (Fitness Loss)"),
    (24.0, 117.375, 181.12601406165498, 63.751014061654985, "Transition (Fitness Loss)"),
    (0.0, 88.03125, 172.70154829134546, 84.67029829134546, "Transition (Fitness Loss)"),
    (0.0, 66.0234375, 164.66891813825964, 98.64548063825964, "Transition (Fitness Loss)"),
    (237.6, 108.917578125, 168.06106148066618, 59.14348335566618, "Transition (Fitness Loss)")]


@pytest.fixture(scope="module")
def golden(spark):
    return A.activities(spark.createDataFrame(GOLDEN, SESSIONS))


def test_trimp(golden):
    got = {r["name"]: r.trimp for r in golden.collect()}
    assert got.keys() == TRIMP.keys()
    for k, v in TRIMP.items():
        assert got[k] == pytest.approx(v)


def test_metrics(golden):
    got = L.training_metrics(golden, ()).orderBy("date").collect()
    assert [r.date.day for r in got] == [1, 2, 3, 4, 5, 6]
    for r, want in zip(got, METRICS):
        assert (r.trimp, r.atl, r.ctl, r.tsb) == pytest.approx(want[:4], abs=1e-9)
        assert r.status == want[4]


def test_no_dated_activity_gives_no_metrics(spark, golden):
    assert L.training_metrics(golden.where("timestamp is null"), ()).count() == 0


def test_one_day(spark, golden):
    (r,) = L.training_metrics(golden.where("name = 'a.fit'"), ()).collect()
    assert r.tsb == 0 and r.status == "Neutral" and r.atl == r.ctl == r.trimp


@pytest.mark.parametrize("span, want", [(7, [10, 7.5, 5.625, 9.21875]), (42, [10, 9.534883720930234, 9.091400757166037, 9.598777466135058])])
def test_smoothing(spark, span, want):
    days = [Row(athlete_id=1, date=dt.date(2024, 1, 1 + i), trimp=float(x)) for i, x in enumerate([10, 0, 0, 20])]
    df = L.atl_ctl(spark.createDataFrame(days), spans=(span, span + 1)).orderBy("date")
    got = df.collect()
    assert [r.atl for r in got] == pytest.approx(want, abs=1e-12)
    assert [r.ctl for r in got][1:] != pytest.approx(want[1:], abs=1e-6)  # another span must not match
    assert list(pd.Series([10.0, 0, 0, 20]).ewm(span=span, adjust=True).mean())[1:] != pytest.approx(want[1:], abs=1e-6)


def test_against_pandas(spark):
    r = np.random.default_rng(0)
    acts = [Row(athlete_id=int(a), timestamp=dt.datetime(2023, 1, 1) + dt.timedelta(days=int(d)), trimp=float(t))
            for a, d, t in zip(r.integers(0, 4, 300), r.integers(0, 400, 300), r.random(300) * 200)]
    got = L.training_metrics(spark.createDataFrame(acts)).toPandas()
    for a, own in pd.DataFrame([x.asDict() for x in acts]).groupby("athlete_id"):
        day = own.groupby(own.timestamp.dt.normalize()).trimp.sum()
        day = day.reindex(pd.date_range(day.index.min(), day.index.max()), fill_value=0)
        mine = got[got.athlete_id == a].sort_values("date")
        assert len(mine) == len(day)
        np.testing.assert_allclose(mine.atl, day.ewm(span=7, adjust=False).mean(), atol=1e-9)
        np.testing.assert_allclose(mine.ctl, day.ewm(span=42, adjust=False).mean(), atol=1e-9)


def test_nan_load_counts_as_missing(spark):
    acts = [Row(athlete_id=1, timestamp=DAY[1], trimp=math.nan), Row(athlete_id=1, timestamp=DAY[1], trimp=5.0), Row(athlete_id=1, timestamp=DAY[2], trimp=math.nan)]
    assert [r.trimp for r in L.daily_load(spark.createDataFrame(acts)).orderBy("date").collect()] == [5.0, 0.0]


@pytest.mark.parametrize("tsb, status", [
    (25.0001, "Transition (Fitness Loss)"), (25.0, "Freshness (Tapering/Race)"), (5.0001, "Freshness (Tapering/Race)"), (5.0, "Neutral"),
    (0.0, "Neutral"), (-10.0, "Neutral"), (-10.0001, "Optimal Training"), (-30.0, "Optimal Training"), (-30.0001, "High Risk (Overreaching)"),
    (math.nan, "High Risk (Overreaching)"), (None, "High Risk (Overreaching)")])
def test_zone(spark, tsb, status):
    assert spark.range(1).select(S.zone(F.lit(tsb).cast("double"))).first()[0] == status


def test_last_session_message_wins_even_with_null(spark):
    rows = [session("x.fit", "running", 3600.0, 150.0, DAY[1]), session("x.fit", None, None, None, None, seq=1, present=["avg_heart_rate"])]
    (r,) = A.activities(spark.createDataFrame(rows, SESSIONS)).collect()
    assert r.avg_heart_rate is None and r.duration_min == 60 and r.trimp == pytest.approx(72.0)


def test_missing_keys_default_to_zero(spark):
    (r,) = A.activities(spark.createDataFrame([session("x.fit", "cycling", None, None, DAY[1], present=["sport"])], SESSIONS)).collect()
    assert (r.duration_min, r.avg_heart_rate, r.trimp) == (0, 0, 0)


def record(idx, present=("power",), **values):
    return {**dict.fromkeys(RECORDS.names), "name": "x.fit", "idx": idx, "present": list(present), **values}


def test_sample_arrays_keep_gaps_and_order(spark):
    rows = [record(2, power=3.0), record(0, power=1.0), record(1, present=[])]
    (r,) = A.sample_arrays(spark.createDataFrame(rows, RECORDS)).collect()
    assert r.power == [1.0, None, 3.0] and r.cadence is None


def test_fallback_is_chosen_per_activity(spark):
    both = ("altitude", "enhanced_altitude")
    rows = [record(0, both, altitude=1.0, enhanced_altitude=10.0), record(1, both, altitude=2.0)]
    got = A.elevation(spark.createDataFrame(rows, RECORDS)).orderBy("idx").collect()
    assert [r.elevation for r in got] == [10.0, None]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.degrees(F.lit(2.0 ** 31))) == 180.0 and get(S.degrees(F.lit(536870912.0))) == 45.0
    assert get(S.kmh(F.lit(2.5))) == 9.0
    assert get(S.clock(F.lit(1500.0))) == "01:00:00"
    assert get(S.shown(F.lit(None).cast("double"), 1)) == "N/A" and get(S.shown(F.lit(2.5), 0)) == "3"
    assert get(S.file_name(F.lit("a/b/c.fit"))) == "c.fit"


def test_views(golden):
    assert [r["name"] for r in views.recent(golden).collect()] == ["d.fit", "c.fit", "a.fit"]
    assert views.single_activity(golden, "none").count() == 0
    both = views.analysis(golden)
    assert both.activities.columns == ["name", "activity_type", "sub_sport", "timestamp", "duration_min", "avg_heart_rate", "trimp"]
    assert both.metrics.select(F.min("date")).first()[0] == "2024-03-01"
    assert views.latest(L.training_metrics(golden.withColumn("athlete_id", F.lit(1)))).first().date == dt.date(2024, 3, 6)


def recurrence(loads, spans=(7, 42)):
    """Both means by the plain recurrence, a day at a time."""
    out, means = [], None
    for x in loads:
        means = [x, x] if means is None else [(1 - r) * m + r * x for m, r in zip(means, (2 / (n + 1) for n in spans))]
        out.append(tuple(means))
    return out


def walked(rows):
    """Dates, loads and means of every athlete of (athlete, date, load) by the recurrence."""
    want = {}
    for who in {r[0] for r in rows}:
        known = {d: x for w, d, x in rows if w == who}
        days = [min(known) + dt.timedelta(days=i) for i in range((max(known) - min(known)).days + 1)]
        loads = [known.get(d, 0.0) for d in days]
        want |= {(who, d): (x, *m) for d, x, m in zip(days, loads, recurrence(loads))}
    return want


def test_means_across_stretches_equal_the_recurrence(spark):
    start = dt.date(1969, 12, 1)  # before the first cut of stretches, which are at multiples of 4,096 days
    r = random.Random(2)
    rows = [(1, start + dt.timedelta(days=i), r.random() * 100) for i in range(0, 9000) if r.random() < 0.4]
    rows += [(2, start, 50.0), (2, start + dt.timedelta(days=20_000), 7.0), (2, start + dt.timedelta(days=20_001), 9.0)]  # whole stretches without a day
    rows += [(3, start + dt.timedelta(days=5000), 1.0)]
    rows += [(None, start + dt.timedelta(days=40 * i), float(i)) for i in range(200)]  # activities of nobody are one athlete's
    df = spark.createDataFrame(rows, "athlete_id int, date date, trimp double").repartition(7)
    want = walked(rows)
    got = L.atl_ctl(df).collect()
    assert len(got) == len(want)
    for g in got:
        load, atl, ctl = want[g.athlete_id, g.date]
        assert g.trimp == load and abs(g.atl - atl) <= 1e-10 and abs(g.ctl - ctl) <= 1e-10
    assert {(g.athlete_id, g.date): g.trimp for g in L.dense_daily(df).collect()} == {k: v[0] for k, v in want.items()}


def test_means_within_a_stretch_are_the_recurrence_to_the_bit(spark):
    start, r = dt.date(2024, 1, 1), random.Random(1)
    rows = [(1, start + dt.timedelta(days=i), r.random() * 100) for i in range(500) if i % 3]
    got = L.atl_ctl(spark.createDataFrame(rows, "athlete_id int, date date, trimp double")).collect()
    assert {(g.athlete_id, g.date): (g.trimp, g.atl, g.ctl) for g in got} == walked(rows)


def test_time_is_in_proportion_to_the_days(spark):
    import time

    def run(n):
        days = spark.range(n).select(F.lit(1).alias("athlete_id"), F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                     (F.col("id") % 100).cast("double").alias("trimp"))
        began = time.time()
        got = L.atl_ctl(days).agg(F.count("*"), F.max("date")).first()
        assert got[0] == n
        return time.time() - began

    run(2000)
    short, long = run(20_000), run(100_000)
    assert long < 5 * short + 10  # by the square it would be 25 times


def test_arrays_in_pieces_are_the_whole_arrays(spark):
    r = random.Random(9)
    rows = [("hot", i, None if r.random() < 0.3 else float(i), ["power"]) for i in range(5000)]
    rows += [(f"n{k}", i, None, []) for k in range(40) for i in range(r.randrange(1, 12))] + [(None, i, 1.0, ["power"]) for i in range(7)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, idx int, power double, present array<string>").repartition(6)
    whole = {w.name: w.power for w in A.sample_arrays(df, ("power",)).collect()}
    for chunk in (1, 64, 10_000):
        got = {}
        for p in A.sample_chunks(df, ("power",), chunk).orderBy("chunk").collect():
            assert p.chunk == len(got.setdefault(p["name"], []))
            got[p["name"]].append(p.power)
        assert {n: None if p[0] is None else [x for part in p for x in part] for n, p in got.items()} == whole
        assert all(len(part) == chunk for p in got.values() for part in p[:-1] if part is not None)


def test_one_scan_serves_both_sides_of_the_scan_over_days(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).select((F.col("id") % 5).alias("athlete_id"), F.timestamp_seconds(F.col("id") * 90_000).alias("timestamp"), F.lit(1.0).alias("trimp")).write.parquet(path)
    m = L.training_metrics(spark.read.parquet(path))
    m.collect()
    plan = m._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
