"""Refreshed results against results of the whole input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stridewell.operators import load as L
from stridewell.plans.store import MetricsStore

SCHEMA = "athlete_id int, timestamp timestamp_ntz, trimp double"


def acts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def same(store, spark, rows):
    want = {(r.athlete_id, r.date): (r.trimp, r.atl, r.ctl, r.tsb, r.status) for r in L.training_metrics(acts(spark, rows)).collect()}
    got = {(r.athlete_id, r.date): (r.trimp, r.atl, r.ctl, r.tsb, r.status) for r in store.metrics().collect()}
    assert got.keys() == want.keys() and store.metrics().count() == len(want)
    for k, w in want.items():
        assert got[k][:4] == pytest.approx(w[:4], abs=1e-9) and got[k][4] == w[4]
    last = {r.athlete_id: (r.date, r.atl) for r in store.latest().collect()}
    assert last.keys() == {a for a, _ in want} and all(d == max(x for b, x in want if b == a) and abs(v - want[a, d][1]) < 1e-9 for a, (d, v) in last.items())


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("part-*")}


def test_increments_equal_the_whole_run(spark, tmp_path):
    r, start = random.Random(4), dt.datetime(2023, 11, 1, 9)
    row = lambda who, day, load=None: (who, start + dt.timedelta(days=day, hours=r.randrange(8)), r.random() * 90 if load is None else load)
    first = [row(a, d) for a in (1, 2, 3, None) for d in range(0, 70, 3)]
    on_time = [row(1, 75), row(2, 69 + 40), row(4, 80)]            # after a gap, after months, someone new
    late = [row(3, 20), row(3, 20), row(2, 5), row(1, -30), (None, start, None), (5, None, 3.0)]  # in between, before the first day, no load, no day
    store, all_rows = MetricsStore(spark, str(tmp_path / "s")), []
    assert store.metrics() is None
    for i, rows in enumerate((first, on_time, late)):
        store.apply(acts(spark, rows), i)
        all_rows += rows
        same(store, spark, all_rows)
        assert not (tmp_path / "s" / "_pending").exists()
    store.apply(acts(spark, late), 2)  # again: nothing counts twice
    same(store, spark, all_rows)
    extra = row(1, 90)
    store.apply(acts(spark, late[:2] + [extra]), 2)  # other contents: the batch is replaced
    same(store, spark, first + on_time + late[:2] + [extra])
    store.apply(acts(spark, [row(7, 3)]), 1)  # days and athletes go with the batch that had them
    same(store, spark, first + late[:2] + [extra] + [x for x in store_rows(store)])
    store.apply(acts(spark, []), 9)


def store_rows(store):
    """The one row of athlete 7."""
    r = store.metrics().where("athlete_id = 7").first()
    return [(7, dt.datetime.combine(r.date, dt.time()), r.trimp)]


def test_only_later_months_are_written(spark, tmp_path):
    start = dt.datetime(2023, 1, 5)
    store = MetricsStore(spark, str(tmp_path))
    store.apply(acts(spark, [(a, start + dt.timedelta(days=d), 10.0) for a in (1, 2) for d in range(0, 120, 2)]), 0)
    before = files(tmp_path / "metrics")
    store.apply(acts(spark, [(1, dt.datetime(2023, 5, 20), 5.0)]), 1)
    after = files(tmp_path / "metrics")
    untouched = {p for p in before if after.get(p) == before[p]}
    assert {p.split("month=")[1][:7] for p in untouched} == {"2023-01", "2023-02", "2023-03", "2023-04"}
    assert store.metrics().where("athlete_id = 2").count() == 119


def test_a_refresh_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(days=d), 10.0 + d) for d in range(30)]
    store = MetricsStore(spark, str(tmp_path / "s"))
    store.apply(acts(spark, rows[:10]), 0)
    publish, calls = MetricsStore.publish, []

    def broken(self):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        publish(self)
    monkeypatch.setattr(MetricsStore, "publish", broken)
    with pytest.raises(RuntimeError):
        store.apply(acts(spark, rows[10:20]), 1)
    monkeypatch.setattr(MetricsStore, "publish", publish)
    assert store.metrics().count() == 10
    store.apply(acts(spark, rows[20:]), 2)
    same(store, spark, rows)


def test_stream_keeps_the_store_current(spark, tmp_path):
    from stridewell.streaming.refresh import refresh_store

    rows = [(i % 4, dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 50), float(i)) for i in range(90)]
    store = MetricsStore(spark, str(tmp_path / "s"))
    for part in (rows[:40], rows[40:]):
        acts(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        refresh_store(stream, store, str(tmp_path / "cp")).awaitTermination(300)
    same(store, spark, rows)
