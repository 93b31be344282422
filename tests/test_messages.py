"""Key unions, merged maps, weights by date, rejects."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridewell.operators import messages as M
from stridewell.operators import validate as V
from stridewell.operators import weights as W


def test_union_of_keys_builds_the_schema(spark):
    rows = [("a", {"power": "1", "hr": "120.5", "ok": "true"}), ("b", {"power": "7", "new": None, "note": "x1"}), ("c", {}), ("d", None), ("e", {"hr": "1e3", "Name": "n"})]
    df = spark.createDataFrame(rows, "name string, m map<string,string>").repartition(3)
    keys = M.found_keys(df, "m")
    assert [(f.name, f.dataType.simpleString()) for f in keys] == [("Name", "string"), ("hr", "double"), ("new", "string"), ("note", "string"), ("ok", "boolean"), ("power", "bigint")]
    wide = M.widen(df, "m")
    assert wide.columns == ["name", "m_Name", "hr", "new", "note", "ok", "power"]
    assert {r[0]: tuple(r)[1:] for r in wide.collect()} == {
        "a": (None, 120.5, None, None, True, 1), "b": (None, None, None, "x1", None, 7), "c": (None,) * 6, "d": (None,) * 6, "e": ("n", 1000.0, None, None, None, None)}
    assert M.found_keys(df.where("false"), "m") == T.StructType([]) and M.widen(df.where("false"), "m").columns == ["name"]
    with pytest.raises(ValueError):
        M.found_keys(df, "m", most=5)


def test_a_later_key_wins(spark):
    rows = [(1, [("a", 1), ("b", 2), ("a", None), (None, 5)], {"x": 1, "a": 9}), (2, [], None), (3, None, {"z": None}), (4, [("a", 3)], {"a": None})]
    df = spark.createDataFrame(rows, "id int, e array<struct<key:string,value:int>>, right map<string,int>")
    got = {r.id: (r.m, r.both) for r in df.select("id", M.last_wins(F.col("e")).alias("m"), M.merged(M.last_wins(F.col("e")), F.col("right")).alias("both")).collect()}
    assert got == {1: ({"a": None, "b": 2}, {"b": 2, "x": 1, "a": 9}), 2: ({}, {}), 3: (None, {"z": None}), 4: ({"a": 3}, {"a": None})}


def test_fold_of_maps_is_the_dict_update(spark):
    r, rows, want = random.Random(1), [], {}
    for i in range(200):
        name, own = f"f{r.randrange(6)}", {f"k{r.randrange(5)}": r.choice([None, 1, 2, 3]) for _ in range(r.randrange(4))}
        rows.append((name, i, own))
        if own:
            want.setdefault(name, {}).update(own)
    got = M.fold_maps(spark.createDataFrame(rows, "name string, seq int, m map<string,int>").repartition(5), "name", "seq", "m")
    assert {r.name: r.m for r in got.collect()} == want


@pytest.mark.parametrize("small", [W.SMALL, 0])
def test_weights_change_with_the_day(spark, small):
    r = random.Random(7)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    table = [(s, day(r.randrange(700)), r.choice([0.5, 1.0, 1.5])) for s in ("run", "ride", "run", "swim") for _ in range(9)]
    table += [("run", day(40), 2.0), ("run", day(40), 3.0), (None, day(0), 9.0), ("run", None, 9.0), ("run", day(50), None)]
    acts = [(i, r.choice(["run", "ride", "swim", "row", None]), None if i % 17 == 0 else dt.datetime.combine(day(r.randrange(-20, 800)), dt.time(23, 59)), "x") for i in range(300)]
    acts += [(i, "run", dt.datetime.combine(day(40), dt.time()), "x") for i in (900, 900)]
    got = W.weigh(spark.createDataFrame(acts, "id int, activity_type string, timestamp timestamp_ntz, sport string"),
                  spark.createDataFrame(table, "sport string, valid_from date, weight double"), small=small)
    known = [t for t in table if None not in t]

    def want(kind, at):
        own = sorted((d, w) for s, d, w in known if s == kind and at is not None and d <= at.date())
        return own[-1][1] if own else None
    assert got.columns == ["id", "activity_type", "timestamp", "sport", "weight"]
    assert sorted(map(str, ((g.id, g.weight) for g in got.collect()))) == sorted(map(str, ((a[0], want(a[1], a[2])) for a in acts)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in plan) == bool(small)
    nothing = spark.createDataFrame([], "sport string, valid_from date, weight double")
    assert W.weigh(got.drop("weight"), nothing, small=small).where("weight is not null").count() == 0


def test_rejects_have_reasons(spark):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("hr", T.IntegerType()), T.StructField("at", T.DateType()), T.StructField("gone", T.DoubleType())])
    rows = [("1", "120", "2024-01-01", "k"), ("x", "", "2024-13-01", "k"), (None, None, None, "k"), ("4", "12.7", None, None), ("5", "99999999999", "2024-02-02", "k")]
    v = V.validate(spark.createDataFrame(rows, "id string, hr string, at string, other string"), schema, required=("at",))
    assert [tuple(r) for r in v.good.collect()] == [(1, 120, dt.date(2024, 1, 1), None)]
    got = {r.row: r.reasons for r in v.rejects.collect()}
    assert got == {'{"id":"x","hr":"","at":"2024-13-01","other":"k"}': ["id: no bigint", "hr: no int", "at: no date"],
                   '{"id":null,"hr":null,"at":null,"other":"k"}': ["id: missing", "at: missing"],
                   '{"id":"4","hr":"12.7","at":null,"other":null}': ["hr: no int", "at: missing"],
                   '{"id":"5","hr":"99999999999","at":"2024-02-02","other":"k"}': ["hr: no int"]}
    v.all.write.format("noop").mode("overwrite").save()
    assert v.counts.get == {"rows": 5, "rejects": 4, "rejects_id": 2, "rejects_hr": 3, "rejects_at": 3, "rejects_gone": 0}
