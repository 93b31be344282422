"""Single files, look-up tables, pages of rows, errors."""

import json

import pytest
from pyspark.sql import functions as F

from stridewell import sinks
from stridewell.plans import views


def test_one_array_in_one_file(spark, tmp_path):
    path = tmp_path / "all.json"
    df = spark.range(1000).selectExpr("id", "if(id = 2, null, concat('a \"q\",\\n', id)) as name", "named_struct('x', array(id)) as deep").repartitionByRange(7, "id")
    sinks.write_json_file(df, str(path))
    got = json.loads(path.read_text())
    assert [r["id"] for r in got] == list(range(1000)) and got[2]["name"] is None and got[3] == {"id": 3, "name": 'a "q",\n3', "deep": {"x": [3]}}
    assert path.read_text().startswith('[\n  {"id":0') and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.json"]
    sinks.write_json_file(df.where("id in (3, 990)"), str(path))  # most parts are empty
    assert [r["id"] for r in json.loads(path.read_text())] == [3, 990]
    assert spark.read.option("multiLine", True).schema(df.schema).json(str(path)).count() == 2
    sinks.write_json_file(df.where("false"), str(path))
    assert json.loads(path.read_text()) == []


def read_rows(df):
    """Rows that the scan gave on, after a run."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "Scan" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        for holder in ("executedPlan", "inputPlan", "plan"):
            if node.nodeName() == "AdaptiveSparkPlan" and holder == "executedPlan":
                walk(node.executedPlan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
    walk(plan)
    return sum(found)


def test_look_up_reads_few_row_groups(spark, tmp_path):
    n = 200_000
    df = spark.range(n).select(F.concat(F.lit("e"), F.col("id") * 2, F.lit(".fit")).alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("load"))
    sinks.write_lookup(df, "looked_up", str(tmp_path / "t"), "name", buckets=4, group_bytes=64 << 10)
    try:
        found = sinks.look_up(spark, "looked_up", "name", "e1000.fit")
        assert [r.name for r in found.collect()] == ["e1000.fit"]
        assert 0 < read_rows(found) < n / 20
        absent = [read_rows(sinks.look_up(spark, "looked_up", "name", f"e{k}.fit")) for k in (1001, 30_001, 77_777, 199_999)]
        assert sum(absent) < n / 100  # odd names lie between the others: only bloom filters tell
        assert sinks.look_up(spark, "looked_up", "name", "e0.fit", "e2.fit", "e3.fit", "none").count() == 2
    finally:
        spark.sql("drop table looked_up")


def test_pages_of_rows(spark):
    df = spark.range(25).selectExpr("if(id = 7, null, id) as id", "array(id) as v").repartition(4)
    pages = list(sinks.payload_pages(df, "id", 10))
    assert [len(p) for p in pages] == [10, 10, 4] and [r["id"] for p in pages for r in p] == [i for i in range(25) if i != 7]
    assert list(sinks.payload_pages(df.where("id < 0"), "id", 10)) == [] and [len(p) for p in sinks.payload_pages(df.where("id < 7"), "id", 7)] == [7]


def test_no_activity_is_an_error(spark):
    df = spark.createDataFrame([("a.fit", 1.0, 2.0)], "name string, timestamp double, trimp double")
    assert views.activity_or_error(df, "a.fit")["trimp"] == 2.0
    with pytest.raises(LookupError, match="b.fit"):
        views.activity_or_error(df, "b.fit")
