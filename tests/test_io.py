import datetime as dt
import json
import struct

import pytest
from pyspark.sql import DataFrameWriter, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridewell import sinks
from stridewell.sources import exports, fit
from stridewell.streaming import refresh

START = dt.datetime(2024, 3, 1, 8)
SECONDS = int((START - fit.EPOCH).total_seconds())


def message(local, number, fields, order="<"):
    """A definition and a data message; fields: (number, struct code, base type, value)."""
    head = bytes([0x40 | local, 0, 1 if order == ">" else 0]) + struct.pack(order + "HB", number, len(fields))
    head += b"".join(bytes([f, struct.calcsize(c), b]) for f, c, b, _ in fields)
    return head + bytes([local]) + b"".join(struct.pack(order + c, v) for _, c, _, v in fields)


def fit_file(*parts):
    body = b"".join(parts)
    data = struct.pack("<BBHI4sH", 14, 16, 2000, len(body), b".FIT", 0) + body
    return data + struct.pack("<H", fit.crc(data))


WORKOUT = fit_file(
    message(0, 20, [(253, "I", 0x86, SECONDS), (3, "B", 2, 140), (7, "H", 0x84, 200), (2, "H", 0x84, 2600)]),
    message(1, 20, [(253, "I", 0x86, SECONDS + 1), (3, "B", 2, 255), (6, "H", 0x84, 2500)], ">"),
    bytes([0x80 | 1 << 5 | (SECONDS + 2) & 0x1F]) + struct.pack(">IBH", SECONDS + 2, 150, 3000),
    message(2, 18, [(253, "I", 0x86, SECONDS), (5, "B", 0, 1), (7, "I", 0x86, 3_600_000), (16, "B", 2, 150), (9, "I", 0x86, 1_000_000)]))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.fit").write_bytes(WORKOUT)
    (tmp_path / "broken.fit").write_bytes(WORKOUT[:60])
    (tmp_path / "b.FIT").write_bytes(WORKOUT)
    return str(tmp_path)


def check(sessions, records):
    (s,) = sessions.collect()
    assert (s["name"], s.sport, s.total_elapsed_time, s.avg_heart_rate, s.total_distance, s.timestamp) == ("a.fit", "running", 3600.0, 150.0, 10_000.0, START)
    r = records.orderBy("idx").collect()
    assert [x.heart_rate for x in r] == [140, None, 150]
    assert (r[0].altitude, r[0].power, r[1].speed, r[1].power) == (20.0, 200.0, 2.5, None)
    assert "heart_rate" in r[1].present and "power" not in r[1].present


def test_fit_source(spark, folder):
    fit.register(spark)
    read = lambda kind: spark.read.format("fit").option("message", kind).option("onError", "skip").load(folder)
    check(read("session"), read("record"))
    with pytest.raises(Exception):
        spark.read.format("fit").load(folder).collect()


def test_checksum_and_chained_files(spark, tmp_path):
    assert fit.crc(b"123456789") == 0xBB3D  # the check value of this CRC
    (tmp_path / "a.fit").write_bytes(WORKOUT + WORKOUT)
    (tmp_path / ".hidden.fit").write_bytes(WORKOUT)
    assert [r.seq for r in fit.read_fit(spark, str(tmp_path)).where("name = 'a.fit'").collect()] == [0, 1]
    assert fit.read_fit(spark, str(tmp_path), "record").groupBy("name").count().orderBy("name").collect() == [(".hidden.fit", 3), ("a.fit", 6)]
    for at, told in ((40, "checksum of the file"), (len(WORKOUT) - 1, "checksum of the file"), (8, "not a FIT file")):
        bad = bytearray(WORKOUT)
        bad[at] ^= 1
        with pytest.raises(ValueError, match=told):
            list(fit.messages(bytes(bad), 18))
    bad = bytearray(fit.encode([("session", {"sport": "running"})]))
    bad[2] ^= 1
    with pytest.raises(ValueError, match="header"):
        list(fit.messages(bytes(bad), 18))
    with pytest.raises(ValueError, match="follows"):
        list(fit.messages(WORKOUT + b"junk" * 9, 18))
    (tmp_path / "b.fit").write_bytes(bytes(bad))
    assert fit.read_fit(spark, str(tmp_path), on_error="skip").count() == 3
    with pytest.raises(Exception, match="b.fit"):
        fit.read_fit(spark, str(tmp_path)).collect()
    assert fit.read_fit(spark, str(tmp_path / "nowhere")).count() == 0


def test_tables_to_files_and_back(spark, tmp_path):
    at = lambda n: START + dt.timedelta(seconds=n)
    sessions = spark.createDataFrame([
        dict(name="x.fit", seq=1, sport="cycling", sub_sport="road", timestamp=at(9), total_elapsed_time=12.345, avg_heart_rate=None, total_distance=1.5,
            total_calories=None, present=["sport", "sub_sport", "timestamp", "total_elapsed_time", "avg_heart_rate", "total_distance"]),
        dict(name="x.fit", seq=0, sport="77", sub_sport=None, timestamp=at(8), total_elapsed_time=None, avg_heart_rate=60.0, total_distance=None,
            total_calories=300.0, present=["sport", "timestamp", "avg_heart_rate", "total_calories"])], fit.SESSIONS)
    sample = {m: None for m in fit.METRICS} | {"timestamp": None}
    records = spark.createDataFrame([
        dict(sample, name="x.fit", idx=5, timestamp=at(2), power=250.0, heart_rate=141, altitude=-12.0, position_lat=-5.0, temperature=-3.0,
                            present=["timestamp", "power", "heart_rate", "altitude", "position_lat", "temperature"]),
        dict(sample, name="x.fit", idx=7, timestamp=at(3), power=None, present=["timestamp", "power"]),
        dict(sample, name="x.fit", idx=3, timestamp=at(1), speed=3.25, enhanced_speed=70.5, present=["timestamp", "speed", "enhanced_speed"]),
        dict(sample, name="y.fit", idx=0, present=[])], fit.RECORDS)
    fit.register(spark)
    folder = str(tmp_path / "out")
    fit.write_fit(sessions, records, folder)
    key = lambda r: (r["name"], r.get("idx", r.get("seq")))
    got = sorted((r.asDict() for r in fit.read_fit(spark, folder, "record").collect()), key=key)
    want = sorted((r.asDict() for r in records.collect()), key=key)
    assert [g | {"idx": None} for g in got] == [w | {"idx": None, "present": sorted(w["present"])} for w in want]
    back = sorted((r.asDict() for r in fit.read_fit(spark, folder).collect()), key=key)
    assert back == [w | {"present": sorted(w["present"])} for w in sorted((r.asDict() for r in sessions.collect()), key=key)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.fit", "y.fit"]  # no staging is left
    fit.write_fit(sessions.where("false"), records.where("name = 'y.fit'").withColumn("others", F.create_map(F.lit("field_200"), F.lit(1e9))), folder, "overwrite")
    (r,) = fit.read_fit(spark, folder, "record", others=True).collect()
    assert (r["name"], r["others"]) == ("y.fit", {"field_200": 1e9})
    for bad in (dict(name="z", present=[]), dict(name="z.fit", heart_rate=255, present=["heart_rate"]), dict(name="z.fit", watts=1.0, present=["watts"])):
        with pytest.raises(Exception, match="no name|does not fit|no field number"):
            fit.write_fit(sessions.where("false"), spark.createDataFrame([sample | dict(idx=0) | bad], fit.RECORDS), folder)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["y.fit"]


def test_fit_by_binary_rows(spark, folder):
    check(fit.decode(spark, folder), fit.decode(spark, folder, "record"))


def test_messages_in_columns_are_those_one_by_one():
    """All types, both orders, fields that repeat or are no numbers of their name, developer
    fields, compressed headers, chained files; batches of many files keep their order."""
    codes = [(b, c) for b, (c, _) in fit.TYPES.items()]
    parts = [message(i % 16, 20, [(253, "I", 0x86, SECONDS + i), (3 if i % 3 else 7, codes[i % 16][1], codes[i % 16][0], 7 + i % 90), (200 + i % 5, "d", 0x89, i / 7),
                                  (201, "f", 0x88, float("nan") if i % 2 else 2.5), (2, "H", 0x84, 0xFFFF - i % 2)], "<>"[i % 2]) for i in range(48)]
    parts.append(bytes([0x69, 0, 0]) + struct.pack("<HB", 20, 1) + bytes([6, 2, 0x84, 1, 0, 3, 0, 9]) + struct.pack("<H", 4000) + b"abc" + bytes([9]) + struct.pack("<H", 1) + b"def")
    parts += [message(1, 18, [(253, "I", 0x86, SECONDS), (5, "B", 0, k), (6, "H", 0x84, 7), (7, "I", 0x86, 0xFFFFFFFF), (7, "I", 0x86, 5)][:5 - k % 2]) for k in (1, 2, 77)]
    files = {"whole.fit": fit_file(*parts), "two.fit": fit_file(*parts[:3]) + fit_file(*parts[16:20]), "packed.fit": WORKOUT, "none.fit": fit_file(), "last.fit": fit_file(parts[-2], parts[0])}
    for n, part in enumerate(parts):
        files[f"{n}.fit"] = fit_file(part)
    for kind in ("session", "record"):
        for others in (False, True):
            want = [r for name, data in files.items() for r in fit.rows_of(name, data, kind, others)]
            got = [tuple(r.values()) for b in fit.batches_of(((f"/x/{n}", lambda d=d: d) for n, d in files.items()), kind, others, False) for r in b.to_pylist()]
            assert [(*r[:-1], dict(r[-1])) if others else r for r in got] == want
    short = fit_file(parts[0][:-1])
    with pytest.raises(ValueError, match="/y/b.fit: a message ends late"):
        list(fit.batches_of([("/y/b.fit", lambda: short)], "record", False, False))
    left = fit.batches_of([("a.fit", lambda: parts[0]), ("b.fit", lambda: short), ("c.fit", lambda: files["0.fit"])], "record", False, True)
    assert [n for b in left for n in b["name"].to_pylist()] == ["c.fit"]


def test_rows_in_columns_are_encoded_as_one_by_one(spark, tmp_path):
    """A layout that comes again needs no second definition; more than 16 do; checksums are by words."""
    names = ["timestamp", *sorted(set(fit.METRICS) - {"watts"})]
    rows = [{m: None for m in fit.METRICS} | dict(
        name=f"{i // 60}.fit", idx=i, timestamp=START + dt.timedelta(microseconds=1_500_000 * i), power=i + 0.5, speed=i / 7, heart_rate=i % 200 if i % 5 else None, temperature=-3.4,
        present=[m for k, m in enumerate(names) if (i % 4 if i < 120 else i % 60) >> k % 6 & 1], others={f"field_{200 + i % 2}": i / 3} if i % 3 else None) for i in range(240)]
    kinds = fit.schema_of("record", True)
    df = spark.createDataFrame(rows, kinds)
    fit.register(spark)
    fit.write_fit(spark.createDataFrame([], fit.SESSIONS), df, str(tmp_path / "out"))
    for k in range(4):
        data = (tmp_path / "out" / f"{k}.fit").read_bytes()
        mine = [fit.values_of(r) for r in rows[60 * k:60 * k + 60]]
        alone = [fit.Encoder().message(20, m) for m in mine]
        assert list(fit.messages(data, 20, True)) == [m for one in alone for m in fit.own_messages(fit_file(one), 20, True)]
        assert len(data) == len(fit.encode(("record", m) for m in mine))
        if k < 2:  # few layouts, each defined once
            told = lambda several: sum(6 + 3 * len(m) for m in several)
            assert len(data) == 16 + sum(map(len, alone)) - told(mine) + told({tuple(m) for m in mine})
    assert fit.crc(b"12345678") == fit.crc(b"5678", fit.crc(b"1234")) == fit.crc(b"45678", fit.crc(b"123"))


def test_json_sink_and_export(spark, tmp_path):
    df = spark.createDataFrame([Row(id=1, name="x", distance=None), Row(id=2, name=None, distance=2.5)], "id long, name string, distance double")
    sinks.write_json(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "array.json").write_text(json.dumps([{"id": 7, "name": "run", "elapsed_time": 60.5, "other": 1}], indent=2))
    (r,) = exports.read_export(spark, str(tmp_path / "array.json")).collect()
    assert (r.id, r.name, r.elapsed_time, r.type) == (7, "run", 60.5, None)
    assert exports.no_activities(spark).count() == 0
    assert list(sinks.payload(df.orderBy("id")))[0] == {"id": 1, "name": "x", "distance": None}


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    kinds, path = "id long, name string, deep struct<x:array<struct<k:int>>>, at timestamp, n double", str(tmp_path / "all.json")
    df = spark.range(5000).selectExpr("id", """if(id % 5 = 0, null, concat('},{"[ \\\\', id, '\\n"]\\u2028')) as name""",
                                      "named_struct('x', array(named_struct('k', int(id)), named_struct('k', 1))) as deep",
                                      "timestamp_millis(id * 3600001) as at", "if(id % 3 = 0, double('nan'), id / 8) as n").repartitionByRange(5, "id")
    sinks.write_json_file(df, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = exports.read_export(spark, path, T.StructType.fromDDL(kinds))
        assert got.rdd.getNumPartitions() > 4
        whole = spark.read.schema(kinds).option("multiLine", True).json(path)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.exceptAll(whole).isEmpty() and got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for text, ids in (('[\n{"id": 1}, {"id": 2},\r\n {"id": 3, "deep": {"x": [{"k": 1}, {"k": 2}]}}\n]', [1, 2, 3]), ("[]", []), ('[{"id": 1}]', [1]), ("[\n]\n", []),
                      ('[\n{"id": 1, "deep": {"x": [{"k": 1},\n{"k": 2}]}},\n{"id": 4}\n]', [1, 4]), ('[\n  {\n    "id": 5\n  }\n]', [5])):
        (tmp_path / "small.json").write_text(text)
        assert [r.id for r in exports.read_export(spark, str(tmp_path / "small.json"), T.StructType.fromDDL(kinds)).collect()] == ids, text


def test_publish(spark):
    df = sinks.publish(spark.range(3), "kept")
    assert spark.table("kept").count() == 3
    sinks.withdraw(df, "kept")
    assert not spark.catalog.tableExists("kept")


def test_daily_stream(spark, tmp_path):
    rows = [Row(athlete_id=1, timestamp=START + dt.timedelta(days=d), trimp=float(d)) for d in (0, 0, 1, 30)]
    spark.createDataFrame(rows, "athlete_id int, timestamp timestamp_ntz, trimp double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("athlete_id int, timestamp timestamp_ntz, trimp double").parquet(str(tmp_path / "in"))
    q = refresh.append_daily(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r.date.day, r.trimp) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0.0), (2, 1.0)}


def test_json_arrays_are_whole_and_indented(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "if(id = 2, null, concat('a \"q\", ', id)) as name").repartition(3)
    sinks.write_json_array(df, str(tmp_path / "out"))
    parts = [json.loads(f.read_text() or "[]") for f in (tmp_path / "out").glob("part-*")]
    assert sorted((r["id"], r["name"]) for p in parts for r in p) == [(i, None if i == 2 else f'a "q", {i}') for i in range(5)]
    assert any("\n  {" in f.read_text() for f in (tmp_path / "out").glob("part-*"))
    sinks.write_json_array(df.limit(0), str(tmp_path / "none"))
    assert all(json.loads(f.read_text() or "[]") == [] for f in (tmp_path / "none").glob("part-*"))


def test_shared_folder(spark):
    from stridewell import scratch

    own = scratch.shared_dir(spark)
    assert scratch.shared_dir(spark) == own and scratch.fresh_path(spark).startswith(own)

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "local-cluster[3,2,1024]"})
    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster)


def test_fit_writes_only_columns_that_are_there(spark, tmp_path, monkeypatch):
    """What no table has costs no column, and is still written as missing where ``present`` names it."""
    seen, save = [], DataFrameWriter.save
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, *a, **k: (seen.append(self._df.columns), save(self, *a, **k))[1])
    records = spark.createDataFrame([("a.fit", 0, 2.5, ["speed", "power", "timestamp"])], "name string, idx int, speed double, present array<string>")
    sessions = spark.createDataFrame([("a.fit", 0, 7.0, ["sport", "total_distance"])], "name string, seq int, total_distance double, present array<string>")
    fit.register(spark)
    fit.write_fit(sessions, records, str(tmp_path / "out"))
    assert sorted(seen[0]) == sorted(["name", "message", "present", "others", "speed", "total_distance"])
    r, s = (fit.read_fit(spark, str(tmp_path / "out"), kind).first() for kind in ("record", "session"))
    assert (r.speed, r.power, r.timestamp, r.present) == (2.5, None, None, ["power", "speed", "timestamp"])
    assert (s.sport, s.total_distance, s.present) == (None, 7.0, ["sport", "total_distance"])
