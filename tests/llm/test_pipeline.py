"""The stages of the corpus pipeline on planted cases."""

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, bytes string, uid long"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def row(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), "s", "b", 5)


def rows():
    out = [row(i, f"you foul idiot rotten {i}" if i % 2 else f"tea number {i} was good today {i * 7}", "abc"[i % 3]) for i in range(300)]
    text = " ".join(f"u{k}" for k in range(60))
    passage = " ".join(f"passage{k}" for k in range(50))
    out += [row(1000, text), row(1001, text), row(1002, text.replace("u59", "v")), row(1003, " ".join(f"b{k}" for k in range(60)) + " " + passage + "é."), row(1004, "quite other words " + passage + "é end")]
    return out + [row(2000, None), row(2001, ""), row(None, "clean words without an id"), row(2002, "first text of two"), row(2002, "and another text here"), row(2003, "same same", None), row(2003, "same same", None)]


def test_stages(spark, tmp_path):
    folder = tables(spark, tmp_path, rows())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = cp.materialize(cp.drop_toxic(spark, docs, folder))
    ids = [r.doc_id for r in clean.collect()]
    assert clean.columns == docs.columns and set(ids) >= {i for i in range(300) if not i % 2} and not any(i is not None and i < 300 and i % 2 for i in ids)
    whole = spark.createDataFrame(rows()[300:], SCHEMA)
    one = cp.materialize(cp.one_of_each_group(spark, whole, folder))
    assert one.columns == docs.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted(map(str, [1000, 1003, 1004, 2000, 2001, None, 2002, 2002, 2003]))
    unique = whole.where("doc_id < 2000")
    assert sorted(r.doc_id for r in cp.one_of_each_group(spark, unique, folder).collect()) == [1000, 1003, 1004]
    cut = cp.materialize(cp.cut_repeats(spark, one, folder))
    by = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and cut.count() == one.count()
    assert by[1004].text == "quite other words end"  # the blank before the passage and the é behind it repeat, too
    assert by[1003].text.endswith("passage49é.") and by[1004].n_chars == len(by[1004].text) and by[1004].uid == 5 and by[1004].bytes == "b"
    mixed = cp.materialize(cp.mix_sources(spark, cut, folder))
    assert mixed.columns == docs.columns and mixed.where("text is null").count() == 0
    packed = cp.pack_batches(spark, mixed, folder)
    assert packed.count() == mixed.count()


def test_whole_run_and_empty_tables(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "mixing", "packing"]
    out = cp.run(spark, tables(spark, tmp_path / "some", rows()))
    assert out.count() > 150 and out.where("n_tokens > bucket_len").count() == 0
    empty = tables(spark, tmp_path / "none", [])
    assert cp.run(spark, empty).collect() == []
