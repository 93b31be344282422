"""ARC and WARC archives: round trips, foreign files, and the types of equal payloads."""

import gzip
import hashlib

import pytest

from stridewell.llm import archives as W

SCHEMA = "page_id long, url string, html string, digest string, size int"
TOLD = b"1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n\n"
BLOCK = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>\n\xff!"
OLD = (b"filedesc://old.arc 0.0.0.0 19961225 text/plain %d\n" % len(TOLD) + TOLD
       + b"http://a.example/a b 1.2.3.4 19961225103040 text/html %d\n" % len(BLOCK) + BLOCK + b"\ndns:a.example 1.2.3.4 1997 text/dns 7\na 1 A x\n")


def test_versions_headers_and_lengths():
    head, first, second = list(W.arc_records(OLD))
    assert head[1]["content-type"] == "text/plain" and first[1]["url"] == "http://a.example/a b" and first[2].endswith(b"<p>\n\xff!")
    assert second[1]["url"] == "dns:a.example" and second[2] == b"a 1 A x"
    line = b"2 0 x\n" + W.ARC_FIELDS[2].encode() + b"\n\n"
    new = b"filedesc://n.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 n.arc %d\n" % len(line) + line
    new += b"http://b/ 5.6.7.8 20010203040506 text/html 404 abc - 99 n.arc 3\n\n\n\n\n"
    (_, f, block), = list(W.arc_records(new))[1:]
    assert (f["result-code"], f["checksum"], f["offset"], block) == ("404", "abc", "99", b"\n\n\n")
    assert len(list(W.arc_records(gzip.compress(OLD[:100]) + gzip.compress(OLD[100:])))) == 3  # of many members
    assert list(W.arc_records(b"")) == []
    for broken in (OLD[:-5], OLD.replace(b"text/html 47", b"text/html x"), gzip.compress(OLD)[:-20], OLD.replace(b"text/html 47", b"text/html 41")):
        with pytest.raises(ValueError):
            list(W.arc_records(broken))


def test_dates():
    assert W.iso_date("19961225103040") == "1996-12-25T10:30:40Z" and W.iso_date("19961225") == "1996-12-25T00:00:00Z"
    assert W.iso_date("1997") == "1997-01-01T00:00:00Z" and W.iso_date("200112") == "2001-12-01T00:00:00Z" and W.iso_date("x") == "1970-01-01T00:00:00Z"


def test_foreign_archive_becomes_warc(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.arc.gz").write_bytes(gzip.compress(OLD))
    records = W.read_arc(spark, str(tmp_path / "in"))
    W.write_warc(records, str(tmp_path / "out"), packed=False)
    by = {r.uri: r for r in W.read_warc(spark, str(tmp_path / "out")).collect()}
    a, dns = by["http://a.example/a b"], by["dns:a.example"]
    assert (a.record_type, a.date, bytes(a.payload), a.payload_bytes) == ("response", "1996-12-25T10:30:40Z", b"<p>\n\xff!", 6)
    assert (dns.record_type, dns.date, bytes(dns.payload)) == ("resource", "1997-01-01T00:00:00Z", b"a 1 A x")
    text = b"".join(f.read_bytes() for f in (tmp_path / "out").glob("part-*"))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n") and b"WARC-IP-Address: 1.2.3.4\r\n" in text
    assert len({r.record_id for r in by.values()}) == 2 and all(r.record_id.startswith("<urn:uuid:") for r in by.values())
    (tmp_path / "out" / "part-x.txt").write_bytes(text.replace(b"a 1 A x", b"a 1 A y"))
    with pytest.raises(Exception, match="digest"):
        W.read_warc(spark, str(tmp_path / "out")).collect()


def brute(rows, least):
    first, out = {}, []
    for i, url, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        raw = (html or "").encode()
        seen = len(raw) >= least and raw in first
        out.append((i, len(raw), W.digest(raw), "revisit" if seen else "response", first.get(raw) if seen else None))
        first.setdefault(raw, i)
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 6])
def test_pages_through_both_formats(spark, least):
    texts = ["<p>one</p>", "<p>two é 🙂</p>\r\n\r\nWARC/1.1\r\n\r\n", "", None, "x" * 3_000_000, "\n\nhttp://a 0.0.0.0 2000 text/html 3\nabc\n", "tiny", "\r\nX-Page-Id: 77\r\n"]
    rows = [(i, f"http://h{i % 3}/p q\n{i}" if i % 5 else None, texts[i * i % len(texts)], "d", 1) for i in range(60)]
    rows += [(3, "http://z/", "<p>one</p>", "d", 1), (3, "http://z/", "<p>one</p>", "d", 1), (None, "u", "alone", "d", 1), (None, "u", "<p>one</p>", "d", 1), (-4, "n", "tiny", "d", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = W.convert(df, least).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(rows, least)
    assert hashlib.sha1(b"alone").digest() == __import__("base64").b32decode(next(r.payload_digest for r in got if r.page_id is None and r.payload_bytes == 5))


def test_empty_table(spark):
    assert W.convert(spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_packed_fast_hold_the_same(spark, tmp_path, monkeypatch):
    """The ARC archives that ``convert`` writes for one reading are packed with less effort."""
    from pathlib import Path

    from pyspark.sql import functions as F

    html = " ".join(f"<p>word{i * i % 977} and {i % 13} others</p>" for i in range(4000))
    pages = spark.range(6).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit(html), "id").alias("html")).coalesce(1)
    sizes = {}
    for level in ("DEFAULT_COMPRESSION", "BEST_SPEED"):
        W.write_arc(pages, str(tmp_path / level), 1, level=level)
        sizes[level] = sum(f.stat().st_size for f in (tmp_path / level).glob("part-*"))
    assert sizes["BEST_SPEED"] > sizes["DEFAULT_COMPRESSION"]
    both = [sorted(map(tuple, W.read_arc(spark, str(tmp_path / level)).collect())) for level in sizes]
    assert both[0] == both[1] and len(both[0]) == 6
    seen = []

    def sized(_, *paths):
        seen.extend(sum(f.stat().st_size for f in Path(p.removeprefix("file:")).glob("part-*")) for p in paths)

    monkeypatch.setattr(W, "remove", sized)
    assert W.convert(pages).count() == 6
    for k in range(2):
        W.write_arc(pages.where(f"pmod(xxhash64(page_id), 2) = {k}"), str(tmp_path / f"h{k}"), 1 + k, fields=("page_id",))
    assert sum(seen) > sum(f.stat().st_size for k in range(2) for f in (tmp_path / f"h{k}").glob("part-*")) > 0
