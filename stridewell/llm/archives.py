"""Legacy ARC archives to WARC archives, and readers of both.

Archives are written by Spark's own text writer, whose record separator is the
archive's, so any file system that Spark knows will do and its commit protocol
guards against lost executors; one file per task, gzip over the whole file.
Readers take files as binary rows and walk each by its declared lengths.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, remove
from ..scratch import fresh_path

#: Fixed values of the ARC format: the fields of a record's header line by version.
#: A version block declares its own line, which takes precedence.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Profile of revisit records, a fixed value of the WARC format.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Copies of an entry of repeated payloads, over which the records that have it are dealt.
SALTS = 32
#: Compressed bytes that are unpacked at once.
CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Stream:
    """Bytes of an archive, unpacked (gzip, of one or many members) as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer, self.start = memoryview(data), 0, bytearray(), 0
        self.packed = data[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            if self.packed and self.inflate is not None and not self.inflate.eof:
                raise ValueError("the archive ends within a compressed member")
            return False
        part = self.data[self.at:self.at + CHUNK]
        self.at += len(part)
        if not self.packed:
            self.buffer += part
            return True
        while len(part):
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(part)
            part = memoryview(self.inflate.unused_data)
        return True

    def line(self) -> bytes | None:
        """Up to a line feed, without it; None at the end."""
        seen = 0
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self.more():
                return bytes(self.take(seen)) if seen else None
        out = bytes(self.buffer[:end])
        self.take(end + 1)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError(f"a record at {self.start} declares {n} bytes; {len(self.buffer)} are left")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.start += n
        return out


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of an ARC archive, the version
    block first.  Fields are counted from the right, so an address may hold spaces."""
    stream, names = Stream(data), ARC_FIELDS[1].split(" ")
    while True:
        at = stream.start
        line = stream.line()
        if line is None:
            return
        line = line.rstrip(b"\r")
        if not line.strip():
            continue
        own = ARC_FIELDS[1].split(" ") if line.startswith(b"filedesc:") else names
        parts = line.decode("utf-8", "surrogateescape").rsplit(" ", len(own) - 1)
        if line.startswith(b"filedesc:") and line.count(b" ") >= 9:  # a version 2 line
            own = ARC_FIELDS[2].split(" ")
            parts = line.decode("utf-8", "surrogateescape").rsplit(" ", len(own) - 1)
        if len(parts) != len(own) or not parts[-1].isdigit():
            raise ValueError(f"no record of {len(own)} fields at {at}: {line[:100]!r}")
        fields = dict(zip((n.lower() for n in own), parts))
        block = stream.take(int(parts[-1]))
        if line.startswith(b"filedesc:"):
            told = [x for x in block.decode("utf-8", "replace").split("\n") if x.strip()]
            version = int(told[0].split(" ")[0]) if told and told[0].split(" ")[0].isdigit() else 1
            names = told[1].strip().split(" ") if len(told) > 1 else ARC_FIELDS.get(version, ARC_FIELDS[1]).split(" ")
        yield at, fields, block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC archive."""
    stream = Stream(data)
    while True:
        line = stream.line()
        if line is None:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record before {stream.start}: {line[:100]!r}")
        fields = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.take(int(fields["content-length"]))


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header with its empty line, its fields (names in lower case), and payload of an
    HTTP response; a block that is none has no header."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    end = re.compile(rb"\r?\n\r?\n").search(block)
    head = block[:end.end()] if end else block
    fields = {}
    for line in head.decode("utf-8", "surrogateescape").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return head, fields, block[len(head):]


def plain_url(url: str | None) -> str:
    """An address of one header field: white space and controls are percent-encoded; '-' if there is none."""
    return re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def iso_date(date: str) -> str:
    """14 digits, or fewer from the left, as a WARC date."""
    digits = re.sub(r"\D", "", date)[:14]
    if len(digits) < 4:
        return "1970-01-01T00:00:00Z"
    d = digits + "00000101000000"[len(digits):] if len(digits) < 8 else digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def put(df: DataFrame, path: str, separator: str, packed: bool, level: str = "DEFAULT_COMPRESSION") -> None:
    """Binary rows ``record`` as files, each row followed by the separator; ``level`` is
    Hadoop's name of the effort of gzip."""
    # a cast of bytes to a string keeps them as they are
    (df.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("zlib.compress.level", level)
     .option("compression", "gzip" if packed else "none").text(path))


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20000101000000", packed: bool = True,
              fields: tuple[str, ...] = (), level: str = "DEFAULT_COMPRESSION") -> None:
    """``pages(url, html)`` as ARC archives of version 1 or 2 in a new folder, one per
    task: a version block, then a record per row that holds an HTTP response.  Columns
    named in ``fields`` become HTTP fields of their values, nulls none."""
    names = [f"X-{f.replace('_', '-').title()}" for f in fields]

    def run(batches):
        context = TaskContext.get()
        name = f"part-{context.partitionId() if context else 0:05d}-v{version}.arc"
        block = f"{version} 0 stridewell\n{ARC_FIELDS[version]}\n\n".encode()
        extra = "" if version == 1 else f" 200 - - 0 {name}"
        first = f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(block)}\n".encode() + block
        at = len(first) + 1
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], ["record"])
        for batch in batches:
            out = []
            values = [batch[f].to_pylist() for f in fields]
            for i, (url, html) in enumerate(zip(batch["url"].to_pylist(), batch["html"])):
                payload = html.as_py() or b""
                head = "".join(f"{k}: {v[i]}\r\n" for k, v in zip(names, values) if v[i] is not None)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{head}\r\n".encode()
                extra = "" if version == 1 else f" 200 {hashlib.md5(payload).hexdigest()} - {at} {name}"
                line = f"{plain_url(url)} 0.0.0.0 {date} text/html{extra} {len(head) + len(payload)}\n".encode()
                out.append(b"".join((line, head, payload)))
                at += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"),
                        *[F.col(f).cast("string").alias(f) for f in fields])
    put(rows.mapInArrow(run, "record binary"), path, "\n", packed, level)


def each_file(spark: SparkSession, paths: list[str], run: Callable, schema: str) -> DataFrame:
    """Rows that ``run(bytes)`` yields, as dicts, for every file of some folders."""
    files = spark.read.format("binaryFile").load(paths).select("content")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.split(" ") for c in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                held, size = [], 0
                for row in run(content.as_py()):
                    held.append(row)
                    size += len(row.get("head") or b"") + len(row.get("payload") or b"")
                    if size > 8_000_000 or len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist(held, pa.schema([(c, kinds[k]) for c, k in columns]))
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, pa.schema([(c, kinds[k]) for c, k in columns]))

    return files.mapInArrow(rows, schema)


PARSED = "record_id string, uri string, date string, ip string, kind string, head binary, payload binary, digest string, size long, place string"


def read_arc(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of all ARC archives in some folders, but for version blocks, with what a
    WARC record needs: a record id made of the archive's name and the record's
    offset, the address, date, host, media type, HTTP header and payload, and the
    payload's digest and size.  A record that is not as long as its line declares, or a
    line of another number of fields, fails the read."""
    def run(data):
        name = "archive"
        for at, f, block in arc_records(data):
            if f["url"].startswith("filedesc:"):
                name = f["url"][len("filedesc://"):]
                continue
            head, _, payload = http_parts(block)
            yield {"record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}#{f["url"]}')}>", "uri": f["url"], "date": iso_date(f["archive-date"]),
                   "ip": f["ip-address"], "kind": f["content-type"], "head": head, "payload": payload, "digest": digest(payload),
                   "size": len(payload), "place": f"{at:020d}"}
    return each_file(spark, list(paths), run, PARSED)


def typed(records: DataFrame, order: list, carry: list, least: int) -> DataFrame:
    """``records`` with ``first``: null for a response, else what names the response that
    has the same payload: the first by ``order``, with the ``carry`` columns."""
    named = F.struct(*order, "record_id", "uri", "date", *carry)
    rows = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    repeated = (records.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min(named).alias("first"), F.count("*").alias("n"))
                .where("n > 1").select("digest", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    return rows.join(repeated, ["digest", "size", "salt"], "left").withColumn(
        "first", F.when(F.col("first.record_id") != F.col("record_id"), F.col("first")))


def write_warc(records: DataFrame, path: str, field: str | None = None, least: int = 0, packed: bool = True) -> None:
    """Records of ``read_arc`` as WARC 1.1 archives in a new folder, one per task, each
    with a warcinfo record.

    Payloads that are equal and of ``least`` bytes at least are stored once, as the
    response whose integer HTTP field ``field`` is smallest (those without it last,
    then by address and place); the others are revisit records that keep their HTTP
    header and refer to it.  Blocks without an HTTP header are resource records.
    """
    # what decides is written without payloads: these join once, dealt over salts
    number = F.when(F.lit(field is not None), F.regexp_extract(F.col("head").cast("string"), rf"(?i)\r\n{field or '-'}: *(-?\d+) *\r\n", 1).try_cast("long"))
    rows = records.withColumn("number", number)
    rows = typed(rows, [F.col("number").isNull().alias("none"), F.col("number"), F.col("uri").alias("by_uri"), F.col("place")], [], least)

    def block(kind: str, fields: dict, content_type: str, *parts: bytes) -> bytes:
        lines = [f"WARC/1.1\r\nWARC-Type: {kind}\r\n", *[f"{k}: {v}\r\n" for k, v in fields.items() if v is not None],
                 f"Content-Type: {content_type}\r\nContent-Length: {sum(map(len, parts))}\r\n\r\n"]
        return b"".join(("".join(lines).encode("utf-8", "surrogateescape"), *parts))

    def run(batches):
        context = TaskContext.get()
        name = f"part-{context.partitionId() if context else 0:05d}.warc"
        info = b"software: stridewell\r\nformat: WARC File Format 1.1\r\n"
        first = block("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": "2000-01-01T00:00:00Z",
                                   "WARC-Filename": name}, "application/warc-fields", info)
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], ["record"])
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                out = []
                for r in part.to_pylist():
                    fields = {"WARC-Record-ID": r["record_id"], "WARC-Date": r["date"], "WARC-Target-URI": r["uri"],
                              "WARC-IP-Address": r["ip"] if r["ip"] != "0.0.0.0" else None, "WARC-Payload-Digest": f"sha1:{r['digest']}"}
                    if r["first"] is None:
                        kind = "response" if r["head"] else "resource"
                        out.append(block(kind, fields, "application/http; msgtype=response" if r["head"] else r["kind"], r["head"], r["payload"]))
                    else:
                        of = r["first"]
                        fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": of["record_id"], "WARC-Refers-To-Target-URI": of["uri"],
                                   "WARC-Refers-To-Date": of["date"], "Refers-To-Number": of["number"], "Payload-Length": r["size"]}
                        out.append(block("revisit", fields, "application/http; msgtype=response", r["head"]))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    keep = rows.select("record_id", "uri", "date", "ip", "kind", "head", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
                       "digest", "size", "first")
    put(keep.mapInArrow(run, "record binary"), path, "\r\n\r\n", packed)


READ = "record_type string, record_id string, uri string, date string, refers_to_id string, refers_to long, head binary, payload binary, payload_digest string, payload_bytes long"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the WARC archives in a folder, but for warcinfo.  The digest and size
    of a stored payload are taken from its bytes, and a digest other than the declared
    one fails the read; those of a revisit are the declared ones."""
    def run(data):
        for f, block in warc_records(data):
            if f["warc-type"] == "warcinfo":
                continue
            told = f.get("warc-payload-digest", "").removeprefix("sha1:")
            head, _, payload = http_parts(block) if f["content-type"].startswith("application/http") else (b"", {}, block)
            again = f["warc-type"] == "revisit"
            if not again and digest(payload) != told:
                raise ValueError(f"{f['warc-record-id']}: the payload is not the one of its digest")
            yield {"record_type": f["warc-type"], "record_id": f["warc-record-id"], "uri": f.get("warc-target-uri"), "date": f["warc-date"],
                   "refers_to_id": f.get("warc-refers-to"), "refers_to": int(f["refers-to-number"]) if "refers-to-number" in f else None,
                   "head": head, "payload": payload if payloads and not again else None, "payload_digest": told,
                   "payload_bytes": int(f["payload-length"]) if again else len(payload)}
    return each_file(spark, [path], run, READ)


def convert(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages(page_id long, url, html)`` -> ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, warc_date``: pages become ARC archives, of version 1
    and 2 by a hash of the id, these become WARC archives, and the WARC archives are
    read back.

    A payload is the html in UTF-8, null as empty.  Of equal payloads of ``least`` bytes
    at least the one of the smallest page_id is the response and the others are
    revisits that refer to it; null ids come last, rows of one id by address and
    place.  Null ids stay null, as does ``refers_to`` a response without id.  Repeated
    rows have a record each.  An empty table gives no rows.  Extra columns are
    ignored.

    Archives lie in the shared folder; the ARC ones go when they are converted.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    second = F.pmod(F.xxhash64("page_id"), F.lit(2)) == 1
    old = [fresh_path(spark) for _ in range(2)]
    # these are read once and go: packing them tightly costs more than it saves
    write_arc(rows.where(~second), old[0], 1, fields=("page_id",), level="BEST_SPEED")
    write_arc(rows.where(second), old[1], 2, fields=("page_id",), level="BEST_SPEED")
    parsed = materialize(read_arc(spark, *old), "zstd")
    remove(spark, *old)
    path = fresh_path(spark)
    write_warc(parsed, path, "X-Page-Id", least)
    discard(parsed)
    number = F.regexp_extract(F.col("head").cast("string"), r"\r\nX-Page-Id: (-?\d+)\r\n", 1).try_cast("long")
    return read_warc(spark, path, payloads=False).select(
        number.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("uri").alias("url"), F.col("date").alias("warc_date"))
