"""Workout files of the FIT protocol as a Spark data source.

``spark.read.format("fit").option("message", "session" | "record").load(folder)``
after ``register(spark)``; ``write_fit`` writes such files from tables.  Many small
files share an input partition.  Messages are found one by one and decoded, or encoded,
by layout in columns, those of many files at once.  A broken file, one whose checksum does not hold too, fails the read, or with
``onError=skip`` gives no rows.

Decoder and encoder cover what the public protocol says of normal and compressed
headers, definition and data messages, developer fields, both byte orders, invalid
values, checksums and chained files.
"""

from __future__ import annotations

import datetime
import functools
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import METRICS, RECORDS, SESSION_FIELDS, SESSIONS, metric_type
from .files import listed, qualified, store

#: Fixed values of the protocol: message numbers, and per field number its name,
#: scale and offset.
MESSAGES = {"session": 18, "record": 20}
FIELDS = {
    18: {253: ("timestamp", 1, 0), 5: ("sport", 1, 0), 6: ("sub_sport", 1, 0), 7: ("total_elapsed_time", 1000, 0),
         9: ("total_distance", 100, 0), 11: ("total_calories", 1, 0), 16: ("avg_heart_rate", 1, 0)},
    20: {253: ("timestamp", 1, 0), 0: ("position_lat", 1, 0), 1: ("position_long", 1, 0), 2: ("altitude", 5, 500),
         3: ("heart_rate", 1, 0), 4: ("cadence", 1, 0), 6: ("speed", 1000, 0), 7: ("power", 1, 0), 13: ("temperature", 1, 0),
         73: ("enhanced_speed", 1000, 0), 78: ("enhanced_altitude", 5, 500)},
}
#: Base type -> struct code and the value that means missing.
TYPES = {0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF),
         0x86: ("I", 0xFFFFFFFF), 0x88: ("f", None), 0x89: ("d", None), 0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x0D: ("B", 0xFF),
         0x8E: ("q", 0x7FFFFFFFFFFFFFFF), 0x8F: ("Q", 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 0)}
SPORTS = {0: "generic", 1: "running", 2: "cycling", 5: "swimming"}
SUB_SPORTS = {0: "generic", 1: "treadmill", 2: "street", 3: "trail", 4: "track", 6: "indoor_cycling", 7: "road", 8: "mountain",
              17: "lap_swimming", 18: "open_water"}
EPOCH = datetime.datetime(1989, 12, 31)
EPOCH_US = int((EPOCH - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


#: Base type of each field that the encoder writes.
BASES = {
    18: {253: 0x86, 5: 0x00, 6: 0x00, 7: 0x86, 9: 0x86, 11: 0x84, 16: 0x02},
    20: {253: 0x86, 0: 0x85, 1: 0x85, 2: 0x84, 3: 0x02, 4: 0x02, 6: 0x84, 7: 0x84, 13: 0x01, 73: 0x86, 78: 0x86},
}
#: What a message that is no known metric is called: its field number.
OTHER = "field_"
#: Bytes of files in an input partition, and what opening one counts.
PACK, OPENING = 32 << 20, 64 << 10
#: Messages decoded at once (or those of one file), and rows of a batch of the reader.
AT_ONCE, BATCH = 50_000, 20_000
#: Files that a thread of the driver moves before it takes others: one by one, threads cost more than moves.
AT_A_TIME = 64


@functools.cache
def crc_table() -> list[int]:
    """CRC-16 with the reversed polynomial 0xA001, two bytes at a time."""
    table = np.arange(1 << 16, dtype=np.uint16)
    for _ in range(16):
        table = table >> 1 ^ np.where(table & 1, np.uint16(0xA001), np.uint16(0))
    return table.tolist()


def crc(data: bytes, start: int = 0) -> int:
    table = crc_table()
    for word in np.frombuffer(data, "<u2", len(data) // 2).tolist():
        start = table[start ^ word]
    return start >> 8 ^ table[(start ^ data[-1]) << 8 & 0xFFFF] if len(data) % 2 else start


def value_of(name: str, raw, scale: int, offset: int):
    if raw is None:
        return None
    if name == "timestamp":
        return EPOCH + datetime.timedelta(seconds=raw)
    if name == "sport":
        return SPORTS.get(raw, str(raw))
    if name == "sub_sport":
        return SUB_SPORTS.get(raw, str(raw))
    return int(raw) if name == "heart_rate" else raw / scale - offset if scale != 1 or offset else float(raw)


def chained(data: bytes) -> Iterator[bytes]:
    """The files that were put one behind the other in a file, each with its header and checksum."""
    at = 0
    while at < len(data) or not at:
        if len(data) - at < 14 or data[at + 8:at + 12] != b".FIT":
            raise ValueError("not a FIT file" if not at else f"no FIT file follows at byte {at}")
        head, size = data[at], struct.unpack_from("<I", data, at + 4)[0]
        end = at + head + size
        if end + 2 > len(data):
            raise ValueError("the file ends early")
        told = struct.unpack_from("<H", data, at + 12)[0] if head >= 14 else 0
        if told and told != crc(data[at:at + 12]):
            raise ValueError(f"the checksum of the header at byte {at} does not hold")
        if struct.unpack_from("<H", data, end)[0] != crc(data[at:end]):
            raise ValueError(f"the checksum of the file at byte {at} does not hold")
        yield data[at:end + 2]
        at = end + 2


def messages(data: bytes, wanted: int, others: bool = False) -> Iterator[dict]:
    """Messages of one kind of a file and those chained to it, as name -> value; a
    repeated field's last value holds.  With ``others`` numbers of unknown fields are
    kept under ``field_`` and their number."""
    for part in chained(data):
        yield from own_messages(part, wanted, others)


def own_messages(data: bytes, wanted: int, others: bool) -> Iterator[dict]:
    at, end, layouts, clock = data[0], len(data) - 2, {}, None
    names = FIELDS[wanted]
    while at < end:
        head = data[at]
        at += 1
        if head & 0xC0 == 0x40:  # a definition
            order = ">" if data[at + 1] else "<"
            number, count = struct.unpack_from(order + "HB", data, at + 2)
            at += 5
            fields = [tuple(data[at + 3 * i:at + 3 * i + 3]) for i in range(count)]
            at += 3 * count
            extra = 0
            if head & 0x20:  # developer fields: their sizes only
                extra = sum(data[at + 2 + 3 * i] for i in range(data[at]))
                at += 1 + 3 * data[at]
            layouts[head & 0x0F] = (number, order, fields, extra)
            continue
        packed = head & 0x80
        number, order, fields, extra = layouts[head >> 5 & 3 if packed else head & 0x0F]
        out = {}
        if packed and clock is not None:
            clock += ((head & 0x1F) - clock) & 0x1F
            out["timestamp"] = value_of("timestamp", clock, 1, 0)
        for field, length, base in fields:
            known = names.get(field) if number == wanted else None
            if others and number == wanted and not known and field != 253:
                known = (f"{OTHER}{field}", 1, 0)
            if (known or field == 253) and base in TYPES:
                code, missing = TYPES[base]
                if length == struct.calcsize(code):
                    raw, = struct.unpack_from(order + code, data, at)
                    raw = None if raw == missing or raw != raw else raw
                    if field == 253 and raw is not None:
                        clock = raw
                    if known:
                        out[known[0]] = value_of(known[0], raw, *known[1:])
            at += length
        at += extra
        if number == wanted:
            yield out


def raw_of(name: str, value, scale: int, offset: int, code: str, missing) -> int | float:
    """A value as its field stores it; raises where it has no place."""
    if value is None:
        return float("nan") if missing is None else missing
    if name == "timestamp":
        value = (value - EPOCH).total_seconds()
    elif name in ("sport", "sub_sport"):
        known = SPORTS if name == "sport" else SUB_SPORTS
        value = next((k for k, v in known.items() if v == value), value)
        value = int(value) if str(value).isdigit() else value
        if isinstance(value, str):
            raise ValueError(f"{name} {value!r} has no number")
    if code in "fd":
        return float(value)
    raw = round((value + offset) * scale)
    low, high = (0, 2 ** (8 * struct.calcsize(code)) - 1) if code.isupper() else (-2 ** (8 * struct.calcsize(code) - 1), 2 ** (8 * struct.calcsize(code) - 1) - 1)
    if not low <= raw <= high or raw == missing:
        raise ValueError(f"{name} {value} does not fit its field")
    return raw


def field_of(number: int, name: str) -> tuple[int, int, int, int]:
    """Field number, base type, scale and offset of a name."""
    numbers = {f[0]: k for k, f in FIELDS[number].items()}
    if name in numbers:
        k = numbers[name]
        return k, BASES[number][k], *FIELDS[number][k][1:]
    if name.startswith(OTHER) and 0 <= int(name[len(OTHER):]) < 256:  # a double: any number has a place
        return int(name[len(OTHER):]), 0x89, 1, 0
    raise ValueError(f"{name} has no field number")


class Encoder:
    """Messages as bytes: a definition where none of a file's last 16 fits, then the data."""

    def __init__(self):
        self.layouts: dict[tuple, int] = {}  # message and fields -> local number

    def local(self, layout: tuple) -> tuple[int, bytes]:
        """The local number of a layout, and its definition if it needs one."""
        if layout in self.layouts:
            return self.layouts[layout], b""
        local = len(self.layouts) if len(self.layouts) < 16 else self.layouts.pop(next(iter(self.layouts)))
        self.layouts[layout] = local
        number, fields = layout
        sizes = [(k, struct.calcsize(TYPES[b][0]), b) for k, b in fields]
        return local, bytes([0x40 | local, 0, 0]) + struct.pack("<HB", number, len(fields)) + b"".join(bytes(x) for x in sizes)

    def message(self, number: int, values: dict) -> bytes:
        fields = sorted(((*field_of(number, name), name, value) for name, value in values.items()), key=lambda f: f[0])
        local, out = self.local((number, tuple(f[:2] for f in fields)))
        data = b"".join(struct.pack("<" + TYPES[b][0], raw_of(name, v, scale, offset, *TYPES[b])) for _, b, scale, offset, name, v in fields)
        return out + bytes([local]) + data


def values_of(row: dict) -> dict:
    return {k: row.get(k) for k in row["present"] or ()} | dict(row.get("others") or {})


class Encoded:
    """The data messages of a batch of rows: bytes ``start[i]`` to ``start[i + 1]`` of ``data``
    are row i's, the first of them free for the local number; ``layouts[code[i]]`` is its
    layout, None where the row is left to ``Encoder.message``."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, others = batch, batch["others"]
        self.entries = pa.ListArray.from_arrays(others.offsets, others.keys)
        self.items, self.offsets = others.items, others.offsets.to_numpy()
        kinds = batch["message"].dictionary_encode()
        code = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for lists in (batch["present"], self.entries):
            # joined names and their number tell lists of known names apart
            joined = pc.fill_null(pc.binary_join(lists.cast(pa.list_(pa.string())), "\0"), "").dictionary_encode()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            code = (code * len(joined.dictionary) + joined.indices.to_numpy(zero_copy_only=False)) * (int(size.max(initial=0)) + 1) + size
        _, first, self.code = np.unique(code, return_index=True, return_inverse=True)
        plans = [self.plan(int(i)) for i in first]
        self.layouts = [p and p[0] for p in plans]
        wide = np.array([p[1].itemsize if p else 0 for p in plans])
        self.start = np.concatenate([[0], np.cumsum(wide[self.code])])
        self.data = np.zeros(self.start[-1], np.uint8)
        self.columns: dict[str, tuple] = {}
        for k, p in enumerate(plans):
            if p:
                rows = np.flatnonzero(self.code == k)
                self.data[self.start[rows][:, None] + np.arange(wide[k])] = self.raw(rows, *p[1:]).view(np.uint8).reshape(len(rows), -1)

    def plan(self, i: int) -> tuple | None:
        """Layout, record type and fields of the rows that are like row ``i``."""
        number = MESSAGES[self.batch["message"][i].as_py()]
        known, own = self.batch["present"][i].as_py() or [], self.entries[i].as_py() or []
        if not set(known) <= {f[0] for f in FIELDS[number].values()} or len(set(own)) < len(own) or not all(k.startswith(OTHER) for k in own):
            return None
        fields = sorted(((*field_of(number, name), name, None) for name in set(known)), key=lambda f: f[0])
        fields = sorted(fields + [(*field_of(number, name), name, j) for j, name in enumerate(own)], key=lambda f: f[0])
        if len({f[0] for f in fields}) < len(fields):
            return None
        kind = np.dtype([("", "u1"), *[(f"f{k}_", "<" + TYPES[base][0]) for k, base, *_ in fields]])
        return (number, tuple(f[:2] for f in fields)), kind, fields

    def told(self, name: str) -> pa.Array:
        """A column; nulls where the batch has none of the name."""
        return self.batch[name] if name in self.batch.schema.names else pa.nulls(len(self.batch), pa.string() if name in ("sport", "sub_sport") else pa.float64())

    def column(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a column and where there are none."""
        if name not in self.columns:
            c = self.told(name)
            c = c.cast(pa.int64()) if name == "timestamp" else c
            values = pc.fill_null(c, 0).to_numpy(zero_copy_only=False)
            values = (values - EPOCH_US) / 1e6 if name == "timestamp" else values.astype(float)
            self.columns[name] = values, c.is_null().to_numpy(zero_copy_only=False)
        return self.columns[name]

    def raw(self, rows: np.ndarray, kind: np.dtype, fields: list) -> np.ndarray:
        out = np.zeros(len(rows), kind)
        for k, base, scale, offset, name, entry in fields:
            (code, missing), to = TYPES[base], out[f"f{k}_"]
            if entry is not None:
                values = self.items.take(pa.array(self.offsets[rows] + entry))
                to[:] = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False)
            elif name in ("sport", "sub_sport"):
                text = self.told(name).take(pa.array(rows)).dictionary_encode("encode")
                each = np.array([raw_of(name, t, scale, offset, code, missing) for t in text.dictionary.to_pylist()])
                to[:] = each[text.indices.to_numpy(zero_copy_only=False)]
            else:
                values, null = (x[rows] for x in self.column(name))
                raw, info = np.rint((values + offset) * scale), np.iinfo(to.dtype)
                bad = np.flatnonzero(~((raw >= info.min) & (raw <= info.max) & (raw != missing) | null))
                if len(bad):
                    raise ValueError(f"{name} {values[bad[0]]} does not fit its field")
                to[:] = np.where(null, missing, raw)
        return out


def header(size: int) -> bytes:
    head = struct.pack("<BBHI4s", 14, 0x20, 2132, size, b".FIT")
    return head + struct.pack("<H", crc(head))


def encode(parts: Iterable[tuple[str, dict]]) -> bytes:
    """A whole file of (kind, name -> value) messages."""
    own = Encoder()
    body = b"".join(own.message(MESSAGES[kind], values) for kind, values in parts)
    out = header(len(body)) + body
    return out + struct.pack("<H", crc(out))


class Layout:
    """A definition: bytes of its data messages, and of the fields that are asked for
    name -> place, type, missing value, scale and offset.  ``plain``: columns give what
    a message alone gives."""

    def __init__(self, told: bytes, wanted: int, others: bool):
        order, self.fields, self.plain, self.size = ">" if told[2] else "<", {}, True, 1
        number, count = struct.unpack_from(order + "HB", told, 3)
        self.ours = number == wanted
        for i in range(count):
            field, length, base = told[6 + 3 * i:9 + 3 * i]
            known = FIELDS[wanted].get(field) or (others and field != 253 and (f"{OTHER}{field}", 1, 0))
            if self.ours and known and base in TYPES and length == struct.calcsize(TYPES[base][0]):
                code, missing = TYPES[base]
                fits = {"timestamp": "I", "heart_rate": "BbHh", "sport": "BbHhIi", "sub_sport": "BbHhIi"}.get(known[0], "BbHhIifd")
                self.plain &= known[0] not in self.fields and code in fits
                self.fields[known[0]] = (self.size, np.dtype(order + code), missing, *known[1:])
            self.size += length
        at = 6 + 3 * count
        if told[0] & 0x20:  # developer fields: their sizes only
            self.size += sum(told[at + 2 + 3 * i] for i in range(told[at]))
        self.present = sorted(self.fields)
        self.others = [k for k in self.fields if k.startswith(OTHER)]


def places(data: bytes, wanted: int, others: bool, layouts: dict[bytes, Layout]) -> tuple[list[Layout], list[int]] | None:
    """Layouts and places of a kind's messages in a file without others chained to it;
    None where they have to be read one by one."""
    at, end, own, found, where = data[0], len(data) - 2, {}, [], []
    while at < end:
        head = data[at]
        if head & 0xC0 == 0x40:
            stop = at + 6 + 3 * data[at + 5]
            stop += 1 + 3 * data[stop] if head & 0x20 else 0
            told = data[at:stop]
            if told not in layouts:
                layouts[told] = Layout(told, wanted, others)
            layout = own[head & 0x0F] = layouts[told]
            if layout.ours and not layout.plain:
                return None
            at = stop
        elif head & 0x80:
            return None
        else:
            layout = own[head & 0x0F]
            if layout.ours:
                found.append(layout)
                where.append(at)
            at += layout.size
    if at > end:
        raise ValueError("a message ends late")
    return found, where


class Columns:
    """Messages of many files as batches of rows."""

    def __init__(self, kind: str, others: bool):
        self.kind, self.wanted, self.others, self.layouts = kind, MESSAGES[kind], others, {}
        self.schema = to_arrow_schema(schema_of(kind, others))
        self.clear()

    def clear(self) -> None:
        self.names, self.counts, self.found, self.where, self.held, self.size = [], [], [], [], [], 0

    def add(self, name: str, data: bytes) -> list[tuple] | None:
        """Take in a file; if its messages have to be read one by one, their rows."""
        parts, found, where, at = list(chained(data)), [], [], self.size
        for part in parts:
            got = places(part, self.wanted, self.others, self.layouts)
            if got is None:
                return list(rows_of(name, data, self.kind, self.others))
            found += got[0]
            where += [at + i for i in got[1]] if at else got[1]
            at += len(part)
        self.names.append(name)
        self.counts.append(len(found))
        self.found += found
        self.where += where
        self.held += parts
        self.size = at
        return None

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What was taken in, in order."""
        if self.found:
            whole = self.decoded()
            for i in range(0, len(self.found), BATCH):
                yield whole.slice(i, BATCH)
        self.clear()
        if len(self.layouts) > 1000:
            self.layouts.clear()

    def decoded(self) -> pa.RecordBatch:
        data, n, where = np.frombuffer(b"".join(self.held), np.uint8), len(self.found), np.array(self.where)
        number = {layout: k for k, layout in enumerate(dict.fromkeys(self.found))}
        code = np.fromiter(map(number.__getitem__, self.found), np.int32, n)
        values, null = {}, {}
        size = np.array([len(layout.others) for layout in number])[code]
        ends = np.cumsum(size)
        named = sorted({k for layout in number for k in layout.others})
        key, entry, no_entry = np.zeros(size.sum(), np.int32), np.zeros(size.sum()), np.zeros(size.sum(), bool)
        for layout, k in number.items():
            rows = np.flatnonzero(code == k)
            for name, (place, kind, missing, scale, offset) in layout.fields.items():
                raw = data[where[rows][:, None] + np.arange(place, place + kind.itemsize)].view(kind)[:, 0]
                gone = raw != raw if missing is None else raw == missing
                if name in layout.others:
                    at = (ends - size)[rows] + layout.others.index(name)
                    key[at], entry[at], no_entry[at] = named.index(name), raw, gone
                    continue
                if name not in values:
                    values[name], null[name] = np.zeros(n, float if pa.types.is_floating(self.schema.field(name).type) else np.int64), np.ones(n, bool)
                values[name][rows] = raw if scale == 1 and not offset else raw / float(scale) - offset
                null[name][rows] = gone
        counts = np.array(self.counts)
        columns = {"name": pa.array(self.names).take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                   "seq" if self.kind == "session" else "idx": pa.array((np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)),
                   "present": pa.array([layout.present for layout in number], pa.list_(pa.string())).take(pa.array(code))}
        for name, v in values.items():
            if name == "timestamp":
                columns[name] = pa.array((v * 1_000_000 + EPOCH_US).view("M8[us]"), pa.timestamp("us"), mask=null[name])
            elif name in ("sport", "sub_sport"):
                known, (each, at) = SPORTS if name == "sport" else SUB_SPORTS, np.unique(v, return_inverse=True)
                columns[name] = pa.array([known.get(x, str(x)) for x in each.tolist()]).take(pa.array(at, mask=null[name]))
            else:
                columns[name] = pa.array(v, self.schema.field(name).type, mask=null[name])
        if self.others:
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            columns["others"] = pa.MapArray.from_arrays(offsets, pa.array(named, pa.string()).take(pa.array(key)), pa.array(entry, mask=no_entry))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in self.schema], schema=self.schema)


def schema_of(kind: str, others: bool) -> T.StructType:
    own = SESSIONS if kind == "session" else RECORDS
    return T.StructType([*own.fields, T.StructField("others", T.MapType(T.StringType(), T.DoubleType()))]) if others else own


def batches_of(files: Iterable[tuple], kind: str, others: bool, skip: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (path, how to get the bytes) in order; a broken file is skipped or raises."""
    columns = Columns(kind, others)
    for path, get in files:
        try:
            rows = columns.add(path.rpartition("/")[2], get())
        except (ValueError, KeyError, struct.error, IndexError, OSError) as e:
            if skip:
                continue
            raise ValueError(f"{path}: {e}") from e
        if rows is not None or len(columns.found) >= AT_ONCE:
            yield from columns.batches()
        for i in range(0, len(rows or ()), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + BATCH]), columns.schema)], schema=columns.schema)
    yield from columns.batches()


def read_bytes(path: str) -> bytes:
    system, own = store(path)
    with system.open_input_stream(own) as f:
        return f.read()


class FilePartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FitReader(DataSourceReader):
    def __init__(self, options: dict, files: list[tuple[str, int]]):
        self.kind, self.skip = options.get("message", "session"), options.get("onerror", "fail") == "skip"
        self.others, self.files = options.get("others", "false") == "true", files

    def partitions(self):
        packs, size = [[]], 0
        for path, n in self.files:
            if packs[-1] and size + n + OPENING > PACK:
                packs.append([])
                size = 0
            packs[-1].append(path)
            size += n + OPENING
        return [FilePartition(p) for p in packs]

    def read(self, partition: FilePartition):
        yield from batches_of(((p, functools.partial(read_bytes, p)) for p in partition.paths), self.kind, self.others, self.skip)


def rows_of(name: str, data: bytes, kind: str, others: bool = False) -> Iterator[tuple]:
    schema = SESSIONS if kind == "session" else RECORDS
    for i, m in enumerate(messages(data, MESSAGES[kind], others)):
        row = [name if c == "name" else i if c in ("seq", "idx") else sorted(m) if c == "present" else m.get(c) for c in schema.names]
        yield (*row, {k: v for k, v in m.items() if k.startswith(OTHER)}) if others else tuple(row)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class FitWriter(DataSourceArrowWriter):
    """A file per name.  Rows come sorted by name; each file is built in a temporary
    file of the task, put into a staging folder and moved when all tasks are done,
    so a task that is lost or runs twice leaves nothing behind."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path.rstrip("/"), names, overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, staging = store(self.staging)
        system.create_dir(staging, recursive=True)
        done, name, body, size, own = [], None, None, 0, None

        def close():
            part = uuid.uuid4().hex
            head = header(size)
            check = crc(head)
            body.seek(0)
            with system.open_output_stream(f"{staging}/{part}") as out:
                out.write(head)
                while data := body.read(1 << 20):
                    check = crc(data, check)
                    out.write(data)
                out.write(struct.pack("<H", check))
            body.close()
            done.append((part, name))

        for batch in batches:
            coded, names = Encoded(batch), batch["name"].to_pylist()
            edges = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(edges, edges[1:]):
                if body is None or names[a] != name:
                    if body:
                        close()
                    name, body, size, own = names[a], tempfile.SpooledTemporaryFile(max_size=8 << 20), 0, Encoder()
                    if not name or "/" in name or not name.endswith(".fit"):
                        raise ValueError(f"{name!r} is no name of a .fit file")
                for data in self.encoded(coded, a, b, own):
                    body.write(data)
                    size += len(data)
        if body:
            close()
        return Written(done)

    @staticmethod
    def encoded(coded: Encoded, a: int, b: int, own: Encoder) -> Iterator[bytes]:
        """Messages of the rows ``a`` to ``b`` of one file, new definitions before them."""
        code = coded.code[a:b]
        used = list(dict.fromkeys(code.tolist()))
        layouts = [coded.layouts[k] for k in used]
        if None in layouts or len({*layouts, *own.layouts}) > 16:
            for row in coded.batch.slice(a, b - a).to_pylist():
                yield own.message(MESSAGES[row["message"]], values_of(row))
            return
        local = np.zeros(len(coded.layouts), np.uint8)
        for k, layout in zip(used, layouts):
            local[k], told = own.local(layout)
            yield told
        coded.data[coded.start[a:b]] = local[code]
        yield coded.data[coded.start[a]:coded.start[b]].tobytes()

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("a file's messages came from several tasks: partition by name")
        (system, folder), (_, staging) = store(self.path), store(self.staging)
        if self.overwrite:
            for old in system.get_file_info(FileSelector(folder, allow_not_found=True)):
                if old.path.endswith(".fit"):
                    system.delete_file(old.path)

        def move(first: int) -> None:
            for part, name in files[first:first + AT_A_TIME]:
                system.move(f"{staging}/{part}", f"{folder}/{name}")

        with ThreadPoolExecutor(16) as pool:  # a move is a wait for the file system
            list(pool.map(move, range(0, len(files), AT_A_TIME)))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, staging = store(self.staging)
        if system.get_file_info(staging).type == FileType.Directory:
            system.delete_dir(staging)


class FitSource(DataSource):
    """Files on a file system that driver and executors see."""

    @classmethod
    def name(cls) -> str:
        return "fit"

    def schema(self):
        return schema_of(self.options.get("message", "session"), self.options.get("others", "false") == "true")

    def reader(self, schema):
        options = dict(self.options)
        if "files" in options:  # as read_fit lists them
            return FitReader(options, [(p, int(n)) for n, _, p in (f.partition(" ") for f in options["files"].split("\n") if f)])
        path = options.get("path", "")
        system, folder = store(path)
        scheme = path[:path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
        found = sorted((f"{scheme}{f.path}", f.size) for f in system.get_file_info(FileSelector(folder, allow_not_found=True)) if f.is_file and f.path.endswith(".fit"))
        return FitReader(options, found)

    def writer(self, schema, overwrite: bool):
        return FitWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitSource)


def write_fit(sessions: DataFrame, records: DataFrame, path: str, mode: str = "append") -> None:
    """Sessions and samples (``name``, ``seq`` or ``idx``, fields, ``present``; samples may
    have a map ``others`` of field_N to numbers) as one file per name: samples in
    order, then sessions.  A field is written where ``present`` names it, a null as
    the value that means missing.  Values that have no place in their field, and
    names that are none of a file, raise.  ``overwrite`` replaces the folder's files.
    """
    kinds = {"timestamp": T.TimestampNTZType(), **{m: metric_type(m) for m in METRICS}, **SESSION_FIELDS}
    kinds = {k: kind for k, kind in kinds.items() if k in records.columns or k in sessions.columns}  # columns of nulls would cost as much as others

    def rows(df: DataFrame, kind: str, order: str) -> DataFrame:
        field = lambda k: (F.col(k) if k in df.columns else F.lit(None)).cast(kinds[k]).alias(k)
        others = F.col("others") if "others" in df.columns else F.lit(None)
        return df.select("name", F.lit(kind).alias("message"), F.col(order).alias(f"{kind}_order"), "present",
                         others.cast("map<string,double>").alias("others"), *[field(k) for k in kinds])

    order = ("record_order", "session_order")
    both = rows(records, "record", "idx").unionByName(rows(sessions, "session", "seq"), allowMissingColumns=True)
    both.repartition("name").sortWithinPartitions("name", "message", *order).drop(*order).write.format("fit").mode(mode).save(path)


def read_fit(spark: SparkSession, folder: str, kind: str = "session", others: bool = False, on_error: str = "fail") -> DataFrame:
    """Messages of the files of a folder that Spark's file systems list, hidden ones too."""
    register(spark)
    read = spark.read.format("fit").option("message", kind).option("others", str(others).lower()).option("onError", on_error)
    folder = qualified(spark, folder)
    if not folder.startswith("file:"):  # a local folder the source lists itself
        read = read.option("files", "\n".join(f"{n} {p}" for p, n in listed(spark, folder, "*.fit")))
    return read.load(folder)


def decode(spark: SparkSession, folder: str, kind: str = "session", on_error: str = "skip") -> DataFrame:
    """The same from any store that Spark reads: files come as binary rows.  A broken
    file gives no rows, or with ``on_error="fail"`` fails the read.  Hidden files are
    left out."""
    schema = SESSIONS if kind == "session" else RECORDS
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fit").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            yield from batches_of(zip(batch["path"].to_pylist(), (c.as_py for c in batch["content"])), kind, False, on_error == "skip")

    return files.mapInArrow(run, schema).select(*[F.col(c) for c in schema.names])


assert set(METRICS) >= {f[0] for f in FIELDS[20].values()} - {"timestamp"}
