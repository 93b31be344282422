"""Removing repeated byte strings by a prefix-free parse of the corpus.

Triggers are the places where a rolling hash of 32 bytes is least among those
that fit into a string of the wanted length (the last one of equals).  So every
such string holds a trigger that depends on its own bytes only, and equal
strings have it at the same place.  A phrase is a trigger with all the strings
that belong to it, 100 to 168 bytes; a text's phrases are its parse.

Parse: equal phrases (by hashes of trigger and phrase) are put in corpus order;
all strings of all but the first are repeated.  Dictionary: phrases that share
a trigger with a different phrase may still share some strings; the suffixes of
just those are sorted, as far as the wanted length, and of each run of equal
ones all but the first in corpus order are repeated.  Phrases whose trigger is
alone, most of a text that isn't repetitive, need neither.

A trigger with many such phrases is not sorted in one place: each task hashes
their strings (128 bits), keeps the first of equal ones, and only these meet, by
hash, those of other tasks.

Each task first settles what repeats within its own texts, so a passage that
many texts share reaches the shuffle once per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, lean_group, materialize, small_batches

TRIGGER = 32
BASE = 0x9E3779B97F4A7C15
#: A random odd number for each byte.
BYTES = np.random.default_rng(11).integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The second half of a string's hash has its own.
BASE2 = 0xD1B54A32D192ED03
BYTES2 = np.random.default_rng(12).integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 1 << 20  # bytes hashed at a time
HELD = 250_000  # phrases a task settles at a time
LANE = 4096  # phrases of a trigger that are sorted together; more are compared string by string
STRINGS = 300_000  # strings of crowded triggers a task settles at a time
SORTED = 1000  # phrases of uncrowded triggers whose strings are sorted at a time, more if a trigger has more


def rolling(buf: np.ndarray, width: int, base: int = BASE, values: np.ndarray = BYTES) -> np.ndarray:
    """Polynomial hash of every ``width`` bytes (mod 2**64), by doubling."""
    h, span, out, have, power = values[buf], 1, None, 0, base
    while True:
        if width & span:
            if out is None:
                out = h
            else:  # the longer part stands in front
                n = min(len(h), len(out) - span) if len(out) > span else 0
                out = h[:n] * np.uint64(pow(base, have, 1 << 64)) + out[span:span + n]
            have += span
        if span * 2 > width:
            return out[:max(0, len(buf) - width + 1)]
        n = max(0, len(h) - span)
        h = h[:n] * np.uint64(power) + h[span:span + n]
        power, span = power * power % (1 << 64), span * 2


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def phrases(buf: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts that end at ``ends``: text number, trigger hash, phrase hash,
    trigger's place, first and last string start, places within the text."""
    reach, none = length - TRIGGER + 1, np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none, none
    hashes = mixed(rolling(buf, TRIGGER))
    # the low bits prefer the last of equals
    least = (hashes >> np.uint64(22) << np.uint64(22)) | (np.uint64((1 << 22) - 1) - np.arange(len(hashes), dtype=np.uint64))
    span = 1
    while span * 2 <= reach:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if reach > span:
        least = np.minimum(least[:span - reach], least[reach - span:])
    place = ((1 << 22) - 1) - (least & np.uint64((1 << 22) - 1)).astype(np.int64)
    starts = np.arange(len(place))
    text = np.searchsorted(ends, starts, side="right")
    whole = starts + length <= ends[text]
    new = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(text) != 0) | (whole[1:] != whole[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    first, last = first[whole[first]], last[whole[first]]
    text, at = text[first], place[first]
    wide, end = rolling(buf, 64), last + length
    spans = -(-(2 * length - TRIGGER) // 64)  # so many times 64 bytes cover the longest phrase
    ident = mixed((end - first).astype(np.uint64) * np.uint64(BASE) + (at - first).astype(np.uint64))
    for k in range(spans):
        ident = mixed(wide[first + (end - 64 - first) * k // (spans - 1)] + ident * np.uint64(5))
    begin = np.concatenate([[0], ends[:-1]])[text]
    return text, hashes[at].view(np.int64), ident.view(np.int64), at - begin, first - begin, last - begin


def slices(column: pa.Array, length: int):
    """Byte columns in runs of whole texts of about SLICE bytes; a longer text in
    overlapping parts.  Yields (first row, place of the part, bytes, ends)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        lo, hi = offsets[row], offsets[stop]
        if hi - lo <= 2 * SLICE:
            yield row, 0, data[lo:hi], offsets[row + 1:stop + 1] - lo
        else:
            for k in range(0, hi - lo, SLICE):
                part = data[lo + k:min(hi, lo + k + SLICE + length - 1)]
                yield row, k, part, np.array([len(part)])
        row = stop


SCHEMA = "kind int, part long, trigger long, phrase long, doc long, sub int, at int, back int, fore int"
NAMES = ["kind", "part", "trigger", "phrase", "doc", "sub", "at", "back", "fore"]
OPEN, MANY, SHARED, REPEATED = 0, 1, 2, 3  # a first phrase, a trigger with several, one of those, a repeated phrase


def settle(parts: list[tuple]) -> pa.RecordBatch:
    """What a task knows of its own phrases.  Repeated ones are told so; the
    first of each remain: alone at their trigger (OPEN), or not (SHARED, with one
    MANY row for the trigger)."""
    doc, sub, trigger, phrase, at, first, last = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((at, sub, doc, phrase, trigger))
    doc, sub, trigger, phrase, at, first, last = (x[order] for x in (doc, sub, trigger, phrase, at, first, last))
    new_t = np.concatenate([[True], trigger[1:] != trigger[:-1]])
    new_p = new_t | np.concatenate([[True], phrase[1:] != phrase[:-1]])
    number = np.cumsum(new_t) - 1
    several = np.bincount(number, new_p) > 1
    kind = np.where(new_p, np.where(several[number], SHARED, OPEN), REPEATED)
    marks = trigger[new_t][several]
    # neighbouring repeated phrases of a text become one row
    apart = mixed((doc.view(np.uint64) * np.uint64(BASE)) ^ at.astype(np.uint64)).view(np.int64)
    rep = np.flatnonzero(kind == REPEATED)
    rep = rep[np.lexsort((first[rep], sub[rep], doc[rep]))]
    joins = np.concatenate([[False], (doc[rep][1:] == doc[rep][:-1]) & (sub[rep][1:] == sub[rep][:-1]) & (first[rep][1:] == last[rep][:-1] + 1)])[:len(rep)]
    head = np.flatnonzero(~joins)
    tail = np.concatenate([head[1:], [len(rep)]])[:len(head)] - 1
    head, tail = rep[head], rep[tail]
    keep = np.flatnonzero(kind != REPEATED)
    zero = np.zeros(len(marks), np.int64)
    cols = {
        "kind": [kind[keep], zero + MANY, np.full(len(head), REPEATED)],
        "part": [np.where(kind[keep] == OPEN, trigger[keep], apart[keep]), marks, apart[head]],
        "trigger": [trigger[keep], marks, trigger[head]], "phrase": [phrase[keep], zero, phrase[head]],
        "doc": [doc[keep], zero, doc[head]], "sub": [sub[keep], zero, sub[head]], "at": [at[keep], zero, at[head]],
        "back": [(at - first)[keep], zero, (at - first)[head]], "fore": [(at - last)[keep], zero, at[head] - last[tail]],
    }
    wide = {"part", "trigger", "phrase", "doc"}
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[n]).astype(np.int64 if n in wide else np.int32)) for n in NAMES], NAMES)


def parse(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            doc, sub = batch["doc"].to_numpy(), batch["sub"].to_numpy()
            for row, shift, buf, ends in slices(batch["bytes"], length):
                text, trigger, phrase, at, first, last = phrases(buf, ends, length)
                parts.append((doc[row + text], sub[row + text], trigger, phrase, *((x + shift).astype(np.int32) for x in (at, first, last))))
                held += len(text)
            if held > HELD:
                yield settle(parts)
                parts, held = [], 0
        if parts:
            yield settle(parts)
    return docs.mapInArrow(lean(run), SCHEMA)


def cut_out(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The bytes of shared phrases: trigger, doc, sub, at, back, fore, piece."""
    wanted = places.groupBy("doc", "sub").agg(F.collect_list(F.struct("trigger", "at", "back", "fore")).alias("places"))

    def run(batches):
        for batch in batches:
            docs_, subs, out = batch["doc"].to_pylist(), batch["sub"].to_pylist(), [[] for _ in range(7)]
            lists = batch["places"]
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            trigger, at, back, fore = (flat.field(i).to_numpy() for i in range(4))
            of = np.repeat(np.arange(len(sizes)), sizes)
            texts = [x.as_py() for x in batch["bytes"]]
            pieces = [texts[t][a - b:a - f + length] for t, a, b, f in zip(of, at, back, fore)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(trigger), pa.array(np.array(docs_, np.int64)[of]), pa.array(np.array(subs, np.int32)[of]),
                 pa.array(at), pa.array(back), pa.array(fore), pa.array(pieces, pa.binary())],
                ["trigger", "doc", "sub", "at", "back", "fore", "piece"])

    return docs.join(wanted, ["doc", "sub"]).select("doc", "sub", "bytes", "places").mapInArrow(
        lean(run), "trigger long, doc long, sub int, at int, back int, fore int, piece binary")


def sort_suffixes(length: int):
    """Repeated strings among the phrases of some triggers, as runs of starts."""
    def run(group):
        trigger, doc, sub, at, back, fore = (group[c].to_numpy() for c in ("trigger", "doc", "sub", "at", "back", "fore"))
        pieces = group["piece"].combine_chunks()
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        order = np.argsort(trigger, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], trigger[order][1:] != trigger[order][:-1], [True]]))
        every = np.lib.stride_tricks.sliding_window_view(data, length)  # of all places, without a copy
        found, k = [], 0
        while k < len(edges) - 1:  # some triggers at a time
            stop = max(k + 1, int(np.searchsorted(edges, edges[k] + SORTED, side="right")) - 1)
            rows, k = order[edges[k]:edges[stop]], stop
            n = back[rows] - fore[rows] + 1
            of = np.repeat(rows, n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            far = back[of] - nth  # from the string's start to its trigger
            # equal strings have equal triggers, and those at the same place
            suffix = np.ascontiguousarray(every[offsets[of] + nth]).view(f"V{length}").ravel()
            rank = np.unique(suffix, return_inverse=True)[1]
            by = np.lexsort((at[of], sub[of], doc[of], far, trigger[of], rank))
            same = np.concatenate([[False], (rank[by][1:] == rank[by][:-1]) & (far[by][1:] == far[by][:-1]) & (trigger[of][by][1:] == trigger[of][by][:-1])])[:len(by)]
            hit = by[same]
            found.append(np.stack([doc[of[hit]], sub[of[hit]], at[of[hit]] - far[hit]]))
        doc, sub, first, last = merged(*np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1))
        return pa.table({"doc": doc, "sub": sub.astype(np.int32), "first": first.astype(np.int32), "last": last.astype(np.int32)})
    return run


def crowded_strings(length: int):
    """Strings of phrases with crowded triggers: the first of equal ones in a task
    by its hash (own 0), the others as runs of starts (own 1)."""
    def settled(batches) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        doc, sub, at, back, fore = (whole[c].to_numpy() for c in ("doc", "sub", "at", "back", "fore"))
        pieces = whole["piece"]
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[:offsets[-1]]
        n = back - fore + 1
        of = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        place, start = offsets[of] + nth, (at - back)[of] + nth
        # equal strings have equal triggers at the same place, so the bytes say all
        a, b = mixed(rolling(data, length)[place]).view(np.int64), mixed(rolling(data, length, BASE2, BYTES2)[place]).view(np.int64)
        doc, sub = doc[of], sub[of]
        by = np.lexsort((start, sub, doc, b, a))
        a, b, doc, sub, start = a[by], b[by], doc[by], sub[by], start[by]
        old = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        new, runs = ~old, merged(doc[old], sub[old].astype(np.int64), start[old].astype(np.int64))
        apart = mixed((runs[0].view(np.uint64) * np.uint64(BASE)) ^ runs[2].astype(np.uint64)).view(np.int64)
        own = np.repeat([0, 1], [int(new.sum()), len(apart)])
        columns = [own, np.concatenate([a[new], apart]), np.concatenate([b[new], apart]),
                   *(np.concatenate([x[new], y]) for x, y in zip((doc, sub, start, start), runs))]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if k in (1, 2, 3) else np.int32)) for k, c in enumerate(columns)],
                                          ["own", "a", "b", "doc", "sub", "first", "last"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            most = max(1, STRINGS // (2 * length))
            for k in range(0, batch.num_rows, most):
                parts.append(batch.slice(k, most))
                held += int((parts[-1]["back"].to_numpy() - parts[-1]["fore"].to_numpy() + 1).sum())
                if held > STRINGS:
                    yield settled(parts)
                    parts, held = [], 0
        if held:
            yield settled(parts)
    return run


def merged(doc: np.ndarray, sub: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """String starts as runs: doc, sub, first, last."""
    by = np.lexsort((start, sub, doc))
    doc, sub, start = doc[by], sub[by], start[by]
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(sub) != 0) | (np.diff(start) > 1)])[:len(by)]
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(by)]])[:len(head)] - 1
    return doc[head], sub[head], start[head], start[tail]


def ordered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` (doc_id, bytes) with ``doc`` and ``sub``, the corpus order;
    whether an id occurs again."""
    docs = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    again = docs.groupBy("doc").count().where("count > 1").select("doc")
    if again.isEmpty():
        return docs.withColumn("sub", F.lit(0)), False
    ranks = (docs.join(again, "doc", "left_semi").select("doc", F.xxhash64("bytes").alias("h")).distinct()
             .withColumn("sub", F.row_number().over(Window.partitionBy("doc").orderBy("h")) - 1))
    return (docs.withColumn("h", F.xxhash64("bytes")).join(ranks, ["doc", "h"], "left").drop("h")
            .withColumn("sub", F.coalesce("sub", F.lit(0)))), True


def repeated_runs(base: DataFrame, length: int) -> DataFrame:
    """``doc, sub, first, last``: runs of starts of repeated strings."""
    rows = parse(base, length).withColumn("own", F.greatest(F.lit(0), F.col("kind") - MANY)).withColumn(
        "phrase", F.when(F.col("kind") != MANY, F.col("phrase")))
    one = Window.partitionBy("own", "part")
    line = one.orderBy("phrase", "doc", "sub", "at")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    several = (F.max("kind").over(every) == MANY) | (F.min("phrase").over(every) != F.max("phrase").over(every))
    again = F.coalesce(F.lag("phrase").over(line) == F.col("phrase"), F.lit(False))
    told = rows.withColumn("several", several).withColumn("again", again)
    told = materialize(
        told.withColumn("kind", F.when((F.col("kind") == OPEN) & F.col("again"), REPEATED)
                        .when((F.col("kind") == OPEN) & F.coalesce("several", F.lit(False)), SHARED).otherwise(F.col("kind")))
        .where(F.col("kind").isin(SHARED, REPEATED)).select("kind", "trigger", "doc", "sub", "at", "back", "fore"))
    shared = told.where(F.col("kind") == SHARED)
    crowds = materialize(shared.groupBy("trigger").agg(F.count("*").alias("n")).where(F.col("n") > LANE).select("trigger"))
    some = not crowds.isEmpty()
    crowds = F.broadcast(crowds)  # one row for LANE of the shared phrases at most
    few = shared.join(crowds, "trigger", "left_anti") if some else shared
    groups = max(64, -(-shared.count() // 8_000))
    pieces = cut_out(base, few, length).withColumn("bin", F.pmod(F.xxhash64("trigger"), F.lit(groups)).cast("int"))
    found = pieces.groupBy("bin").applyInArrow(lean_group(sort_suffixes(length)), "doc long, sub int, first int, last int")
    if some:
        strings = cut_out(base, shared.join(crowds, "trigger", "left_semi"), length).mapInArrow(
            lean(crowded_strings(length)), "own int, a long, b long, doc long, sub int, first int, last int")
        # a hash has a row of each task at most; rows of own 1 are spread and stay
        nth = F.row_number().over(Window.partitionBy("own", "a", "b").orderBy("doc", "sub", "first"))
        found = found.unionAll(strings.withColumn("nth", nth).where("own = 1 or nth > 1").select("doc", "sub", "first", "last"))
    whole = told.where(F.col("kind") == REPEATED).select(
        "doc", "sub", (F.col("at") - F.col("back")).alias("first"), (F.col("at") - F.col("fore")).alias("last"))
    return whole.unionAll(found)


def kept(data: bytes, runs: list, length: int, whole: bool = False) -> tuple[bytes, int, int]:
    """Remaining bytes, number of removed bytes, number of removed runs; with
    ``whole`` characters of UTF-8 that are covered in part stay."""
    spans: list[list[int]] = []
    for first, last in sorted(runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    if whole:
        inside = lambda k: k < len(data) and data[k] & 0xC0 == 0x80
        for s in spans:
            while s[0] < s[1] and inside(s[0]):
                s[0] += 1
            while s[0] < s[1] and inside(s[1]):
                s[1] -= 1
        spans = [s for s in spans if s[0] < s[1]]
    ends = [0, *(e for _, e in spans)]
    out = [data[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(data)])]
    return b"".join(out), sum(e - s for s, e in spans), len(spans)


def remove_repeats(docs: DataFrame, length: int = 100, carry: tuple[str, ...] = (), remains: bool = True, whole: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, with ``remains`` the
    remaining bytes ``kept``, and the columns ``carry``, for every row of
    ``docs`` (doc_id integer, text).  With ``whole``, characters that repeated
    strings cover in part stay, so ``kept`` is valid UTF-8.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a
    smaller doc_id or earlier in the same text.  Null texts are empty; texts
    shorter than ``length`` stay.  Null ids stand first.  Rows with equal id and
    text are one document, judged once and reported each; rows with equal id and
    other texts are documents in the order of a hash of the text.  Texts may be
    of any length up to 2**31 - 1 bytes.  Empty table: no rows.
    """
    if not 95 <= length <= 159:
        raise ValueError("length must be 95 to 159")
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"), *carry)
    base, again = ordered(docs)
    once = base.select("doc", "sub", "bytes")
    runs = repeated_runs(once.dropDuplicates(["doc", "sub"]) if again else once, length)
    lists = runs.groupBy("doc", "sub").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = base.join(lists, ["doc", "sub"], "left").select("doc_id", "bytes", "runs", *carry)
    fields = ["doc_id", *carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*fields).schema)

    def run(batches):
        for batch in batches:
            made = [kept(d.as_py(), [(r["first"], r["last"]) for r in (s.as_py() or ())], length, whole) for d, s in zip(batch["bytes"], batch["runs"])]
            size = [len(d.as_py()) for d in batch["bytes"]]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in fields], pa.array(size, pa.int64()), pa.array([m[1] for m in made], pa.int64()),
                 pa.array([m[2] for m in made], pa.int64()), pa.array([hashlib.sha256(m[0]).hexdigest() for m in made], pa.string()),
                 *[pa.array([m[0] for m in made], pa.binary())] * remains],
                [*fields, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * remains])

    return joined.mapInArrow(lean(run), schema + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                             + ", kept binary" * remains)
