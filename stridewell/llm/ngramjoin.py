"""Exact Jaccard join of word n-gram sets with prefix trees.

Sets are hashed 5-word shingles in one global order, that of their hashes.  One
pass over the texts gives each set its size, a signature, min-hashes, a parity
bitmap and its keys.

Keys.  Sets of sizes a and b link only if they differ in at most
(a + b)(100 - t) / (100 + t) shingles.  A set's shingles are dealt by hash into
groups of at most about GROUP and, within a group, into slightly more parts than
may differ there.  So two linked sets have a group with few enough differences,
and in it a part that is not empty and equal in both: its hash is a key.  Of the
keys of a group only the first in order stay, as many as may differ and one more
(the prefix filter).  The order is the same for all sets and puts rare keys first:
a pass before counts the keys of all parts of all texts in a sketch of CELLS
counters, and keys are ranked by the binary logarithm of their counter.  So a part
that holds no more than a phrase many short texts share is a key only of sets with
too few others.  Any fixed order finds every link; counts only make it cheap.

Bitmaps.  The exclusive or of two parity bitmaps has at most as many ones as the
sets have different shingles, so most pairs with a common key go without a look
at the sets.

Equal sets collapse first.  Each set is compared with the first one of each of
its min-hashes; these links merge groups of copies early, and keys are followed
only between different groups.  Whatever passes is verified.

Verification stores a set's partners as ordered sequences in a tree (sorted, so
that common beginnings are neighbours), walks it once against the set, counts a
shared beginning once, and leaves a branch as soon as the shingles that remain
cannot reach the needed overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, lean, materialize, small_batches

SIZE = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
HASHES = 4  # min-hashes for the early links
LEAST_BAND = 5  # sizes under 2**5 are one band, then each doubling
GROUP, MOST_GROUPS = 10, 11  # as powers of two
TILE = 1024  # sets with one key that a task compares with each other
MOST_WORDS = 200_000  # words a task remembers
SMALL = 1_000_000  # rows of one or two longs that may be broadcast
FLUSH = 3_000_000  # keys a task gathers before they are dealt out
PER_RANGE = 1_500_000  # keys that are sorted together
CELLS = 1 << 19  # counters of the sketch of keys


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Texts -> their sets of shingle hashes, sorted."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}

    def hashes(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts, and how many each text has (with repeats)."""
        if len(self.numbers) > MOST_WORDS:
            self.numbers.clear()
        known, flat, size = self.numbers, [], []
        for text in texts:
            words = (text or b"").lower().split()  # of bytes: just A-Z; just the space and the controls 9-13
            flat += words
            size.append(len(words))
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(flat).difference(known))
        w, size = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat)), np.array(size, np.int64)
        ends = np.cumsum(size)
        # a text of fewer words is one shingle, all of it
        h = np.zeros(len(w), np.uint64)
        span = np.minimum(np.repeat(size, size), SIZE)
        left = np.repeat(ends, size) - np.arange(len(w))
        for k in range(SIZE):
            n = max(0, len(w) - k)
            part = h[:n] * BASE + w[k:]
            h[:n] = np.where(span[:n] > k, part, h[:n])
        whole = left >= span
        count = np.where(size == 0, 0, np.maximum(size - SIZE + 1, 1))
        return mixed(h[whole] + span[whole].astype(np.uint64)), count

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        h, count = self.hashes(texts)
        ends = np.cumsum(count)
        return [np.unique(h[e - n:e]) for e, n in zip(ends, count)]


def needed(a: int, b: int, t: int) -> int:
    """Least intersection of sets of sizes a and b at a similarity of t percent."""
    return -(-t * (a + b) // (100 + t))


def band_of(n: np.ndarray) -> np.ndarray:
    """Number of bits of sizes, LEAST_BAND at least: a band's sizes are under 2**band."""
    return np.maximum(LEAST_BAND, np.frexp(n.astype(np.float64))[1])


def groups_of(band: np.ndarray) -> np.ndarray:
    """Groups of a set of a band, as a power of two."""
    return np.clip(band - GROUP, 0, MOST_GROUPS)


class Cutter:
    """Keys and bitmaps of sets; several sets, one after the other, at a time.

    ``ranks``: of each cell, how common its keys are; keys of low rank come first.
    """

    def __init__(self, t: int, ranks: np.ndarray | None = None):
        if not 60 <= t <= 100:
            raise ValueError("t must be 60 to 100")
        self.t = t
        self.ranks = np.zeros(CELLS, np.uint8) if ranks is None else ranks

    def may_differ(self, n: np.ndarray) -> np.ndarray:
        """Most differences from any set that a set of size n links with."""
        return n * (100 - self.t) // self.t

    def bitmaps(self, every: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Parity bitmaps of 2**(band + 1) bits.  The upper half folds onto the lower
        as a set moves to the band below; a group's bits stand together."""
        bits = np.int64(2) << band_of(size).astype(np.int64)
        starts = np.cumsum(bits) - bits
        at = np.repeat(starts, size) + (place(every) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
        odd = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
        packed = np.packbits(odd, bitorder="little")
        return [packed[a // 8:(a + b) // 8].tobytes() for a, b in zip(starts, bits)]

    def bands(self, every: np.ndarray, size: np.ndarray) -> list[tuple]:
        """The arguments of ``filled`` and ``least``, ``size`` of ``first`` for the
        sets' own bands and, of those near its lower end, the band below."""
        band = band_of(size)
        of = np.repeat(np.arange(len(size)), size)
        # a set that links with some of the band below has keys there as well
        lower = (size > 0) & (band > LEAST_BAND) & (size * self.t <= 100 << np.maximum(band - 1, 0))
        tags = place(every), mixed(every ^ BASE), every
        own = np.flatnonzero(size)
        number = np.full(len(size), -1)
        number[own] = np.arange(len(own))
        out = [((number[of], *tags, own, band[own]), size[own], size[own])]
        if lower.any():
            some = np.flatnonzero(lower)
            number = np.full(len(size), -1)
            number[some] = np.arange(len(some))
            mine = lower[of]
            out.append(((number[of[mine]], *(x[mine] for x in tags), some, band[some] - 1), np.minimum(size[some], (1 << (band[some] - 1)) - 1), size[some]))
        return out

    def keys(self, every: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, number of the set, and slot (64 * group + band; 0: a single shingle)."""
        return tuple(np.concatenate(x) for x in zip(*(self.first(*args) for args in self.bands(every, size))))

    def all_keys(self, every: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The keys of all parts that are not empty."""
        return np.concatenate([self.filled(*args)[0] for args, _, _ in self.bands(every, size)])

    def filled(self, of, where, value, every, who, band):
        """Of all parts that are not empty: key, index into ``who``, group, and the
        number of that group among those of all sets.  ``of``: index into ``who``
        for shingles, in order."""
        g = groups_of(band)
        parts = ((((1 << band) >> g) * (100 - self.t) * 27) // (25 * self.t)) + 3
        first = np.cumsum(parts << g) - (parts << g)
        width = (band + 1 - g).astype(np.uint64)
        group = ((where & ((np.uint64(2) << band.astype(np.uint64)) - np.uint64(1))[of]) >> width[of]).astype(np.int64)
        part = ((value >> np.uint64(20)) % parts[of].astype(np.uint64)).astype(np.int64)
        cell = first[of] + group * parts[of] + part
        total = int((parts << g).sum())
        # sums of 44 bits are exact in a double for up to 512 shingles of a part
        sums = np.bincount(cell, (value & np.uint64((1 << 44) - 1)).astype(np.float64), total)
        used = np.flatnonzero(np.bincount(cell, minlength=total))
        mine = np.searchsorted(first, used, side="right") - 1
        inner = used - first[mine]
        in_group = inner // parts[mine]
        key = mixed(sums[used].astype(np.uint64) ^ mixed((inner.astype(np.uint64) << np.uint64(8)) + band[mine].astype(np.uint64) + BASE))
        return key, mine, in_group, (np.cumsum(1 << g) - (1 << g))[mine] + in_group

    def first(self, args, least, size):
        """The keys that stay of one band.  ``least``: the smaller size of a pair at most."""
        of, _, _, every, who, band = args
        g = groups_of(band)
        room = self.may_differ(least) >> g  # differences in the group that has fewest
        key, mine, in_group, box = self.filled(*args)
        order = np.lexsort((key, self.ranks[cell_of(key)], box))
        key, mine, in_group, box = key[order], mine[order], in_group[order], box[order]
        begin = np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]]))[:len(box)]
        count = np.diff(np.append(begin, len(box)))
        nth = np.arange(len(box)) - np.repeat(begin, count)
        stay = nth <= room[mine]
        key, number, slot = key[stay], who[mine[stay]], (64 * in_group + band[mine])[stay]
        # a group with so few filled parts that all may differ: the set's first shingles are keys, too
        filled = np.bincount(box, minlength=int((1 << g).sum()))
        sparse = np.unique(np.repeat(np.arange(len(who)), 1 << g)[filled <= np.repeat(room, 1 << g)])
        for k in sparse:
            own = np.sort(every[np.searchsorted(of, k):np.searchsorted(of, k, side="right")])[:int(size[k]) - int(needed(int(size[k]), -(-int(size[k]) * self.t // 100), self.t)) + 1]
            key, number, slot = np.append(key, mixed(own + BASE)), np.append(number, np.full(len(own), who[k])), np.append(slot, np.zeros(len(own), int))
        return key, number, slot


def place(every: np.ndarray) -> np.ndarray:
    """Where shingles stand in bitmaps and groups."""
    return mixed(every + np.uint64(12345))


def cell_of(key: np.ndarray) -> np.ndarray:
    """Where keys are counted."""
    return ((key >> np.uint64(7)) & np.uint64(CELLS - 1)).astype(np.int64)


def batch_sets(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sets one after the other, and their sizes."""
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.array([len(x) for x in sets], np.int64)


def key_ranks(docs: DataFrame, t: int) -> np.ndarray:
    """How common the keys of each cell are in all texts: binary logarithms of
    counts.  A task hands on at most a number for each cell, and Spark sums them."""
    def count(batches):
        s, cutter, total = Shingler(), Cutter(t), np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                every, size = batch_sets(s.sets(batch["text"].slice(at, 250).to_pylist()))
                if len(every):
                    total += np.bincount(cell_of(cutter.all_keys(every, size)), minlength=CELLS)
        cell = np.flatnonzero(total)
        for at in range(0, len(cell), 1 << 16):
            some = cell[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])

    counted = docs.select("text").mapInArrow(lean(count), "cell int, n long").groupBy("cell").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("rank"))
    found, ranks = counted.toArrow(), np.zeros(CELLS, np.uint8)
    ranks[found["cell"].to_numpy()] = found["rank"].to_numpy()
    return ranks


def one_pass(docs: DataFrame, ranges: int, t: int, ranks: np.ndarray) -> DataFrame:
    """kind 0: a row per text with the size, a 128-bit signature, min-hashes and
    the bitmap (``data``) of its set; kind 1: ``uid, n`` a slot and ``s1`` a key
    that several sets have."""
    fields = ["kind", "uid", "n", "s1", "s2", *[f"m{k}" for k in range(HASHES)], "data"]
    schema = "kind int, uid long, n long, s1 long, s2 long, " + ", ".join(f"m{k} long" for k in range(HASHES)) + ", data binary"
    shift = np.uint64(64 - (ranges - 1).bit_length())

    def run(batches):
        s, cutter, held, n_held = Shingler(), Cutter(t, ranks), [], 0

        def dealt():
            """Keys by range: those keys, indices into the texts' ids, slots, ids."""
            key, of, slot = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            key, of, slot = key[order], of[order], slot[order].astype(np.uint16)
            box = (key >> shift).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]]))[:len(box)]
            count = np.diff(np.append(begin, len(box)))
            data, n_ids = [], []
            for a, n in zip(begin, count):
                ids, index = np.unique(of[a:a + n], return_inverse=True)
                data.append(ids.tobytes() + key[a:a + n].tobytes() + index.astype(np.uint32).tobytes() + slot[a:a + n].tobytes())
                n_ids.append(len(ids))
            zero = pa.array(np.zeros(len(begin), np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(box[begin].astype(np.int32)), pa.array(np.ones(len(begin), np.int32)), zero, pa.array(count), pa.array(np.array(n_ids, np.int64)),
                 *[zero] * (1 + HASHES), pa.array(data, pa.binary())], ["box", *fields])

        for batch in batches:
            uid = batch["uid"].to_numpy()
            for at in range(0, len(uid), 250):
                sets, ids = s.sets(batch["text"].slice(at, 250).to_pylist()), uid[at:at + 250]
                every, size = batch_sets(sets)
                some = np.flatnonzero(size)
                starts = (np.cumsum(size) - size)[some]
                cols = np.zeros((2 + HASHES, len(size)), np.uint64)
                for j in range(2 + HASHES if len(some) else 0):
                    m = mixed(every ^ np.uint64(int(BASE) * (2 * j + 1) % (1 << 64)))
                    cols[j, some] = (np.add if j < 2 else np.minimum).reduceat(m, starts)
                box = ranges + (mixed(ids.view(np.uint64) * BASE) % np.uint64(ranges)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(box.astype(np.int32)), pa.array(np.zeros(len(size), np.int32)), pa.array(ids), pa.array(size),
                     *[pa.array(c.view(np.int64)) for c in cols], pa.array(cutter.bitmaps(every, size), pa.binary())], ["box", *fields])
                if len(some):
                    key, number, slot = cutter.keys(every, size)
                    held.append((key, ids[number], slot))
                    n_held += len(key)
                if n_held > FLUSH:
                    yield dealt()
                    held, n_held = [], 0
        if held:
            yield dealt()

    def shared(group):
        """Keys of a range that several texts have; rows of kind 0 pass."""
        if group["kind"][0].as_py() == 0:
            return group.drop_columns(["box"])
        keys, ids, slots = [], [], []
        for n, m, data in zip(group["n"].to_pylist(), group["s1"].to_pylist(), group["data"]):
            data = data.as_py()
            own = np.frombuffer(data, np.int64, m)
            keys.append(np.frombuffer(data, np.uint64, n, 8 * m))
            ids.append(own[np.frombuffer(data, np.uint32, n, 8 * (m + n))])
            slots.append(np.frombuffer(data, np.uint16, n, 8 * m + 12 * n))
        key = np.concatenate(keys)
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        often = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, order = key[often], order[often]
        zero = pa.array(np.zeros(len(key), np.int64))
        return pa.table([pa.array(np.ones(len(key), np.int32)), pa.array(np.concatenate(ids)[order]), pa.array(np.concatenate(slots)[order].astype(np.int64)),
                         pa.array(key.view(np.int64)), *[zero] * (1 + HASHES), pa.nulls(len(key), pa.binary())], fields)

    return docs.select("uid", "text").mapInArrow(lean(run), "box int, " + schema).groupBy("box").applyInArrow(shared, schema)


def ones(a: pa.Array, i: np.ndarray, b: pa.Array, j: np.ndarray) -> np.ndarray:
    """Ones in the exclusive or of bitmaps a[i] and b[j]; the longer one of two is folded."""
    def parts(column):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        return offsets[:-1], np.diff(offsets), np.frombuffer(column.buffers()[2] or b"", np.uint8)

    (at_a, len_a, data_a), (at_b, len_b, data_b) = parts(a), parts(b)
    out = np.zeros(len(i), np.int64)
    sizes = len_a[i] << 32 | len_b[j]
    for pair in np.unique(sizes):
        la, lb = int(pair >> 32), int(pair & 0xFFFFFFFF)
        size = min(la, lb)
        if size == 0:
            continue
        rows = np.flatnonzero(sizes == pair)
        for k in range(0, len(rows), max(1, (1 << 23) // max(la, lb))):
            some = rows[k:k + max(1, (1 << 23) // max(la, lb))]
            x, y = (data[at[who[some]][:, None] + np.arange(n)].view(np.uint64)
                    for data, at, who, n in ((data_a, at_a, i, la), (data_b, at_b, j, lb)))
            while x.shape[1] > y.shape[1]:
                x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
            while y.shape[1] > x.shape[1]:
                y = y[:, :y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
            out[some] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def alike(na: np.ndarray, nb: np.ndarray, t: int) -> np.ndarray:
    return np.minimum(na, nb) * 100 >= np.maximum(na, nb) * t


def screen(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose bitmaps let them link, with ``w`` the size of b."""
    def run(batches):
        for batch in batches:
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            each = np.arange(len(na))
            ok = alike(na, nb, t) & (ones(batch["bits_a"], each, batch["bits_b"], each) <= (na + nb) * (100 - t) // (100 + t))
            yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(ok)) for c in ("a", "b", "nb")], ["a", "b", "w"])

    x, y = (sets.select(F.col("uid").alias(c), F.col("n").alias(f"n{c}"), F.col("data").alias(f"bits_{c}")) for c in "ab")
    return (pairs.join(y, "b").where("nb > 0").join(x, "a").select("a", "b", "na", "nb", "bits_a", "bits_b")
            .mapInArrow(lean(run), "a long, b long, w long"))


def tree_order(partners: list[np.ndarray]) -> list[int]:
    """The order in which the partners' sequences stand in their tree."""
    return sorted(range(len(partners)), key=lambda i: partners[i].astype(">u8").tobytes())


def tree_links(a_set: np.ndarray, partners: list[np.ndarray], order, t: int) -> list[int]:
    """Those numbers in ``order`` (a part of tree_order) whose partners reach the
    similarity, by one walk of their tree."""
    found, n = [], len(a_set)
    path, counts, dead = np.zeros(0, np.uint64), np.zeros(1, np.int64), None
    for who in order:
        seq = partners[who]
        same = min(len(path), len(seq))
        differs = np.flatnonzero(path[:same] != seq[:same])
        depth = int(differs[0]) if len(differs) else same
        m, need = len(seq), needed(n, len(seq), t)
        if min(n, m) < need:
            continue
        if dead is not None and depth >= dead[0] and dead[1] + min(m - dead[0], dead[2]) < need:
            continue  # the branch was left above where this one begins
        depth = min(depth, len(counts) - 1)
        dead, stop = None, depth
        have = counts[:depth + 1]
        while stop < m:
            part = seq[stop:stop + 64]
            at = np.searchsorted(a_set, part)
            hit = a_set[np.minimum(at, n - 1)] == part
            have = np.concatenate([have, have[-1] + np.cumsum(hit)])
            stop += len(part)
            rest = n - int(np.searchsorted(a_set, part[-1], side="right"))
            if have[-1] + min(m - stop, rest) < need:
                dead = (stop, int(have[-1]), rest)
                break
        path, counts = seq[:stop], have
        if dead is None and have[m] >= need:
            found.append(who)
    return found


def verify(docs: DataFrame, pairs: DataFrame, t: int) -> DataFrame:
    """The links among ``pairs(a, b, w)`` of uids of ``docs(uid, text)``; w: the
    size of b.  A set with many partners meets them in several tasks."""
    spark = docs.sparkSession
    pairs = materialize(pairs)
    members = materialize(pairs.select(F.col("a").alias("uid")).unionAll(pairs.select("b")).distinct())

    def encode(batches):
        s = Shingler()
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                sets = s.sets(batch["text"].slice(k, 200).to_pylist())
                yield pa.RecordBatch.from_arrays([batch["uid"].slice(k, 200), pa.array([x.tobytes() for x in sets], pa.binary())], ["uid", "seq"])

    few = members.count() <= SMALL
    sets = materialize(docs.select("uid", "text").join(F.broadcast(members) if few else members, "uid").mapInArrow(lean(encode), "uid long, seq binary"))
    parts = pairs.groupBy("a").agg(F.ceil(F.sum("w") / (1 << 17)).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    wanted = (dealt.select("a", "part", F.lit(1).alias("side"), F.col("b").alias("uid"))
              .unionAll(dealt.select("a", "part").distinct().select("a", "part", F.lit(0), "a")))
    total = pairs.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    bins = max(spark.sparkContext.defaultParallelism, -(-total // (1 << 20)))
    rows = wanted.join(sets, "uid").withColumn("nth", F.pmod(F.xxhash64("a", "part"), F.lit(bins)))

    def walk(group):
        a, part, side, uid = (group[c].to_numpy() for c in ("a", "part", "side", "uid"))
        seq = group["seq"].combine_chunks()
        order = np.lexsort((side, part, a))
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(part[order]) != 0), [True]]))
        out = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = [np.frombuffer(seq[int(i)].as_py(), np.uint64) for i in order[lo:hi]]
            partners = own[1:]  # the set itself stands first
            out += [(a[order[lo]], uid[order[lo + 1 + k]]) for k in tree_links(own[0], partners, tree_order(partners), t)]
        out = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    found = materialize(rows.groupBy("nth").applyInArrow(walk, "a long, b long"))
    discard(pairs, members, sets)
    return found


def block_pairs(t: int):
    """Pairs of sets of different groups with a common key whose bitmaps let them link."""
    def run(group):
        key, left, right, tile, uid, grp, n, power = (group[c].to_numpy() for c in ("key", "i", "j", "tile", "uid", "grp", "n", "power"))
        bits = group["bits"].combine_chunks()
        order = np.lexsort((tile, right, left, key))
        key, left, right = key[order], left[order], right[order]
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]), [True]]))
        begin, count = edges[:-1], np.diff(edges)
        inside = left[begin] == right[begin]
        found = [np.zeros((2, 0), np.int64)]

        def test(i, j):
            i, j = order[i], order[j]
            ok = (grp[i] != grp[j]) & alike(n[i], n[j], t)
            i, j = i[ok], j[ok]
            room = ((n[i] + n[j]) * (100 - t) // (100 + t)) >> power[i]
            ok = ones(bits, i, bits, j) <= room
            found.append(np.unique(np.sort(np.stack([uid[i[ok]], uid[j[ok]]]), axis=0), axis=1))

        for c in np.unique(count[inside & (count <= 32)]):  # equally many rows at a time
            at = begin[inside & (count == c)]
            x, y = np.triu_indices(c, 1)
            for k in range(0, len(at), max(1, 100_000 // max(1, len(x)))):
                some = at[k:k + max(1, 100_000 // max(1, len(x)))][:, None]
                test((some + x).ravel(), (some + y).ravel())
        for b, c, one in zip(begin, count, inside):
            if one and c <= 32:
                continue
            own = tile[order[b:b + c]]
            xs = np.arange(b, b + c) if one else b + np.flatnonzero(own == left[b])
            ys = xs if one else b + np.flatnonzero(own == right[b])
            for k in range(0, len(xs), 64):
                i, j = (m.ravel() for m in np.meshgrid(xs[k:k + 64], ys, indexing="ij"))
                test(i[i < j] if one else i, j[i < j] if one else j)
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})
    return run


def key_pairs(keyed: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs ``a, b`` from ``keyed(key, slot, uid, grp)``: sets of different groups
    with a common key, screened by their bitmaps within the key's group of shingles.

    Keys with over TILE sets are cut into tiles; a tile of one group's sets only is
    not compared with others of that group."""
    spark = keyed.sparkSession
    open_ = keyed.groupBy("key", "slot").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("c")).where("lo != hi").select("key", "slot", "c")
    band, group = F.col("slot") % 64, F.floor(F.col("slot") / 64)
    power = F.when(band > 0, F.greatest(F.lit(0), F.least(band - GROUP, F.lit(MOST_GROUPS)))).otherwise(F.lit(0))
    # bytes of the bitmap of a set of that band, of one group in it
    whole, one = F.pow(F.lit(2.0), band - 2).cast("long"), F.pow(F.lit(2.0), band - 2 - power).cast("long")
    at, size = (group * one + 1).cast("int"), one.cast("int")
    piece = F.col("data").substr(at, size)
    bits = (F.when(band == 0, F.lit(b"")).when(F.length("data") <= whole, piece)
            .otherwise(F.concat(piece, F.col("data").substr((whole + group * one + 1).cast("int"), size))))
    rows = materialize(keyed.join(open_, ["key", "slot"]).join(sets.select("uid", "n", "data"), "uid")
                       .select("key", "slot", "c", "uid", "grp", "n", power.cast("int").alias("power"), bits.alias("bits")))
    base = ["key", "slot", "uid", "grp", "n", "power", "bits"]
    plain = rows.where(F.col("c") <= TILE).select(*base, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("tile"))
    hot = rows.where(F.col("c") > TILE)
    of_group = hot.groupBy("key", "slot", "grp").agg(F.count("*").alias("g"))
    large = of_group.where(F.col("g") > TILE // 4)
    rest = of_group.where(F.col("g") <= TILE // 4).groupBy("key", "slot").agg(F.sum("g").alias("r"))
    nth = F.when(F.col("g").isNotNull(), F.xxhash64("grp", F.pmod(F.xxhash64("uid"), F.ceil(F.col("g") / TILE)))).otherwise(
        F.pmod(F.xxhash64("uid"), F.ceil(F.coalesce("r", F.lit(1)) / TILE)))
    tiled = (hot.join(large, ["key", "slot", "grp"], "left").join(rest, ["key", "slot"], "left")
             .select(*base, nth.alias("tile"), F.when(F.col("g").isNotNull(), F.col("grp")).alias("own")))
    tiles = tiled.select("key", "slot", "tile", "own").distinct()
    x, y = (tiles.select("key", "slot", F.col("tile").alias(c), F.col("own").alias(f"own_{c}")) for c in "ij")
    met = x.join(y, ["key", "slot"]).where("i <= j and not coalesce(own_i = own_j, false)").select("key", "slot", "i", "j")
    ends = met.select("key", "slot", "i", "j", F.col("i").alias("tile")).unionAll(met.where("i < j").select("key", "slot", "i", "j", "j"))
    crowded = tiled.drop("own").join(ends, ["key", "slot", "tile"]).select(*base, "i", "j", "tile")
    bins = max(spark.sparkContext.defaultParallelism, -(-rows.count() // 20_000))
    every = plain.unionAll(crowded) if not hot.isEmpty() else plain
    every = every.withColumn("nth", F.pmod(F.xxhash64("key", "slot", "i", "j"), F.lit(bins)))
    found = materialize(every.groupBy("nth").applyInArrow(block_pairs(t), "a long, b long"))
    discard(rows)
    return found.distinct()


def similar_sets(docs: DataFrame, t: int = 80) -> DataFrame:
    """``uid, n_shingles, grp`` for ``docs(uid, text)`` of unique uids: the
    smallest uid that links of at least ``t`` percent similarity reach."""
    small_batches(docs.sparkSession)
    length = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranges = 1 << max(4, (length // 20 // PER_RANGE).bit_length())  # about a key for twenty bytes
    seen = materialize(one_pass(docs, ranges, t, key_ranks(docs, t)))
    rows = seen.where("kind = 0")
    sets = rows.select("uid", "n", "data")
    full = rows.where("n > 0")
    alike_ = ["s1", "s2", "n", *[f"m{k}" for k in range(HASHES)]]
    reps = materialize(full.groupBy(*alike_).agg(F.min("uid").alias("uid")))
    # early links: each set with the first one of each of its min-hashes
    keyed = reps.select("uid", "n", F.posexplode(F.array(*[f"m{k}" for k in range(HASHES)])).alias("k", "m"))
    heads = keyed.groupBy("k", "m").agg(F.min("uid").alias("a"), F.min_by("n", "uid").alias("n_a"), F.count("*").alias("c")).where("c > 1").drop("c")
    early = (keyed.join(heads, ["k", "m"]).where((F.col("a") != F.col("uid")) & (F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * t))
             .select("a", F.col("uid").alias("b")).distinct())
    links = verify(docs, screen(early, sets, t), t)
    ids = reps.select(F.col("uid").alias("id"))
    groups = materialize(components(ids, links).select(F.col("id").alias("uid"), F.col("component").alias("grp")))
    # the exact search between groups; sets that stand for no group have none
    across = seen.where("kind = 1").select(F.col("s1").alias("key"), F.col("n").alias("slot"), "uid").join(groups, "uid")
    more = verify(docs, screen(key_pairs(across, sets, t), sets, t), t)
    ends = materialize(components(ids, links.unionAll(more)).withColumnRenamed("id", "uid"))
    by_set = reps.join(ends, "uid").select("s1", "s2", "n", F.col("component").alias("grp"))
    out = rows.join(by_set, ["s1", "s2", "n"], "left")
    return out.select("uid", F.col("n").alias("n_shingles"), F.coalesce("grp", "uid").alias("grp"))


def ngram_components(docs: DataFrame, t: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id
    long, text).

    Texts are lower-cased (A-Z) and cut at white space; a set holds the distinct
    5-word shingles, of a text with fewer words the whole of it.  Sets link when
    100 * intersection >= t * union, ``t`` from 60 to 100.  Null, empty and blank
    texts have 0 shingles and stand alone.  Null ids: such a row takes part, its
    component is the smallest id that is not null, null if there is none.
    Repeated ids: each row takes part by its own text.  Shingles and sets are
    known by 64- and 128-bit hashes.  Extra columns are ignored; an empty table
    gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    again = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if again.isEmpty():
        return similar_sets(docs.select(F.col("doc_id").cast("long").alias("uid"), "text"), t).select(
            F.col("uid").alias("doc_id"), "n_shingles", F.col("grp").alias("component_id"))
    docs = materialize(docs.withColumn("uid", F.monotonically_increasing_id()))
    found = similar_sets(docs, t).join(docs.select("uid", "doc_id"), "uid")
    least = found.groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "grp").select("doc_id", "n_shingles", "component_id")
