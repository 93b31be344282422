"""Near-duplicate, join and search operators against brute force."""

import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from stridewell.llm import catalog, neardup, ngramjoin, topk

DOCS = "doc_id long, text string, uid string, n int, grp int"
VECTORS = "vec_id long, embedding array<float>, label int, rep int, score double"


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def texts():
    r = random.Random(4)
    word = lambda n: "w%d" % int(r.paretovariate(0.6) % n)
    base = [" ".join(word(300) for _ in range(r.choice([3, 6, 12, 40, 90, 300]))) for _ in range(40)]
    base += [" ".join(word(3000) for _ in range(n)) for n in (900, 1100, 2300)]
    out = list(base)
    for t in base:
        for _ in range(r.choice([0, 1, 2, 6])):
            w = t.split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = word(300)
            out.append(" ".join(w).upper() if r.random() < 0.3 else "\t".join(w) + "\n")
    out += ["", None, " \t ", "one", "ONE", "one two", "É é", "é é", "a b c d e f", "x " * 40_000, "x " * 39_000]
    out += [f"common head of five words and {w}" for w in ("a", "b", "c")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"TILE": 2, "FLUSH": 500, "PER_RANGE": 100, "SMALL": 0}, {"HASHES": 1, "TILE": 3, "SMALL": 0}])
def test_ngram_join_finds_every_link(spark, monkeypatch, options):
    for name, value in options.items():
        monkeypatch.setattr(ngramjoin, name, value)
    rows = [(3 * i, t, "u", 1, 2) for i, t in enumerate(texts())]
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 30
    want = [(r[0], len(s), rows[c][0]) for r, s, c in zip(rows, sets, components(len(rows), links))]
    got = ngramjoin.ngram_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_ngram_join_with_null_and_repeated_ids(spark):
    t = "a b c d e f g h i j k l m n o p"
    rows = [(5, t, "", 0, 0), (5, "other words stand here now", "", 0, 0), (None, t, "", 0, 0), (None, "z", "", 0, 0), (7, t, "", 0, 0), (7, t, "", 0, 0)]
    got = sorted(ngramjoin.ngram_components(spark.createDataFrame(rows, DOCS)).collect(), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, 12, 5), (5, 1, 5), (None, 12, 5), (None, 1, None), (7, 12, 5), (7, 12, 5)]))
    assert ngramjoin.ngram_components(spark.createDataFrame([], DOCS)).collect() == []


def test_tree_walk_equals_set_arithmetic():
    r = np.random.default_rng(1)
    for _ in range(60):
        a = np.unique(r.integers(0, 400, r.integers(1, 250)).astype(np.uint64))
        partners = []
        for k in range(30):
            keep = a[r.random(len(a)) < r.choice([0.7, 0.9, 0.95, 1])]
            partners.append((k, np.unique(np.concatenate([keep, r.integers(0, 400, r.integers(1, 20)).astype(np.uint64)]))))
        want = {k for k, b in partners if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        seqs = [b for _, b in partners]
        assert set(ngramjoin.tree_links(a, seqs, ngramjoin.tree_order(seqs), 80)) == want


def short_texts(n, phrase="the same five words here"):
    """Twelve words each, five of them the same in all."""
    r = random.Random(phrase)
    return [" ".join([phrase, *(f"w{r.randrange(10 ** 9)}" for _ in range(7))]) for _ in range(n)]


def test_a_common_phrase_is_no_key_of_short_texts(spark):
    own = [(i, t) for i, t in enumerate(t for k in range(6) for t in short_texts(600, f"the same five words {k}"))]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    ranks = ngramjoin.key_ranks(docs, 80)
    sets = ngramjoin.Shingler().sets([t.encode() for _, t in own])
    every, size = ngramjoin.batch_sets(sets)
    most = [np.unique(ngramjoin.Cutter(80, x).keys(every, size)[0], return_counts=True)[1].max() for x in (None, ranks)]
    assert most[0] > 200 and most[1] < 50
    # in all counters stands each key of each part, in any number of partitions
    assert (ranks == ngramjoin.key_ranks(docs.repartition(7), 80)).all()


def test_short_texts_with_a_common_phrase_and_some_links(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "TILE", 16)
    own = short_texts(300)
    rows = [(i, t, "", 0, 0) for i, t in enumerate(own)]
    rows += [(1000 + i, t + " more", "", 0, 0) for i, t in enumerate(own) if i % 9 == 0]  # eight shingles of nine
    got = {r.doc_id: r.component_id for r in ngramjoin.ngram_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, *_ in rows}


@pytest.mark.parametrize("ranked", [False, True])
def test_linked_sets_share_a_key_within_its_bounds(ranked):
    """No pair at or just over the similarity is lost, whatever the sizes and the order of keys."""
    r = np.random.default_rng(7)
    cutter, met = ngramjoin.Cutter(80, r.integers(0, 20, ngramjoin.CELLS).astype(np.uint8) if ranked else None), 0
    for n in [1, 2, 4, 5, 6, 9, 15, 25, 30, 31, 32, 40, 63, 64, 100, 127, 130, 255, 256, 300, 1000, 1023, 1024, 1100, 2000, 2048, 2500, 5000, 20_000]:
        for trial in range(12 if n < 3000 else 3):
            a = np.unique(r.integers(0, 2 ** 63, n, dtype=np.uint64))
            m = r.integers(len(a), len(a) * 100 // 80 + 1)  # the other set's size; the least overlap that links
            both = ngramjoin.needed(len(a), int(m), 80)
            b = np.unique(np.concatenate([r.permutation(a)[:both], r.integers(0, 2 ** 63, m - both, dtype=np.uint64)]))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            met += 1
            size = np.array([len(a), len(b)])
            key, number, slot = cutter.keys(np.concatenate([a, b]), size)
            mine, other = (set(zip(key[number == k].tolist(), slot[number == k].tolist())) for k in (0, 1))
            assert mine & other, (n, m)
            bits = pa.array(cutter.bitmaps(np.concatenate([a, b]), size), pa.binary())
            apart = ngramjoin.ones(bits, np.array([0]), bits, np.array([1]))[0]
            assert apart <= len(a) + len(b) - 2 * both
            good = []
            for _, s in mine & other:  # in one of these groups the bitmaps admit the pair, as key_pairs cuts them
                power = int(ngramjoin.groups_of(np.array([s % 64]))[0]) if s else 0
                one, whole = (1 << (s % 64 - 2 - power), 1 << (s % 64 - 2)) if s else (0, 0)
                cut = [x.as_py()[s // 64 * one:s // 64 * one + one] + (x.as_py()[whole + s // 64 * one:whole + (s // 64 + 1) * one] if len(x.as_py()) > whole else b"")
                       for x in bits] if s else [b"", b""]
                cut = pa.array(cut, pa.binary())
                good.append(ngramjoin.ones(cut, np.array([0]), cut, np.array([1]))[0] <= ((len(a) + len(b)) * 20 // 180) >> power)
            assert any(good), (n, m)
    assert met > 150


def vectors():
    r = np.random.default_rng(2)
    rows, nan, inf = [], float("nan"), float("inf")
    for label in (0, 1, 2):
        for c in range(12):
            centre = r.normal(size=16)
            for _ in range(r.integers(1, 7)):
                rows.append([(centre + r.normal(size=16) * r.choice([0.01, 0.05, 0.1, 0.13])).tolist(), label])
    rows += [[[0.0] * 16, 1], [[nan] + [1.0] * 15, 1], [[inf] + [1.0] * 15, 1], [None, 1], [[None] + [1.0] * 15, 1], [[1.0] * 16, None],
             [[1.0] * 16, 2], [[1.0] * 16, 2], [[2.0] * 16, 2], [[1e-30] * 16, 2], [[1e30] * 16, 2], [[], 2], [[], 2]]
    return [(i, e, k, 9, 0.5) for i, (e, k) in enumerate(rows)]


def brute(rows, threshold=0.98):
    unit = {}
    for i, e, k, *_ in rows:
        if k is not None and e and None not in e and np.isfinite(np.array(e, np.float32)).all() and np.any(e):
            x = np.array(e, np.float32).astype(float)
            unit[i] = (k, x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    return [(i, j) for i, j in itertools.combinations(sorted(unit), 2) if unit[i][0] == unit[j][0] and unit[i][1] @ unit[j][1] >= threshold]


@pytest.mark.parametrize("tile_rows", [4, 512])
def test_near_duplicates_equal_brute_force(spark, tile_rows):
    rows = vectors()
    links = brute(rows)
    root = components(len(rows), links)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    want = [(i, int(degree[i]), root[i], root[i] == i) for i in range(len(rows))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, VECTORS), tile_rows=tile_rows).collect()
    assert sorted(map(tuple, got)) == want
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_near_duplicates_with_repeated_ids(spark):
    rows = [(7, [1.0, 0.0], 1, 0, 0.0), (7, [0.0, 1.0], 1, 0, 0.0), (9, [0.0, 2.0], 1, 0, 0.0), (9, [0.0, 1.0], 1, 0, 0.0), (3, [1.0, 0.01], 1, 0, 0.0), (7, [1.0, 0.0], 2, 0, 0.0)]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == sorted([(7, 1, 3, False), (7, 2, 7, True), (9, 2, 7, False), (9, 2, 7, False), (3, 1, 3, True), (7, 0, 7, True)])


def test_int8_bounds_hold():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 8)) * 10.0 ** r.integers(-3, 3, (300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, scale, n, e = neardup.quantise(x)
    near = neardup.int8_products(q, q) * scale[:, None] * scale[None, :]
    assert (np.abs(near - x @ x.T) <= n[:, None] * e[None, :] + e[:, None] * n[None, :] + e[:, None] * e[None, :] + 1e-12).all()


@pytest.mark.parametrize("options", [{}, {"block_rows": 20, "query_rows": 3, "bits": 4}])
def test_top_k_equals_sql(spark, options):
    rows = [(i * 10, *r[1:]) for i, r in enumerate(vectors()) if not r[1] or max(abs(v or 0) for v in r[1]) < 100]
    rows = [(i, [None if v is None else float(np.clip(v, -3, 3)) for v in e] if e is not None else None, *r) for i, e, *r in rows if e != []]
    df = spark.createDataFrame(rows, VECTORS)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), **options).toPandas().astype("int64")
    c = duckdb.connect()
    c.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    c.executemany("insert into embeddings values (?, ?, ?)", [(i, e, k) for i, e, k, *_ in rows])
    want = c.sql(catalog.OP6_SQL).df().astype("int64")
    by = ["query_id", "rank"]
    pd.testing.assert_frame_equal(got[want.columns].sort_values(by, ignore_index=True), want.sort_values(by, ignore_index=True))


def test_top_k_small_tables(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, 0, 0.0), (50, [1.0, 2.0], 1, 0, 0.0), (50, [1.0, 2.0], 1, 0, 0.0)], VECTORS)
    got = sorted(map(tuple, topk.top_k(one, one.where("vec_id % 50 = 0")).collect()))
    assert got == [(0, 1, 50, 327680), (0, 2, 50, 327680), (50, 1, 0, 327680)]
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none, none).collect() == []
