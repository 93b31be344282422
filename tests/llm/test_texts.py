"""Text operators against brute force, exact sums or held-out accuracy."""

import hashlib
import itertools
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from stridewell.llm import catalog, htmltext, licenses, lm, mixing, packing, repeats, toxicity

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, bytes int, kind string, size int, key string"
EXTRA = (1, "x", 2, "y")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, *EXTRA) for i, t, s in rows], DOCS)


def odd_rows():
    return [(1, None, None), (2, "", "a"), (None, "words without an id here", "a"), (3, "twice twice", "b"), (3, "twice twice", "b"),
            (4, "Ünï 中文 😀 \x00 �", None), (5, "long " * 60_000, "a"), (6, " \t\n ", "")]


PAGE = ("<html><head><title>t{i}</title><style>p{{}}</style></head><body><div class='top'><div>My site</div><ul><li>Home<li>News</ul></div>"
        "<div class='x'><h2>Title {i}</h2><p>Body &amp; soul {i}<br>next&nbsp;line <b>bo</b>ld <script>var a='<p>';</script>"
        "<p>Unclosed {i} &lt;tag&gt; &#x41;<ul><li>item {i}</ul></div><div class='low'>All rights reserved</div>"
        "<div class='comments'><p>Reader says {i}</p></div><form><input value=a>Search</form></body></html>")


def test_html_removes_what_pages_share(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(i=i), "text", 1) for i in range(8)]
    rows += [(100, None, None, "", 0), (101, "no host", "", "", 0), (102, "http://o.example/", "plain text &copy;", "", 0),
             (103, "http://o.example/", "<p>a" * 50_000, "", 0), (104, "http://o.example/", "<div <p>broken</", "", 0), (0, "https://h.example/0", PAGE.format(i=0), "", 1)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, low string, host int")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(8):
        assert by[i].text == f"Title {i} Body & soul {i} next line bold Unclosed {i} <tag> A item {i}"
    assert by[100].text == by[101].text == "" and by[102].text == "plain text ©" and by[103].text.count("a") == 50_000
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_copies_are_no_evidence_of_boilerplate(spark):
    page = "<html><body><div class='content'><h1>{0}</h1><p>Story {0}</p></div><div class='low'>All rights reserved</div></body></html>"
    rows = [(i, f"https://copies.example/{i}", page.format(0)) for i in range(9)]
    rows += [(20 + i, f"https://mixed.example/{i}", page.format(max(0, i - 30))) for i in range(37)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(9)} == {"0 Story 0 All rights reserved"}  # one text says nothing of what is shared
    assert all(got[20 + i] == f"{max(0, i - 30)} Story {max(0, i - 30)}" for i in range(37))


SITE = ("<html><body><div class='a1'><div class='a2'><a href='/'>Start</a> <a href='/x'>Contact us</a></div></div><div class='b1'><h2>{title}</h2>{story}</div>"
        "<div class='c1'><ul><li>Imprint of the house</li><li>Page seen {i} times</li></ul></div></body></html>")


def site(n, host, seed):
    """Pages whose classes tell nothing; what stands in their b1 is the article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    out = []
    for i in range(n):
        title, parts = f"{word()} {word()}", [" ".join(word() for _ in range(r.randrange(5, 30))) + "." for _ in range(r.randrange(1, 6))]
        out.append((i, f"https://{host}/{i}", SITE.format(i=r.randrange(3), title=title, story="".join(f"<p>{x}</p>" for x in parts)), " ".join([title, *parts])))
    return out


def test_html_style_tree_decides_without_telling_names(spark):
    rows = site(60, "telling.example", 1) + [(1000 + i, u, h, t) for i, u, h, t in site(7, "small.example", 2)] + [(2000 + i, u, h, t) for i, u, h, t in site(3, "tiny.example", 3)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[i] == t for i, _, _, t in rows if i < 2000)
    assert all(t in got[i] and "Imprint" in got[i] for i, _, _, t in rows if i >= 2000)  # too few pages to tell


def test_html_importance_equals_brute_force(spark):
    pages = site(12, "one.example", 5)
    pages += [(50 + k, u, h.replace("<p>", "<div>", 1), t) for k, (_, u, h, t) in enumerate(pages[:3])] + pages[:4]
    got = {r.path: (r.n, r.importance) for r in htmltext.style_tree(spark.createDataFrame([r[:3] for r in pages], "page_id long, url string, html string")).collect()}
    by_text = {}
    for _, _, h, _ in pages:
        by_text.setdefault(htmltext.main_text(h), h)
    look, content, n = {}, {}, Counter()
    for h in by_text.values():
        boxes = []
        htmltext.walk(h, watch=boxes)
        for path in {b.path for b in boxes}:
            n[path] += 1
            look.setdefault(path, Counter())["|".join(",".join(b.kids) for b in boxes if b.path == path)] += 1
            inner = [b for b in boxes if any(x is not None and x.path == path for x in (b, b.up, b.up and b.up.up))]
            content.setdefault(path, Counter()).update({w for b in inner for w in b.content})
    want = {}
    for path, m in n.items():
        h = -sum(c / m * math.log(c / m, m) for c in look[path].values()) if m > 1 else 1
        rest = 1 - sum(math.log(c, m) for c in content[path].values()) / len(content[path]) if m > 1 and content[path] else 0
        g = htmltext.GAMMA ** len(look[path])
        want[path] = (m, (1 - g) * h + g * rest if m > 1 else 1.0)
    assert got.keys() == want.keys() and len(want) >= 5
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-9 for p in want)


def test_html_features_reach_boxes_of_any_depth(spark, monkeypatch):
    """An article in many boxes is content of the outermost one too."""
    texts = [f"story{i} of page{i} told{i}" for i in range(8)]
    page = lambda i: "<html><body>" + "".join(f"<div class='k{d}'>" for d in range(12)) + f"<p>{texts[i]}</p>" + "</div>" * 12 + "</body></html>"
    pages = spark.createDataFrame([(i, f"https://deep.example/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltext.extract(pages).collect()} == dict(enumerate(texts))
    html = page(0).replace("<p>", "<div class='twin'>one two</div><div class='twin'>two three</div><p>", 1)
    rows = lambda parts: sorted(zip(*map(list, parts[1:])))
    whole = rows(htmltext.counted(html))
    assert len(set(whole)) == len(whole)
    monkeypatch.setattr(htmltext, "MOST_ROWS", 5)
    assert len(list(htmltext.tallied(html))) > 3 and rows(htmltext.counted(html)) == whole
    got = htmltext.style_tree(pages).collect()
    assert len(got) == 12 and all(r.importance > 0.8 and r.n == 8 for r in got)


@pytest.mark.parametrize("unit, close", [("<div>", "x"), ("<div>a", ""), ("<a ", ""), ('<a "', ""), ("<b>", "<p>" * 20_000), ("<form><p>", ""), ("<svg><path>", ""), ("<!--", ""), ("<div>", "</ul>" * 50_000)])
def test_html_takes_linear_time(unit, close):
    def seconds(n):
        began = time.process_time()
        htmltext.counted(unit * n + close)
        return time.process_time() - began
    assert seconds(40_000) < 8 * max(0.05, seconds(10_000))


@pytest.mark.parametrize("page, text", [
    ("<form action=/x><article><p>one</p></article><input></form>", "one"), ("<form><p>a</p><p>b</p></form><p>c</p>", "a b c"), ("<p>a</p><p>b</p><form>Search<p>c</p></form>", "a b"),
    ('<article><h2 id="related-work">Related work</h2><p class="search">kept</p><span class="menu">too</span><div class="share">no</div></article>', "Related work kept too"),
    ("<article>teaser</article><div><p>" + "the long text of the page " * 9 + "</p></div>", "teaser " + ("the long text of the page " * 9).strip()),
    ("<article><p>one</p><svg class=i /><p>two</p><math><mi>x</mi></math></article>", "one two"),
    ('<p>before</p><svg class="i"/><p>after one</p><p>after two</p>', "before after one after two"),
    ("<button-group>in</button-group><p>rest</p>", "in rest"),
    ("<html><head><title>t</title><body><article>all of it</article>", "all of it"),
    ("<html><head><meta charset=utf-8><title>t</title><p>first</p><p>second", "first second"),
    ("<head>no tags", "no tags"),
    ('<p>a<svg><title/><path d="x"/><style/></svg>b</p><p>c', "ab c"),
    ("<p>a</p><svg><path><p>b</p><svg></svg>c", "a b c"),
    ("<p>a</p><iframe src=x/><p>b</p><button>no<div>no</div></button>c<select><option>1</select>d", "a b cd"),
    ("<p>a<button>b<object>c<template>d", "abcd"),
    ("<p>a<!-->b<script>no</scripts>no</script>c<textarea>no", "abc"),
])
def test_html_loses_nothing_after_odd_markup(page, text):
    assert htmltext.main_text(page) == text


def test_lm_counts_and_base_score(spark):
    rows = [(r.doc_id, r.text, None) for r in pd.read_parquet(f"{DIR}/documents.parquet").itertuples()] + odd_rows()
    got = lm.score(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), "\n"]
    other = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    counts = Counter(w for i, t, _ in rows if other(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), not other(i), len(w), sum(x in counts for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
                  for i, t, _ in rows for w in [tokens(t)])
    for a, b in zip(sorted((str(r.doc_id), *r[1:6]) for r in got), want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) <= 1e-9 * max(1, abs(b[5]))
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(frame(spark, [])).collect() == []


def plain_log10(m, ids):
    """The model's log10 probabilities, position by position, without batches."""
    p, n, w, lead = m.p, len(ids), lm.WINDOW, lm.WINDOW - lm.STRIDE
    before = [m.n + 1] + [int(m.place[i]) for i in ids[:-1]]
    out = []
    for t in range(n):
        begin = 0 if t < w else (t - lead) // lm.STRIDE * lm.STRIDE
        x = p["emb"][before[begin:t + 1]].astype(float)
        q, k, v = x[-1] @ p["q"] * lm.DIM ** -0.5, x @ p["k"], x @ p["v"]
        e = np.exp(k @ q + p["far"][np.arange(len(x))[::-1]])
        h = np.maximum(np.concatenate([x[-1], e @ v / e.sum()]) @ p["w1"] + p["b1"], 0)
        target = int(m.place[ids[t]])
        c = int(m.cls[target])
        z = h @ p["wc"] + p["bc"]
        score = z[c] - np.log(np.exp(z).sum())
        if target == m.n:
            score += m.rare[ids[t]]
        else:
            lo, hi = m.bounds[c], m.bounds[c + 1]
            z = p["wd"][lo:hi] @ h + p["bd"][lo:hi]
            score += z[target - lo] - np.log(np.exp(z).sum())
        out.append(score / math.log(10))
    return out


def test_lm_score_equals_a_plain_forward_pass(spark, monkeypatch):
    rows = [(r.doc_id, r.text[:1_500], None) for r in pd.read_parquet(f"{DIR}/documents.parquet").itertuples()][:60]
    rows += [(9_000 + i, t, None) for i, t in enumerate(["", None, "one", "zebra xylophone quux 中文 flügel", "end " * 40])]
    monkeypatch.setattr(lm, "COMMON", 50)  # so that most words meet their counts in the join
    fitted = lm.fit(frame(spark, rows), share=2)
    got = {r.doc_id: r.score for r in lm.score_with(fitted, frame(spark, rows)).collect()}
    count = {r["hash"]: r.n for r in fitted.words.collect()}
    v = lm.Vocabulary(fitted.ranks.value)
    for i, text, _ in rows[-20:]:
        words = lm.tokens_of(text)
        parts = [v.subwords(w) for w in words]
        each, at, want = plain_log10(fitted.model, [s for p in parts for s in p]), 0, 0.0
        for w, p in zip(words, parts):
            share = (count.get(lm.word_hash(w), 0) + 1) / (fitted.total + fitted.distinct + 1)
            want += math.log10(lm.MIX * share + (1 - lm.MIX) * 10 ** sum(each[at:at + len(p)]))
            at += len(p)
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want)), text


def test_lm_average_of_tasks(spark):
    r = np.random.default_rng(8)
    data, steps = r.normal(size=(700, 3)).astype(np.float32), r.integers(1, 9, 700)
    rows = [(0, i, int(steps[i]), bytearray(data[i].tobytes())) for i in range(700)]
    got = lm.averaged(spark.createDataFrame(rows, "piece int, task long, windows long, data binary")).collect()
    assert len(got) == 1 and got[0].windows == steps.sum()
    assert np.allclose(np.frombuffer(got[0].data, np.float32), (data * steps[:, None]).sum(axis=0) / steps.sum(), atol=1e-5)


def test_lm_training_in_tasks_helps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with_, without = (lm.score_with(lm.fit(docs, sample_docs=60, share=share), docs).where("held_out").agg({"score": "sum"}).first()[0] for share in (2, 10 ** 9))
    assert with_ > without


def test_lm_trains_on_every_text_whole(spark):
    texts = [None, "", "one", "two words", *("w" * n for n in (599, 600, 601, 70_000)), *(f"text {i} " * i for i in range(300))]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = [r.text for k in range(lm.ROUNDS) for r in lm.slices(lm.round_of(docs, k), lm.SHARE, k).collect()]
    assert sorted(got) == sorted(t for t in texts if t)


def test_lm_every_task_trains_whatever_its_share(spark):
    """In one task or many, with less than a batch of windows each, the round moves the
    model, and held-out scores agree."""
    docs, scores = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    first = lm.fit(docs, sample_docs=60, share=10 ** 9).model
    for parts in (1, 211):
        fitted = lm.fit(docs.repartition(parts), sample_docs=60, share=2)
        assert any((fitted.model.p[k] != first.p[k]).any() for k in first.p)
        scores.append(lm.score_with(fitted, docs).where("held_out").agg({"score": "sum"}).first()[0])
    assert max(scores) - min(scores) <= 0.02 * abs(max(scores))


def test_lm_windows_score_each_token_once():
    m = lm.Model(np.arange(lm.IDS) % 7 + 0.0)
    ends = np.cumsum([1, 2, 15, 16, 17, 31, 32, 33, 56, 57, 200])
    at, scored = m.windows(np.zeros(ends[-1], int), ends)
    assert sorted(at[scored]) == list(range(ends[-1]))


def test_lm_probabilities_sum_to_one_and_look_at_the_past_only():
    counts = np.zeros(lm.IDS)
    counts[:40] = np.arange(40, 0, -1)
    lm_own, lm.OWN = lm.OWN, 30
    try:
        m = lm.Model(counts)
    finally:
        lm.OWN = lm_own
    before = np.array([3, 1, 4])
    total = sum(10 ** m.log10(np.array([*before, i]), np.array([4]))[-1] for i in range(2_000))
    rest = sum(math.exp(x) for x in m.rare[2_000:])
    some = 10 ** m.log10(np.array([*before, 2_000]), np.array([4]))[-1] / math.exp(m.rare[2_000])
    assert abs(total + rest * some - 1) < 1e-4
    a, b = (m.log10(np.array([3, 1, 4, x, 5]), np.array([5])) for x in (7, 8))
    assert np.allclose(a[:3], b[:3]) and a[3] != b[3]


def test_lm_classes_cost_least():
    """Predictions compute as few numbers as any slices allow: on skewed shares fewer
    than with classes of equal shares."""
    def cost(share, starts, each):
        ends = [*starts[1:], len(share)]
        return sum(each + (b - a) * sum(share[a:b]) * (b - a > 1) for a, b in zip(starts, ends))

    r = random.Random(4)
    for _ in range(20):
        share = sorted((r.random() ** 6 for _ in range(r.randrange(1, 9))), reverse=True)
        n, each = len(share), r.choice([0.01, 0.1, 1.0])
        every = ([0, *(i for i in range(1, n) if bits >> i & 1)] for bits in range(0, 1 << n, 2))
        assert cost(share, list(lm.classes(np.array(share), each)), each) <= min(cost(share, x, each) for x in every) + 1e-9
    share = 1 / np.arange(1, 4097) ** 1.5
    share /= share.sum()
    equal = np.flatnonzero(np.diff(np.minimum(np.cumsum(share) * 48 // 1.0000001, 47), prepend=-1) > 0)
    assert cost(share, list(lm.classes(share)), 1) < 0.7 * cost(share, list(equal), 1)


def test_lm_powers_do_not_overflow():
    z = np.array([[0.0, 500.0], [1.0, 2.0]], np.float32)
    e, total = lm.powers(z.copy())
    assert np.allclose(e, np.exp(np.minimum(z, 60))) and np.allclose(total[:, 0], e.sum(axis=1))


def test_lm_gradients():
    r, counts = np.random.default_rng(0), np.zeros(lm.IDS)
    counts[:60] = 5
    m = lm.Model(counts)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids = r.integers(0, 60, 40)
    before, target = m.inputs(ids, np.array([40]))
    at, mask = m.windows(ids, np.array([40]))
    at = np.minimum(at, 39)
    own = at[mask]
    loss, g = m.step(before[at], mask, target[own], ids[own])
    for name, slope in g.items():
        k = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        m.p[name][k] += 1e-4
        up = m.step(before[at], mask, target[own], ids[own])[0]
        m.p[name][k] -= 1e-4
        assert abs((up - loss) / 1e-4 - slope[k]) < 0.02 * abs(slope[k]) + 1e-5, name


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_bucket_bounds_are_optimal():
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.randrange(30) for _ in range(r.randrange(1, 40))]
        cells = sorted(set(lengths))
        count = np.array([lengths.count(c) for c in cells])
        for k in (1, 2, 3):
            bounds = packing.optimal_bounds(np.array(cells), count, count * cells, k)
            best = min(padding(lengths, (*some, cells[-1])) for n in range(k) for some in itertools.combinations(cells[:-1], min(n, len(cells) - 1)))
            assert len(bounds) <= k and padding(lengths, bounds) == best


def test_pack_places_each_row_once(spark):
    rows = [(i, "w " * (i * i % 97), None) for i in range(400)] + odd_rows()
    got = packing.pack(frame(spark, rows), buckets=5, budget=300, rows_per_cell=10).toPandas()
    assert sorted(map(str, got.doc_id)) == sorted(str(float(i)) if i is not None else "nan" for i, *_ in rows)
    assert (got.padding == got.bucket_len - got.n_tokens).all() and (got.padding >= 0).all()
    assert not got.duplicated(["bucket", "batch", "slot"]).any()
    for (_, size), b in got.groupby(["bucket", "bucket_len"]):
        room = max(1, 300 // max(size, 1))
        assert sorted(b.batch * room + b.slot) == list(range(len(b)))
    again = packing.pack(frame(spark, rows).repartition(3), buckets=5, budget=300, rows_per_cell=7).toPandas()
    by = ["bucket", "batch", "slot"]
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True), again.sort_values(by, ignore_index=True))
    assert packing.pack(frame(spark, [])).collect() == []


def sql(text, rows):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", rows)
    return c.sql(text).df()


def test_mix_equals_sql(spark):
    r = random.Random(7)
    rows = [(i, "w " * r.randrange(60), r.choice(["a", "a", "a", "b", "É", "Z", "", None])) for i in range(600)]
    rows += [(1_000, None, "only null"), (1_001, "\x0bx\x0cy\x00z q", "zz")]
    got = mixing.mix(frame(spark, rows), rows_per_cell=20).toPandas()
    want = sql(catalog.OP5_SQL, rows)
    got, want = (x.sort_values("doc_id", ignore_index=True)[["doc_id", "size", "source_size", "target", "taken"]] for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12)
    assert (got.taken <= 2 * got["size"]).all()
    sums = got.assign(source=[s for _, _, s in sorted(rows, key=lambda x: x[0])]).groupby("source", dropna=False).agg({"taken": "sum", "target": "first"})
    assert (sums.taken - np.floor(sums.target)).abs().max() == 0


def test_mixed_documents_hold_what_was_taken(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 13)), "ab"[i % 5 == 0]) for i in range(100)]
    plan = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows)).collect()}
    out = mixing.mixed_documents(frame(spark, rows)).collect()
    have = Counter()
    for r in out:
        have[r.doc_id] += len(r.text.split())
    assert have == Counter({i: n for i, n in plan.items() if n})
    odd = mixing.mixed_documents(frame(spark, odd_rows()))
    assert odd.columns == [f.split()[0] for f in DOCS.split(", ")] and odd.where("doc_id is null or doc_id = 3").count() >= 2
    assert mixing.mixed_documents(frame(spark, [])).collect() == [] == mixing.mix(frame(spark, [])).collect()


def test_licenses(spark):
    rows = [(1, "Some prose.\nReleased under the MIT License.\nMore.", None), (2, "He lost his driving license in the spring.", None),
            (3, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", None),
            (4, "SPDX-License-Identifier: GPL-3.0-or-later", None), (5, "A permission slip was signed by both of them.", None),
            (6, "Released under the\nMIT License.\n\nLicensed under the GNU General\nPublic License, version 3.", None),
            (7, "word " * 90 + "Distributed under the\nMozilla Public License 2.0. " + "word " * 90, None)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert {i: (r.licenses, r.n_notices) for i, r in got.items()} == {
        1: ("mit", 1), 2: ("", 0), 3: ("apache,cc-by-nc", 2), 4: ("gpl", 1), 5: ("", 0), 6: ("gpl,mit", 2), 7: ("mpl", 1)}
    assert got[2].best == 0.0
    odd = licenses.scan(frame(spark, odd_rows())).collect()
    assert len(odd) == len(odd_rows()) and {r.licenses for r in odd} == {""}
    assert licenses.scan(frame(spark, [])).collect() == []


#: Written apart from the training lists: openings, wraps and spellings that they lack.
NOTICES = [
    ("mit", "Everything in this folder is under the MIT License."), ("mit", "Code: MIT License, see the file COPYING"), ("mit", "You get this program under an MIT license, have fun."),
    ("apache", "The server is open source, under the Apache License 2.0, like the client."), ("apache", "Our plug-ins come under the Apache License,\nVersion 2.0 (the terms)."),
    ("gpl", "The kernel module falls under the GNU General\nPublic License, version 2, as does the loader."), ("gpl", "Copying is governed by the GNU GPL v3 and nothing else."),
    ("gpl", "GNU GPL v3 or newer."), ("lgpl", "Linking is fine, as the GNU Lesser General Public License, version 3 says."), ("lgpl", "The wrapper is under the GNU LGPL v3."),
    ("bsd", "Our parser may be had under the BSD 3-Clause License at no cost."), ("bsd", "The tools are under the BSD license."),
    ("mpl", "The add-on falls under the Mozilla Public License 2.0."), ("mpl", "Covered by the Mozilla Public\nLicense, v. 2.0."),
    ("cc-by", "Photographs: CC BY 4.0."), ("cc-by", "All pictures may be reused under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Music by the band, CC BY-NC 4.0."), ("cc-by-nc", "Maps come under a Creative Commons Attribution-NonCommercial 4.0 International\nLicense."),
    ("public-domain", "We hereby say: this is free and unencumbered software released into the public domain, all of it."), ("public-domain", "This recording has been released into the public domain."),
]
NOT_NOTICES = ["The minister said that a license is needed for each version of the device.", "A general of the public guard asked for a permit.",
               "MIT and the foundation published the results together.", "Creative work is common in this domain.", "The lease was granted free of charge to the school.",
               "She signed under the terms of the lease.", "Mozilla and Apache are names of projects.", "Public licenses were debated for hours.",
               "The source of the rumour has been released from prison.", "This work is the property of the museum.", "BSD was short for a name in that town.", "The attribution of the 4 paintings is unclear."]


def test_licenses_recall_and_precision(spark):
    cases = [*NOTICES, *(("", x) for x in NOT_NOTICES)]
    got = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, [(i, "Some prose stands here.\n" + line + "\nAnd more of it.", None) for i, (_, line) in enumerate(cases)])).collect()}
    for family in licenses.FAMILIES[1:]:
        want, found = {i for i, (f, _) in enumerate(cases) if f == family}, {i for i, f in got.items() if family in f.split(",")}
        assert len(want & found) >= 0.9 * len(want) and len(want & found) >= 0.9 * len(found), (family, [cases[i] for i in want ^ found])
    assert not any(got[i] for i, (f, _) in enumerate(cases) if not f)


def test_licenses_finds_every_template_line(spark):
    lines = [(f, line) for f, lines in licenses.TEMPLATES.items() for line in lines] + [("gpl", "Released under the GPL, version 3 or any later version.")]
    got = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, [(i, "Some prose.\n" + line, None) for i, (_, line) in enumerate(lines)])).collect()}
    wrong = {line: got[i] for i, (f, line) in enumerate(lines) if got[i] != f}
    assert not wrong, wrong


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: x[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            s = data[k:k + length]
            if s in seen:
                gone[k:k + length] = True
            seen.add(s)
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def repeat_rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(n) for n in (12, 20, 21, 22, 40, 200)]
    rows = []
    for i in range(120):
        parts = [fresh(r.randrange(0, 40)) for _ in range(3)]
        for _ in range(r.choice([0, 1, 2])):
            p = r.choice(passages)
            lo = r.randrange(len(p) // 2)
            parts.insert(r.randrange(4), r.choice([p, p[lo:], p[:-lo or None], p[:40] + "#" + p[41:]]))
        rows.append((i, " ".join(parts)))
    rows += [(200, "a" * 5_000), (201, "a" * 99), (202, "a" * 100), (203, "ab" * 3_000), (204, None), (205, ""), (206, "x" * 99 + "y" + "a" * 99)]
    return rows + [(300 + k, rows[k][1]) for k in range(0, 60, 7)]


@pytest.mark.parametrize("length", [100, 159])
def test_repeats_equal_brute_force(spark, length):
    rows = repeat_rows()
    shuffled = random.Random(1).sample(rows, len(rows))
    df = spark.createDataFrame([(i, t, "s", *EXTRA) for i, t in shuffled], DOCS).repartition(5)
    assert sorted(map(tuple, repeats.remove_repeats(df, length, remains=False).collect())) == brute_repeats(rows, length)


@pytest.mark.parametrize("length", [95, 100, 159])
def test_phrases_differ_wherever_a_byte_differs(length):
    r = np.random.default_rng(5)
    buf = r.integers(0, 256, 4_000).astype(np.uint8)
    text, _, ident, _, first, last = repeats.phrases(buf, np.array([len(buf)]), length)
    for a, b, own in zip(first, last, ident):
        for k in range(0, b + length - a, 7):
            other = buf[a:b + length].copy()
            other[k] ^= 1
            assert own not in repeats.phrases(other, np.array([len(other)]), length)[2]


def test_repeats_with_crowded_triggers_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LANE", 8)
    monkeypatch.setattr(repeats, "SLICE", 2_000)
    monkeypatch.setattr(repeats, "HELD", 500)
    r, core = random.Random(9), "the same core of a trigger that stands in many different surroundings, again and again "
    rows = [(i, "".join(r.choice("xyz") for _ in range(70)) + core + "".join(r.choice("xyz") for _ in range(70))) for i in range(60)]
    rows += [(100, "".join(r.choice("abcdefgh") for _ in range(9_000)))]
    rows += [(101, rows[-1][1][3_000:8_000]), (102, rows[5][1][20:190])]
    df = spark.createDataFrame([(i, t, "s", *EXTRA) for i, t in rows], DOCS).repartition(2)
    assert sorted(map(tuple, repeats.remove_repeats(df, remains=False).collect())) == brute_repeats(rows)


def test_repeats_put_no_crowded_trigger_into_one_group(spark, monkeypatch):
    real = repeats.sort_suffixes

    def watched(length):
        run = real(length)

        def small(group):
            assert group.num_rows < 150
            return run(group)
        return small

    monkeypatch.setattr(repeats, "sort_suffixes", watched)
    monkeypatch.setattr(repeats, "LANE", 50)
    r, core = random.Random(4), "one passage that many of the texts hold, each of them elsewhere and between other words: "
    rows = [(i, "".join(r.choice("xyz") for _ in range(90)) + r.choice(["#", "a1b2c3d4e5f6g7h8"]) + core + "".join(r.choice("xyz") for _ in range(90))) for i in range(300)]
    df = spark.createDataFrame([(i, t, "s", *EXTRA) for i, t in rows], DOCS).repartition(3)
    got = sorted(map(tuple, repeats.remove_repeats(df, remains=False).collect()))
    assert got == brute_repeats(rows) and sum(r[2] for r in got) > 10_000


def test_suffixes_of_a_group_are_sorted_in_bounded_memory():
    r, length, n = np.random.default_rng(8), 100, 6_000
    pieces = [r.bytes(168) for _ in range(n // 2)] * 2  # each twice, two to a trigger
    group = pa.table({"trigger": np.arange(n) % (n // 2), "doc": np.arange(n), "sub": np.zeros(n, np.int32), "at": np.full(n, 68, np.int32),
                      "back": np.full(n, 68, np.int32), "fore": np.zeros(n, np.int32), "piece": pa.array(pieces, pa.binary())})
    tracemalloc.start()
    try:
        found = repeats.sort_suffixes(length)(group)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.to_pydict() == {"doc": list(range(n // 2, n)), "sub": [0] * (n // 2), "first": [0] * (n // 2), "last": [68] * (n // 2)}
    assert peak < 60 << 20  # beside the group's bytes; its strings and an index of all their bytes would be 370 MB


def test_cuts_leave_whole_characters():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice("aé中😀\uFFFD") for _ in range(60))
        data = text.encode()
        runs = [(k, k + r.randrange(9)) for k in (r.randrange(len(data) - 12) for _ in range(3))]
        gone = {i for a, b in runs for i in range(a, b + 4)}
        at, want = 0, ""
        for c in text:
            size = len(c.encode())
            want += c * (not gone.issuperset(range(at, at + size)))
            at += size
        left, n, spans = repeats.kept(data, runs, 4, True)
        assert left.decode() == want and n == len(data) - len(left)
        plain = repeats.kept(data, runs, 4)
        assert plain[0] == bytes(x for i, x in enumerate(data) if i not in gone) and plain[1] == len([i for i in gone if i < len(data)]) and spans <= plain[2]


def test_repeats_with_null_and_repeated_ids(spark):
    t = "".join(chr(97 + k * k % 26) + str(k) for k in range(80))
    got = repeats.remove_repeats(frame(spark, [(None, t, "a"), (1, t, "a"), (1, t, "b"), (1, t + "!", "b"), (2, None, "c")]), carry=("source",)).collect()
    n = len(t)
    # the null id stands first; equal rows of an id are one document
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == [("1", n, n), ("1", n, n), ("1", n + 1, n), ("2", 0, 0), ("None", n, 0)]
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 500 and (held.predicted == held.toxic).mean() > 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(frame(spark, odd_rows()), labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(frame(spark, []), labels.limit(0)).collect() == []
    train = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, toxic int, quality int")
    docs = frame(spark, [(i, "you foul idiot rotten" if i % 2 else "the tea was good today", None) for i in range(400)])
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.toxicity(docs, train).collect())


def test_toxicity_learns_from_rows_beyond_the_sample(spark):
    """The words that tell are many, and the first sample has few of them."""
    r = random.Random(4)
    name = lambda k, head: head + "".join(chr(97 + k // 5 ** j % 5) for j in range(3))
    rows = [(i, f"the tea was {name(r.randrange(60), 'zuv' if i % 2 else 'wok')[::-1]} today and good", None) for i in range(4_000)]
    train = spark.createDataFrame([(i, i % 2, 0) for i in range(4_000)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(frame(spark, rows), train, most=8).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 4_000 and sum(r.predicted == r.doc_id % 2 for r in held) > 0.9 * len(held)


def test_toxicity_places_by_pieces(monkeypatch):
    m, r = toxicity.Model(), np.random.default_rng(3)
    sizes = [0, 1, 4, 70, 31]
    starts = np.concatenate([[0], np.cumsum([n + 3 for n in sizes])])
    rows = r.integers(0, 9_000, (starts[-1], 6)).astype(np.uint16)
    for s, n in zip(starts, sizes):
        rows[s + n:s + n + 3] = 0
    values = m.convolve(m.responses(m.vectors(rows)))
    want = [values[s:s + n + 1].max(axis=0) for s, n in zip(starts, sizes)]
    for piece in (7, 50, 1_000):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        where, pooled = toxicity.pooled_at(m, rows, starts, 3)
        assert np.allclose(pooled, want, atol=1e-5) and np.allclose(values[where, np.arange(toxicity.CHANNELS)], want, atol=1e-5)


def test_thresholds_keep_equal_logits_together():
    z, y, n = np.array([0.0, 1.0, 1.0, 2.0]), np.array([0, 0, 1, 1]), np.array([50, 40, 30, 50])
    assert (toxicity.calibrate(z, y, n, np.zeros(4, int)) == 1.5).all()


def test_network_equals_a_plain_convolution():
    m, r = toxicity.Model(), random.Random(6)
    m.bias = np.linspace(-0.2, 0.2, toxicity.CHANNELS).astype(np.float32)
    texts = ["", "one", *(" ".join(r.choice(["the", "und", "les", "idiot", "foul", "tea", "zzz"]) for _ in range(n)) for n in (2, 3, 17, 60))]
    for text, z in zip(texts, toxicity.Scorer(m).score(texts)[0]):
        words = toxicity.words_of(text)
        vec = [m.emb[toxicity.features(w)].sum(axis=0) for w in words] + [np.zeros(toxicity.DIM)] * 3
        want, c = float(m.base), 0
        for w, filters in zip(toxicity.WIDTHS, m.filters):
            for f in filters:
                best = max(sum(float(f[j] @ vec[k + j]) for j in range(w)) for k in range(len(words) + 1))
                want += max(0.0, best + float(m.bias[c])) * float(m.head[c])
                c += 1
        assert abs(want - z) < 1e-3


def test_sample_bounds_hold_and_long_texts_train(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, toxic int, quality int")
    docs = frame(spark, [(i, "word " * (10 if i % 4 else 8_000), None) for i in range(400)])
    texts, y, weight, fold = toxicity.labelled_sample(docs, labels, 1_000, 10 ** 9)
    train_rows = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert len(texts) == len(train_rows) and max(map(len, texts)) == 8_000
    assert abs(weight.sum() - len(y)) < 1e-2 * len(y)
    some = toxicity.labelled_sample(docs, labels, 60, 10 ** 9)[0]
    few = toxicity.labelled_sample(docs, labels, 1_000, 400_000)[0]
    assert len(some) < len(texts) / 2 and len(few) < len(texts)


def test_long_texts_are_scored_in_overlapping_pieces(monkeypatch):
    m = toxicity.Model()
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdef") for _ in range(3)) for _ in range(n)) for n in (0, 1, 2, 5, 90, 400)]
    whole = toxicity.Scorer(m).score(texts)[0]
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert np.allclose(whole, toxicity.Scorer(m).score(texts)[0], atol=1e-5)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), c.sql(catalog.ORACLES[name]).df()
    got, want = (x[sorted(x.columns)].sort_values(sorted(x.columns), ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
