"""Cross-tokenizer alignment against a plain walk over whole texts."""

import collections
import hashlib
import random

import pytest

from stridewell.llm import alignment as A

PATHS = f"{A.FOLDER}/byte_bpe_50k.json", f"{A.FOLDER}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """Tokens of a whole text by both tokenizers, as (id, bytes)."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    level = A.byte_level()

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def run(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(level[c] for c in a.id_to_token(i))) for i in ids], [(i, bytes_b(i)) for i in b.encode(text)]
    return run


def walk(texts, plain):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest per text, one byte at a time."""
    found, holds = [], collections.Counter()
    for text in texts:
        a, b = plain(text) if text else ([], [])
        if not text or b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
            found.append(None)
            continue
        own_a = [k for k, (_, x) in enumerate(a) for _ in x]
        own_b = [k for k, (_, x) in enumerate(b) for _ in x]
        links = sorted(set(zip(own_a, own_b)))
        groups, ga, gb = [], [], []
        for at in range(len(own_a)):
            last_a, last_b = at + 1 == len(own_a) or own_a[at + 1] != own_a[at], at + 1 == len(own_b) or own_b[at + 1] != own_b[at]
            ga += [a[own_a[at]][0]] * last_a
            gb += [b[own_b[at]][0]] * last_b
            if last_a and last_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        holds.update(set(pairs))
        found.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.defaultdict(int)
    for (i, _), n in holds.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (*f[:3], len(f[3]), sum(holds[p] == best[p[0]] for p in f[3]), sum(holds[p] for p in f[3]), f[4]) for f in found]


ODD = ["", None, " ", "   ", "a", " a", "a ", "a  ", "\n", "\n\n", " \n ", "a\n\nb", "a\n b", "a\n  b", "a \n b  c\n\n\n d", "x\t y", "x  y  z", "x　 y　\n z",
       "it's   we'll  'S", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁a ▁", "a▁ b", "naïve Ærø Дом дом 东京 ﷽ 🙂🙂 é", "a\x00b \x1c c\x1f\n d", "\r\n x\r\n\r\n y",
       "12345 67 8\n9", "…  – —", "﻿start ​ mid", "a" * 3000, " " * 500, "ab " * 4000, "\n" * 300 + "x"]


def test_tokens_and_numbers_equal_the_plain_walk(spark, plain):
    r = random.Random(3)
    letters = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", " ", " ", "é", "ß", "Ж", "東", "🙂", "'s", "1", ".", "▁", "\x85", "\x1d", "́", "\r"]
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.choice([3, 10, 60]))) for _ in range(300)]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int").repartition(3)
    want = sorted((str(i), *w) for (i, _, _), w in zip(rows, walk(texts, plain)))
    for batch in (100, 4_000_000):  # in many batches as in few
        got = A.align(docs, *PATHS, batch_bytes=batch).collect()
        assert sorted((str(g.doc_id), g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.groups_sha256) for g in got) == want


def test_forgetting_changes_nothing(plain, monkeypatch):
    tok = A.Tokenizers(*PATHS)
    texts = [f"word{i} the\nnext  one é{i}" for i in range(50)]
    whole = A.Aligned([t.encode() for t in texts], tok)
    monkeypatch.setattr(A, "REMEMBERED", 3)
    for t, sha in zip(texts, whole.sha):
        assert A.Aligned([t.encode()], tok).sha == [sha]
    tok.cuts = False  # whole texts, no pieces
    tok.forget()
    assert A.Aligned([t.encode() for t in texts], tok).sha == whole.sha
    tok.quick = None
    tok.forget()
    assert A.Aligned([t.encode() for t in texts], tok).sha == whole.sha


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text union all select 2L, 'a�b' union all select 3L, null")
    got = {r.doc_id: (r.n_a > 0, r.groups_sha256 != "") for r in A.align(docs, *PATHS).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (False, False)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = A.align(docs, *PATHS)
    assert out.collect() == [] and out.columns[-3:] == ["n_best", "count_sum", "groups_sha256"]
