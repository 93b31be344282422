"""Alignment of two tokenizers over the same texts.

Texts are tokenized by both, whole Arrow batches are laid end to end, and the
bytes at which tokens end are counted once per tokenizer over the whole batch
(``bincount``).  A byte where tokens of both end is a cut between groups; a byte
where any token ends closes one overlap of an A token with a B token.  Prefix
sums over those counts, read at the documents' ends, give each document's
numbers.  Corpus-wide counts of id pairs are summed by Spark from each batch's
distinct pairs and joined back to the batches.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Where the public vocabularies are; a parameter of ``align``.
FOLDER = "/opt/tokenizers"
#: Bytes of text that are laid end to end at once; a longer text stands alone.
BATCH = 2_500_000
#: Pieces of text whose tokens a task remembers; when there are more it starts again.
REMEMBERED = 200_000

#: Characters other than space and line feed that some regular expression engine
#: takes for white space.
OTHER_SPACES = "\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: A text is cut before spaces and line feeds that follow a character other than
#: white space: neither tokenizer joins anything across such a place.
PIECE = re.compile(rf"[ \n]*[^ \n]+(?:(?<=[{OTHER_SPACES}])[ \n]+[^ \n]*)*(?:[ \n]+\Z)?")
#: Pieces that every Unicode version splits alike: ASCII, Latin and Cyrillic letters.
PLAIN = re.compile("[\n\x20-\x7e\u00c0-\u024f\u0400-\u045f]*\\Z")
#: Fixed value: the public splitting pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, by the
    public rule: visible Latin-1 characters stand for themselves, the others for
    characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One vocabulary: the bytes of each id, and its decimal digits in a word of 8 bytes."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) > 9_999_999:
            raise ValueError("ids of more than 7 digits leave no byte for a separator")
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int32)
        digits = [str(i).encode() for i in range(len(tokens))]
        self.digits = np.frombuffer(b"".join(d.ljust(8, b"\0") for d in digits), dtype="<u8")
        self.n_digits = np.array([len(d) for d in digits], dtype=np.uint8)

    def words(self, ids: np.ndarray, ends: np.ndarray, inner: str, last: str) -> np.ndarray:
        """Each id's digits and its separator, ``last`` where a group ends."""
        mark = np.full(len(ids), ord(inner), dtype=np.uint64)
        mark[ends - 1] = ord(last)
        return self.digits[ids] | (mark << (self.n_digits[ids].astype(np.uint64) * np.uint64(8)))


class Tokenizers:
    """Both tokenizers, and the tokens of pieces met before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        level, names = byte_level(), [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.side_a = Side([bytes(level[c] for c in t) if all(c in level for c in t) else t.encode() for t in names])
        self.side_b = Side([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in pieces)
        self.quick = self.by_rank(path_a)
        self.forget()

    def by_rank(self, path_a: str):
        """A quicker encoder of the same vocabulary, where its merges stand in the order of their ids."""
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        ids, merges = file["model"]["vocab"], ["".join(m if isinstance(m, list) else m.split(" ")) for m in file["model"]["merges"]]
        at = [ids[m] for m in merges]
        if at != sorted(at) or len(ids) - len(at) not in (256, 257) or file.get("normalizer") or file["pre_tokenizer"] != {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return None
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {self.side_a.tokens[i]: i for t, i in ids.items() if t not in special}
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.counts = (array("i"), array("i")), (array("q"), array("q"))
        self.good = array("b")

    def pieces(self, text: str) -> list[str]:
        return (self.cuts and PIECE.findall(text)) or [text]

    def encode_a(self, pieces: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.a.encode_batch(pieces, add_special_tokens=False)]
        plain = [bool(PLAIN.match(p)) for p in pieces]
        others = iter(self.a.encode_batch([p for p, quick in zip(pieces, plain) if not quick], add_special_tokens=False))
        return [self.quick.encode_ordinary(p) if quick else next(others).ids for p, quick in zip(pieces, plain)]

    def encode_b(self, pieces: list[str]) -> list[list[int]]:
        """B puts a space before each text: a piece that starts with one leaves it out, of
        one that starts with a line feed the first token is left out."""
        found = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [own if p[0] == " " else own[1:] for p, own in zip(pieces, found)]

    def learn(self, pieces: list[str]) -> None:
        """Tokens of new pieces, and whether both spell them."""
        start, raw = len(self.known), [p.encode() for p in pieces]
        self.known.update(zip(pieces, range(start, start + len(pieces))))
        sizes, good = np.array(list(map(len, raw))), np.ones(len(pieces), dtype=bool)
        for found, side, ids, counts in zip((self.encode_a(pieces), self.encode_b(pieces)), (self.side_a, self.side_b), self.ids, self.counts):
            flat, lengths = list(itertools.chain.from_iterable(found)), list(map(len, found))
            ids.extend(flat)
            counts.extend(lengths)
            spelled = b"".join(map(side.tokens.__getitem__, flat))
            upto = np.concatenate([[0], np.cumsum(side.sizes[np.array(flat, dtype=np.int64)])])[np.cumsum(lengths)]
            if spelled != b"".join(raw) or (upto != np.cumsum(sizes)).any():
                good &= [b"".join(map(side.tokens.__getitem__, own)) == r for own, r in zip(found, raw)]
        self.good.extend(good.astype(np.int8).tolist())

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts without null: whether each has tokens; then the A ids of those that
        have, how many each has, and the same of B."""
        if not texts:
            return np.zeros(0, bool), *[np.zeros(0, np.int64)] * 4
        strings = [t.decode("utf-8", "replace") for t in texts]
        cut = [self.pieces(t) for t in strings]
        if len(self.known) > REMEMBERED or len(self.ids[0]) > 10 * REMEMBERED:
            self.forget()
        new = set().union(*cut) - self.known.keys()
        if new:
            self.learn(list(new))
        at = np.array(list(map(self.known.__getitem__, itertools.chain.from_iterable(cut))), dtype=np.int64)
        n = np.array(list(map(len, cut)), dtype=np.int64)
        good = np.logical_and.reduceat(np.array(self.good, dtype=bool)[at], np.cumsum(n) - n)
        # a text with bytes that are no UTF-8 was read with characters put in their place
        good &= [b"\xef\xbf\xbd" in t or "\ufffd" not in s for t, s in zip(texts, strings)]
        good &= [b"\xef\xbf\xbd" not in t or s.encode() == t for t, s in zip(texts, strings)]
        at, n = at[np.repeat(good, n)], n[good]
        out = [good]
        for ids, counts in zip(self.ids, self.counts):
            ids, sizes = np.array(ids, dtype=np.int32), np.array(counts, dtype=np.int32)
            first = (np.cumsum(sizes) - sizes)[at]
            sizes = sizes[at]
            ends = np.cumsum(sizes)
            out += [ids[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)],
                    np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])])]
        return tuple(out)


@functools.lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def written(a: np.ndarray, side_a: Side, b: np.ndarray, side_b: Side, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The text of all groups, A ids before B ids in each, every id followed by its
    separator; and where each id's text ends."""
    group = lambda cuts: np.repeat(np.arange(len(cuts)), np.diff(np.concatenate([[0], cuts])))
    words = np.zeros(len(a) + len(b), dtype="<u8")
    words[np.arange(len(a)) + np.concatenate([[0], cuts_b])[group(cuts_a)]] = side_a.words(a, cuts_a, ",", "|")
    words[np.arange(len(b)) + cuts_a[group(cuts_b)]] = side_b.words(b, cuts_b, ",", ";")
    sizes = np.count_nonzero(words.view(np.uint8).reshape(-1, 8), axis=1)
    return words.tobytes().translate(None, b"\0"), np.cumsum(sizes)


class Aligned:
    """Numbers of a batch of texts: per text ``n_a``, ``n_b``, ``n_groups``,
    ``n_links`` and ``groups_sha256``, zeros and '' for those without tokens; the
    distinct id pairs of the batch (``pairs``, A id times B's vocabulary plus B id)
    with the number of texts that hold each, and per text which it holds how often."""

    def __init__(self, texts: list[bytes | None], tok: Tokenizers):
        side_a, side_b = tok.side_a, tok.side_b
        there = np.array([bool(t) for t in texts], dtype=bool)
        good, a, n_a, b, n_b = tok.encode([b" " + t for t in texts if t])
        who = np.flatnonzero(there)[good]
        end_a, end_b = np.cumsum(side_a.sizes[a], dtype=np.int64), np.cumsum(side_b.sizes[b], dtype=np.int64)
        size = int(end_a[-1]) if len(end_a) else 0
        # bytes at which tokens end, counted once for the whole batch
        ends_a = np.bincount(end_a, minlength=size + 1).astype(np.int8)
        ends_b = np.bincount(end_b, minlength=size + 1).astype(np.int8)
        stops = np.flatnonzero(ends_a | ends_b)
        in_a, in_b = ends_a[stops].astype(np.int64), ends_b[stops].astype(np.int64)
        up_a, up_b = np.cumsum(in_a), np.cumsum(in_b)
        both = (in_a & in_b).astype(bool)
        links_a, links_b = up_a - in_a, up_b - in_b  # the overlap that ends at each stop
        cuts_a, cuts_b = up_a[both], up_b[both]
        # prefix sums, read at the texts' last bytes, less what came before each text
        last = end_a[np.cumsum(n_a) - 1] if len(n_a) else np.zeros(0, np.int64)
        upto = np.searchsorted(stops, last, side="right")
        each = lambda x: np.diff(np.concatenate([[0], x])).astype(np.int64)
        n_links, groups_upto = each(upto), np.cumsum(both)[upto - 1] if len(upto) else np.zeros(0, np.int64)
        self.numbers = {}
        for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", each(groups_upto)), ("n_links", n_links)):
            self.numbers[name] = np.zeros(len(texts), dtype=np.int64)
            self.numbers[name][who] = values
        text, ends = written(a, side_a, b, side_b, cuts_a, cuts_b)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)]).astype(np.int64)]
        self.sha = [""] * len(texts)
        view = memoryview(text)
        for k, i in enumerate(who):
            self.sha[i] = hashlib.sha256(view[bounds[k]:bounds[k + 1] - 1]).hexdigest()
        # distinct pairs per text, then per batch
        code = a[links_a].astype(np.int64) * len(side_b.tokens) + b[links_b]
        bits = np.int64(max(1, (len(side_a.tokens) * len(side_b.tokens)).bit_length()))
        keys = np.sort((np.repeat(np.arange(len(who)), n_links) << bits) | code)
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        times, keys = np.diff(np.concatenate([first, [len(keys)]])), keys[first]
        self.pairs, at, self.texts = np.unique(keys & ((np.int64(1) << bits) - 1), return_inverse=True, return_counts=True)
        n = np.bincount(keys >> bits, minlength=len(who))
        self.held = [(b"", b"")] * len(texts)
        to = np.cumsum(n)
        for k, i in enumerate(who):
            own, often = at[to[k] - n[k]:to[k]], times[to[k] - n[k]:to[k]]
            self.held[i] = (own.astype(np.uint32).tobytes(), often.astype(np.uint8 if often.max() < 256 else np.uint32).tobytes())


def slices(batches, most: int):
    """Rows of Arrow batches in lists of about ``most`` bytes of text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            raw = text.as_py()
            ids.append(i)
            texts.append(raw)
            size += len(raw or b"")
            if size >= most or len(ids) >= 50_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


OWN = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
PARTS = f"batch long, {OWN}, groups_sha256 string, held binary, times binary, pairs array<long>, texts array<long>"


def tokenize(path_a: str, path_b: str, most: int):
    """Rows of texts -> a row per text, and one per batch with its pairs."""
    def run(batches):
        tok, context = tokenizers(path_a, path_b), TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        kinds = dict(field.split(" ") for field in PARTS.split(", "))
        arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        for ids, texts in slices(batches, most):
            found, n = Aligned(texts, tok), len(ids)
            held, times = zip(*found.held)
            columns = {"batch": [number] * (n + 1), "doc_id": ids + [None], "groups_sha256": found.sha + [None],
                       "held": [*held, None], "times": [*times, None], "pairs": [None] * n + [found.pairs], "texts": [None] * n + [found.texts]}
            columns |= {k: [*v.tolist(), None] for k, v in found.numbers.items()}
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], arrow[kind]) for k, kind in kinds.items()], list(kinds))
            number += 1
    return run


def counted(group: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of a batch's texts, from its pairs' corpus-wide counts."""
    order = np.argsort(counts["pair"].to_numpy())
    count = counts["count"].to_numpy()[order]
    best = counts["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64) if len(order) else np.zeros(0, np.int64)
    n_best, total = [], []
    for held, times in zip(group["held"], group["times"]):
        at = np.frombuffer(held.as_py(), dtype=np.uint32)
        raw = times.as_py()
        often = np.frombuffer(raw, dtype=np.uint8 if len(raw) == len(at) else np.uint32).astype(np.int64)
        n_best.append(int((often * best[at]).sum()))
        total.append(int((often * count[at]).sum()))
    keep = group.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return keep.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column(
        "groups_sha256", group["groups_sha256"].cast(pa.string()))


def align(documents: DataFrame, path_a: str = f"{FOLDER}/byte_bpe_50k.json", path_b: str = f"{FOLDER}/piece_bpe_32k.model",
          batch_bytes: int = BATCH) -> DataFrame:
    """``documents(doc_id long, text)`` -> ``doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256``, a row per document.

    A space and the text is tokenized by A, a byte-level BPE file, and the text by
    B, a SentencePiece model that adds the space itself; strings of special tokens
    are plain text.  Bytes at which tokens of both end cut the text into groups;
    ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``.  A link is a pair of
    an A and a B token that share bytes; the count of an id pair is the number of
    rows that hold it linked.  ``n_best`` counts links whose count is the highest
    of their A id, ties included; ``count_sum`` adds up the counts of all links.

    Null and empty texts, and those whose tokens do not spell the text (bytes that
    are no UTF-8, U+2581) have zeros and ''.  Rows of repeated or null ids are
    documents of their own.  Extra columns are ignored; an empty table gives no
    rows.  A very long text is a batch of its own.

    Only distinct pairs of a batch are shuffled, summed before the shuffle; of A's
    ids there are no more than its vocabulary, which bounds the one broadcast.
    Texts are tokenized once: what the second step needs is written to the shared
    folder.
    """
    from sentencepiece import SentencePieceProcessor

    size_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    parts = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
                        .mapInArrow(tokenize(path_a, path_b, batch_bytes), PARTS))
    here = parts.where("pairs is not null").select("batch", F.explode(F.arrays_zip("pairs", "texts")).alias("p")).select(
        F.col("batch").alias("of"), F.col("p.pairs").alias("pair"), F.col("p.texts").alias("texts"))
    counts = here.groupBy("pair").agg(F.sum("texts").alias("count"))
    ids = counts.withColumn("a", F.floor(F.col("pair") / F.lit(size_b)).cast("int"))
    best = ids.groupBy("a").agg(F.max("count").alias("most"))  # no more rows than A has ids
    marked = ids.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    asked = here.select("of", "pair").join(marked, "pair").select("of", "pair", "count", "best")
    texts = parts.where("pairs is null").select("batch", *[f.split(" ")[0] for f in OWN.split(", ")], "groups_sha256", "held", "times")
    return texts.groupBy("batch").cogroup(asked.groupBy("of")).applyInArrow(
        counted, f"{OWN}, n_best long, count_sum long, groups_sha256 string")
