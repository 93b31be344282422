"""A convolutional text classifier for toxicity, trained in numpy.

A word is the sum of hashed embeddings of itself and its leading letters;
filters of widths 1, 2 and 3 run over the words, each is max-pooled over the
whole text, and a logistic layer reads the pooled values.  Thresholds are
calibrated by the language that the text's own function words show.

First passes over a bounded sample give a start; then all labelled training rows
train, each task's on their own, and the tasks' models are averaged.  Thresholds
come from counts over all rows that gave no weights.
"""

from __future__ import annotations

import copy
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, lean, materialize, mean_of_tasks, packed_parts, small_batches

TABLE, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
PREFIXES = (3, 4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+")
#: Common function words by language.
FUNCTION_WORDS = (
    ("the", "of", "and", "to", "is", "that", "it", "with"),
    ("der", "die", "und", "das", "den", "mit", "nicht", "von"),
    ("le", "les", "et", "une", "des", "du", "dans", "pour"),
    ("el", "los", "las", "por", "con", "una", "del", "se"),
)
LANGUAGES = len(FUNCTION_WORDS) + 1  # the last: none of them
LANGUAGE_OF = {w: k for k, words in enumerate(FUNCTION_WORDS) for w in words}
CHANNELS = len(WIDTHS) * FILTERS
ROUNDS, STEPS = 2, 256  # parts in which all rows train; steps of a logit that thresholds are told in
PIECE = 200_000  # tokens scored at once; longer texts go in overlapping pieces


def features(word: str) -> list[int]:
    """Rows of the embedding table, 0 for none: the word, its prefixes."""
    out = [1 + zlib.crc32(b"w" + word.encode("utf-8", "replace")) % (TABLE - 1)]
    for n in PREFIXES:
        out.append(1 + zlib.crc32(b"p" + word[:n].encode("utf-8", "replace")) % (TABLE - 1) if len(word) >= n else 0)
    return out


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


class Model:
    """emb [TABLE, DIM]; filters by width [FILTERS, width, DIM] and bias; head.
    shift: what is taken from the logit of each language."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.1, (TABLE, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.filters = [r.normal(0, 0.5, (FILTERS, w, DIM)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(CHANNELS, np.float32)
        self.head = r.normal(0, 0.3, CHANNELS).astype(np.float32)
        self.base = np.float32(-1.0)
        self.shift = np.zeros(LANGUAGES, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.emb, *self.filters, self.bias, self.head, np.atleast_1d(self.base)]

    def with_parameters(self, arrays: list[np.ndarray]) -> Model:
        out = copy.copy(self)
        out.emb, *out.filters, out.bias, out.head, base = arrays
        out.base = base[0]
        return out

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return self.emb[rows].sum(axis=1)

    def responses(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each offset: [n, sum(widths) * FILTERS]."""
        return np.concatenate([vectors @ f[:, j].T for f in self.filters for j in range(f.shape[1])], axis=1)

    def convolve(self, answers: np.ndarray) -> np.ndarray:
        """Filter values at every position; beyond the end stand zero vectors."""
        n, out, at = len(answers), [], 0
        for w in WIDTHS:
            total = answers[:, at:at + FILTERS].copy()
            for j in range(1, w):
                total[:max(0, n - j)] += answers[j:, at + j * FILTERS:at + (j + 1) * FILTERS]
            out.append(total)
            at += w * FILTERS
        return np.concatenate(out, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.head + self.base


def fresh_sums(m: Model) -> dict:
    """Adagrad's sums of squares before the first step."""
    return {"emb": np.full((TABLE, 1), 1e-3, np.float32), "bias": 1e-3, "head": 1e-3, "base": 1e-3,
            **{k: np.full_like(f, 1e-3) for k, f in enumerate(m.filters)}}


def pooled_at(m: Model, rows: np.ndarray, starts: np.ndarray, behind: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the largest value of each filter and its place; PIECE words at a time.
    ``behind``: zero rows behind each text, of which the first counts."""
    where, pooled = np.zeros((len(starts) - 1, CHANNELS), np.int64), np.full((len(starts) - 1, CHANNELS), -np.inf, np.float32)
    each = np.arange(CHANNELS)
    for c in range(0, len(rows), PIECE):
        values = m.convolve(m.responses(m.vectors(rows[c:c + PIECE + max(WIDTHS) - 1])))[:PIECE]
        for i in range(np.searchsorted(starts, c, side="right") - 1, len(starts) - 1):
            lo, hi = max(starts[i], c), min(starts[i + 1] - behind + 1, c + len(values))
            if starts[i] >= c + len(values):
                break
            if lo < hi:
                k = values[lo - c:hi - c].argmax(axis=0)
                best = values[lo - c + k, each]
                better = best > pooled[i]
                where[i, better], pooled[i, better] = lo + k[better], best[better]
    return where, pooled


def take_steps(m: Model, seen: dict, r: np.random.Generator, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray,
               batch: int = 32, rate: float = 0.1, drop: float = 0.6) -> None:
    """Minibatch Adagrad on weighted log loss, one pass in random order.  ``texts``: rows
    of features per word.  Only the positions that win the max pooling pass gradients
    back.  Up to a share ``drop`` of a text's words is blanked at random each time, so
    that a label has to be told from few words."""
    pad = np.zeros((max(WIDTHS), 1 + len(PREFIXES)), np.uint16)
    order = r.permutation(len(texts))
    for at in range(0, len(order), batch):
        pick = order[at:at + batch]
        parts = [x for i in pick for x in (texts[i], pad)]
        rows = np.concatenate(parts)
        rows[r.random(len(rows)) < r.random() * drop] = 0
        starts = np.concatenate([[0], np.cumsum([len(texts[i]) + len(pad) for i in pick])])
        where, pooled = pooled_at(m, rows, starts, len(pad))
        live = np.maximum(pooled + m.bias, 0)
        z = live @ m.head + m.base
        dz = ((1 / (1 + np.exp(-z)) - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
        dp = dz[:, None] * m.head * (live > 0)
        steps = {"head": live.T @ dz, "base": dz.sum(), "bias": dp.sum(axis=0)}
        touched, pull = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, m.filters)):
            at_ = where[:, k * FILTERS:(k + 1) * FILTERS]
            d = dp[:, k * FILTERS:(k + 1) * FILTERS]
            grad = np.stack([np.einsum("bf,bfd->fd", d, m.emb[rows[at_ + j]].sum(axis=2)) for j in range(w)], axis=1)
            for j in range(w):
                touched.append((at_ + j).ravel())
                pull.append((d[:, :, None] * f[None, :, j]).reshape(-1, DIM))
            seen[k] += grad ** 2
            f -= rate * grad / np.sqrt(seen[k])
        for name, g in steps.items():
            seen[name] = seen[name] + g ** 2
            setattr(m, name, (getattr(m, name) - rate * g / np.sqrt(seen[name])).astype(np.float32))
        idx = rows[np.concatenate(touched)]
        used = np.unique(idx)
        slot = np.searchsorted(used, idx)
        total = np.zeros((len(used), DIM), np.float32)
        pulls = np.concatenate(pull)
        for c in range(idx.shape[1]):
            np.add.at(total, slot[:, c], pulls)
        if used[0] == 0:
            used, total = used[1:], total[1:]
        seen["emb"][used] += (total ** 2).mean(axis=1, keepdims=True)
        m.emb[used] -= rate * total / np.sqrt(seen["emb"][used])


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 14, seed: int = 5) -> tuple[Model, dict]:
    """First passes over some texts: the model, and Adagrad's sums to go on with."""
    m, r = Model(seed), np.random.default_rng(seed)
    seen = fresh_sums(m)
    for _ in range(epochs if texts else 0):
        take_steps(m, seen, r, texts, labels, weights)
    return m, seen


def calibrate(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray, language: np.ndarray, least: int = 10) -> np.ndarray:
    """Per language the cut with the least error, in the middle of the gap, of logits
    that so many (``counts``) rows have; a language with fewer than ``least`` rows of a
    label takes the common cut."""
    def cut(at: np.ndarray) -> float:
        order = np.argsort(logits[at])
        z, y, w = logits[at][order], labels[at][order], counts[at][order]
        # rows below the cut are called 0: wrong are positives below, negatives above
        wrong = np.concatenate([[0], np.cumsum(w * (y == 1))]) + np.concatenate([np.cumsum((w * (y == 0))[::-1])[::-1], [0]]).astype(float)
        wrong[1:-1][z[1:] == z[:-1]] = np.inf  # equal logits stay together
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        k = best[len(best) // 2]
        return float((z[max(0, k - 1)] + z[min(len(z) - 1, k)]) / 2)

    if not len(logits):
        return np.zeros(LANGUAGES, np.float32)
    common = cut(np.ones(len(logits), bool))
    out = []
    for k in range(LANGUAGES):
        at = language == k
        enough = min(counts[at & (labels == y)].sum() for y in (0, 1)) >= least
        out.append(cut(at) if enough else common)
    return np.array(out, np.float32)


class Encoder:
    """Words -> rows of the embedding table, remembered up to a bound."""

    def __init__(self, most_words: int = 150_000):
        self.most, self.ids, self.rows = most_words, {}, np.zeros((1024, 1 + len(PREFIXES)), np.uint16)

    def encode(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if len(self.ids) > self.most:
            self.ids = {}
        ids = self.ids
        new = {w for w in words if w not in ids}
        if new:
            at = len(ids)
            while at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at:at + len(new)] = [features(w) for w in new]
            ids.update(zip(new, range(at, at + len(new))))
        return self.rows[np.fromiter((ids[w] for w in words), np.int64, len(words))]


class Scorer:
    """Scores texts with a model; remembers the answers of words, up to a bound."""

    def __init__(self, model: Model, most_words: int = 150_000):
        self.model, self.most = model, most_words
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        width = sum(WIDTHS) * FILTERS
        self.answers, self.language = np.zeros((1024, width), np.float32), np.zeros(1024, np.int8)
        self.ids[""] = 0  # stands behind every text: the zero vector
        self.language[0] = LANGUAGES - 1

    def look_up(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.ids]
        if new:
            at = len(self.ids)
            while at + len(new) > len(self.answers):
                self.answers, self.language = (np.concatenate([x, np.zeros_like(x)]) for x in (self.answers, self.language))
            rows = np.array([features(w) for w in new], np.int64)
            self.answers[at:at + len(new)] = self.model.responses(self.model.vectors(rows))
            self.language[at:at + len(new)] = [LANGUAGE_OF.get(w, LANGUAGES - 1) for w in new]
            self.ids.update(zip(new, range(at, at + len(new))))
        ids = self.ids
        return np.fromiter((ids[w] for w in words), np.int64, len(words))

    def pieces(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
        at, held, size = [], [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            for k in range(0, max(1, len(words)), PIECE):
                part = words[k:k + PIECE + max(WIDTHS) - 1]  # the next piece's first words, for the filters
                if size + len(part) > PIECE and held:
                    yield at, held
                    at, held, size = [], [], 0
                at.append(i)
                held.append(part)
                size += len(part)
        if held:
            yield at, held

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and language of each text."""
        pooled = np.full((len(texts), CHANNELS), -np.inf, np.float32)
        counts = np.zeros((len(texts), LANGUAGES), np.int64)
        for at, held in self.pieces(texts):
            if len(self.ids) > self.most:
                self.forget()
            pad = [""] * max(WIDTHS)
            ids = self.look_up([w for words in held for w in (*words, *pad)])
            length = np.array([len(words) for words in held])
            starts = np.concatenate([[0], np.cumsum(length + len(pad))[:-1]])
            values = self.model.convolve(self.answers[ids])
            real = np.ones(len(ids), bool)  # one position behind the text counts too
            for k in range(1, len(pad)):
                real[starts + length + k] = False
            values[~real] = -np.inf
            np.maximum.at(pooled, at, np.maximum.reduceat(values, starts, axis=0))
            flags = self.language[ids][:, None] == np.arange(LANGUAGES)
            np.add.at(counts, at, np.add.reduceat(flags, starts, axis=0, dtype=np.int64))
        counts[:, -1] = 0
        language = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), LANGUAGES - 1)
        return self.model.logits(pooled), language


def doc_hash(doc_id: str, modulus: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % modulus


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, h`` of the documents that may be learnt from; those with h mod 5 = 0
    give thresholds, the others weights."""
    return (labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
            .where(doc_hash("doc_id", 5) != 0).withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id")))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, most_chars: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For the first passes, features, labels, weights and folds of about ``most`` rows
    and ``most_chars`` characters a label at most.

    The rows are those first in hash order among the labelled rows of the
    training folds, whole texts of any length.  A row's weight is its label's
    share in all training rows over its share in the sample.
    """
    known = training_labels(labels)
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(count) < 2:
        return [], np.zeros(0), np.zeros(0), np.zeros(0)
    chars = {r.toxic: r.n or 0 for r in docs.select("doc_id", F.length("text").alias("n")).join(known, "doc_id").groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    cut = {y: min(1.0, most / n, most_chars / max(1, chars.get(y, 0))) for y, n in count.items()}
    # by a bound on the hash: about `most` rows, without a sort
    bound = F.when(F.col("toxic") == 1, F.lit(cut[1])).otherwise(F.lit(cut[0]))
    pick = materialize(known.where(F.pmod("h", F.lit(1_000_000)) < bound * 1_000_000).select("doc_id", "toxic", "h"))

    def encode(batches):
        for batch in batches:
            out = [np.array([features(w) for w in words_of(t)], np.uint16) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"].cast(pa.int32()), batch["h"], pa.array([x.tobytes() for x in out], pa.binary())],
                ["toxic", "h", "rows"])

    got = docs.select("doc_id", "text").join(pick, "doc_id").select("toxic", "h", "text").mapInArrow(
        encode, "toxic int, h long, rows binary").orderBy("h").limit(2 * most).collect()
    width = 1 + len(PREFIXES)
    texts = [np.frombuffer(r.rows, np.uint16).reshape(-1, width) for r in got]
    y = np.array([r.toxic for r in got], np.float32)
    share = {v: count[v] / sum(count.values()) * len(y) / max(1, int((y == v).sum())) for v in (0, 1)}
    return texts, y, np.array([share[int(v)] for v in y], np.float32), np.array([r.h % 5 for r in got])


def train_on_all(model: Model, seen: dict, rows: DataFrame) -> Model:
    """A pass over all of ``rows`` (text, toxic): each task's own steps, then the average of
    the tasks' models, weighted by rows."""
    shared = rows.sparkSession.sparkContext.broadcast((model, seen))  # fixed size

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        m, own = (pickle.loads(pickle.dumps(x)) for x in shared.value)
        r, n, encoder = np.random.default_rng(task), 0, Encoder()
        for b in batches:
            y, held, size = b["toxic"].to_numpy().astype(np.float32), [], 0
            for i, text in enumerate(b["text"].to_pylist()):
                held.append(encoder.encode(text))
                size += len(held[-1])
                if size > PIECE or i == len(y) - 1:  # of long texts fewer at a time
                    some = y[i + 1 - len(held):i + 1]
                    take_steps(m, own, r, held, some, np.ones(len(some), np.float32))
                    held, size = [], 0
            n += len(y)
        if n:
            yield packed_parts(m.parameters(), task, n)

    got = mean_of_tasks(rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(lean(run), PARTS), model.parameters())
    return model if got is None else model.with_parameters(got)


def logits_of(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, z, language``: logits before any threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            z, language = scorer.score(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(z.astype(np.float64)), pa.array(language.astype(np.int32))], ["doc_id", "z", "language"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, z double, language int")


def fit(docs: DataFrame, labels: DataFrame, most: int = 4_000, most_chars: int = 12_000_000, small: int = 2_000_000) -> Model | None:
    """Train on four fifths of the labelled training rows, calibrate on all of the rest;
    None without rows of both labels.  The first passes run in the driver, over a sample
    (``most``, ``most_chars``: the bounds on a label's rows and characters); then all
    rows train in Spark, in ROUNDS parts."""
    small_batches(docs.sparkSession)
    texts, y, weight, fold = labelled_sample(docs, labels, most, most_chars)
    known = materialize(training_labels(labels).select("doc_id", "toxic", F.pmod("h", F.lit(5)).alias("fold"), F.pmod(F.floor(F.col("h") / 5), F.lit(ROUNDS)).alias("round")))
    count = {r.toxic: r["count"] for r in known.where("fold != 0").groupBy("toxic").count().collect()}
    if len(count) < 2:
        return None
    own = fold != 0
    model, seen = train([t for t, k in zip(texts, own) if k], y[own], weight[own])
    light = sum(count.values()) <= small
    for k in range(ROUNDS):
        part = known.where((F.col("fold") != 0) & (F.col("round") == k))
        model = train_on_all(model, seen, docs.select("doc_id", "text").join(F.broadcast(part) if light else part, "doc_id"))
    # scores meet the labels, not texts; each 1 / STEPS of a logit is counted by language
    fold_of = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast(labels.schema["doc_id"].dataType)), F.lit(5))
    scored = logits_of(docs.where("doc_id is not null").where((doc_hash("doc_id", 5) != 0) & (fold_of == 0)), model)
    bins = (scored.join(known.where("fold = 0"), "doc_id").withColumn("bin", F.round(F.greatest(F.lit(-32.0), F.least(F.lit(32.0), "z")) * STEPS).cast("int"))
            .groupBy("language", "toxic", "bin").agg(F.count("*").alias("n")).collect())
    value = lambda name: np.array([r[name] for r in bins])
    model.shift = calibrate(value("bin") / STEPS, value("toxic"), value("n"), value("language"))
    return model


def score(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``keep``, ``score``, ``predicted`` for every row of ``docs`` (needs text).

    The whole text counts.  Null and empty texts, and texts without letters, get
    the score of no words.  Without a model every score is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: a table of TABLE x DIM
    fields = [f for f in docs.select(*keep).schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"

    def run(batches):
        m = shared.value
        scorer = Scorer(m) if m is not None else None
        for batch in batches:
            texts = batch["text"].to_pylist()
            p = np.zeros(len(texts))
            if scorer is not None and texts:
                z, language = scorer.score(texts)
                p = 1 / (1 + np.exp(-np.clip((z - m.shift[language]).astype(np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*[batch[f.name] for f in fields], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                [*[f.name for f in fields], "score", "predicted"])

    return docs.select(*keep, *["text"] * ("text" not in keep)).mapInArrow(lean(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 4_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``
    (doc_id, text), learning from ``labels`` (doc_id, toxic) whose
    crc32(doc_id) mod 5 is not 0.  A document labelled twice counts once, as
    toxic if any label says so.  Null labels are ignored.  Repeated rows are
    scored each.  Extra columns are ignored."""
    return (score(docs, fit(docs, labels, most), "doc_id")
            .select("doc_id", (doc_hash("doc_id", 5) == 0).alias("held_out"), "score", "predicted"))
