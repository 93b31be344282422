"""Scoring texts with a small causal self-attention model trained in numpy.

Words are cut into subword ids by a public byte-pair vocabulary.  The model
attends over windows of subwords; windows overlap, and each subword is scored in
exactly one of them.  The next subword is predicted as a class and then as a
member of the class; classes, and the members beyond the model's own
vocabulary, come from the subword counts of all training documents.

Training begins in the driver on windows of a bounded sample and goes on in Spark
over all training texts, whole: in each of some rounds every task takes gradient steps
on its part of a round's texts, and the tasks' parameters are averaged, weighted by
windows.

A word's probability is interpolated from the product of its subwords' and its
share among all training words.  Those counts too are taken over all training
documents: the commonest words' (a fixed number) go to every task, the rest meet
theirs in a join.
"""

from __future__ import annotations

import base64
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, averaged, keep_memory, materialize, mean_of_tasks, packed_parts, small_batches  # noqa: F401

#: Fixed value: the public split pattern of this byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_ID, IDS = 50_256, 50_257
END = b"\n"  # no word holds it: stands for the end of a text
WINDOW, STRIDE = 32, 24
OWN, DIM, HIDDEN = 4096, 16, 48
COMMON = 1 << 19  # words whose counts every task gets
ROUNDS, SHARE, SLICE = 2, 1, 600  # rounds of training in Spark, each on a part of the texts; of these one of so many characters, in slices of so many or more
MIX = 0.2  # of the words' own counts in the interpolation
SEEN = 300_000  # different words that a task counts before it passes them on
PART = 64  # longer words are cut so for the vocabulary
LN10 = np.log(10.0)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def tokens_of(text: bytes | str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and the end.  Of bytes, lower() knows just A-Z and
    split() just the space and the controls 9-13."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return [*data.lower().split(), END]


class Vocabulary:
    """Words -> numbers, hashes and subword ids, remembered up to a bound."""

    def __init__(self, ranks: bytes, most: int = 800_000):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, special_tokens={}, mergeable_ranks=table)
        self.spaced = np.zeros(IDS, bool)
        self.spaced[[i for b, i in table.items() if b.startswith(b" ")]] = True
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {END: 0}
        self.hashes, self.start, self.size = np.array([word_hash(END)]), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([END_ID], np.int32)

    def subwords(self, word: bytes) -> list[int]:
        if word == END:
            return [END_ID]
        word = word.decode("utf-8", "replace")
        if len(word) <= PART:
            return self.bpe.encode_ordinary(" " + word)
        return [i for k in range(0, len(word), PART) for i in self.bpe.encode_ordinary(" " * (k == 0) + word[k:k + PART])]

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of words, one after the other, and how many each has.  Words
        are cut in one call; a subword that begins with a space begins a word."""
        plain = [w for w in words if w != END and len(w) <= PART]
        ids = np.array(self.bpe.encode_ordinary(b"".join(b" " + w for w in plain).decode("utf-8", "replace")), np.int32)
        first = np.flatnonzero(self.spaced[ids])
        if len(first) != len(plain) or len(plain) != len(words):
            parts = [self.subwords(w) for w in words]
            return np.array([i for p in parts for i in p], np.int32), np.array([len(p) for p in parts])
        return ids, np.diff(np.append(first, len(ids)))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        numbers = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            new = list({words[i] for i in unknown})
            at, (flat, size) = len(self.ids), self.cut(new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
            self.hashes = np.concatenate([self.hashes, np.array([word_hash(w) for w in new], np.int64)])
            self.ids.update(zip(new, range(at, at + len(new))))
            numbers[unknown] = [self.ids[words[i]] for i in unknown]
        return numbers

    def spell(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.repeat(self.start[numbers] - (ends - size), size)
        return self.flat[at + np.arange(len(at))]


#: A worker's vocabulary serves all its tasks.
WORKER: dict[int, Vocabulary] = {}


def vocabulary(ranks: bytes) -> Vocabulary:
    key = hash(ranks)
    if key not in WORKER:
        WORKER.clear()
        WORKER[key] = Vocabulary(ranks)
    return WORKER[key]


def classes(share: np.ndarray, each: float = 1.0) -> np.ndarray:
    """Where classes start among ids in falling order of their shares: slices for which
    the numbers computed per prediction, one per class (counted ``each``) and one per
    member of the target's class, are fewest on the mean."""
    n, mass = len(share), np.concatenate([[0.0], np.cumsum(share)])
    best, last = np.zeros(n + 1), np.zeros(n + 1, int)
    for j in range(1, n + 1):
        cost = best[:j] + (mass[j] - mass[:j]) * np.arange(j, 0, -1)
        cost[-1] = best[j - 1]  # the only member is certain
        last[j] = cost.argmin()
        best[j] = cost[last[j]] + each
    starts, j = [], n
    while j:
        j = last[j]
        starts.append(j)
    return np.array(starts[::-1])


def powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of ``z``, in its place, and the sums over the last axis; values above 60 count as 60."""
    if z.size and z.max() > 60:
        np.minimum(z, 60, out=z)
    e = np.exp(z, out=z)
    return e, e @ np.ones((z.shape[-1], 1), z.dtype)


class Model:
    """Parameters; ids in the order of classes.  ``place``: id -> row, OWN rows
    at most, else the row of the rare class; ``rare``: log-probabilities of ids
    within the rare class."""

    def __init__(self, counts: np.ndarray, seed: int = 3):
        order = np.argsort(-counts, kind="stable")
        own = order[:max(1, min(OWN, int((counts > 0).sum())))]
        self.n = len(own)
        self.place = np.full(IDS, self.n, np.int32)
        self.place[own] = np.arange(self.n)
        starts = classes((counts[own] + 1.0) / (counts[own] + 1.0).sum())
        self.bounds = np.concatenate([starts, [self.n]])  # classes as slices of rows; the rare class stands last
        self.cls = np.concatenate([np.repeat(np.arange(len(starts)), np.diff(self.bounds)), [len(starts)]]).astype(np.int32)
        rest = np.where(self.place == self.n, counts + 1.0, 0.0)
        self.rare = np.log(np.maximum(rest, 1e-300) / max(1.0, rest.sum()))
        r = np.random.default_rng(seed)
        normal = lambda s, *shape: r.normal(0, s, shape).astype(np.float32)
        self.p = {
            "emb": normal(0.3, self.n + 2, DIM), "q": normal(0.25, DIM, DIM), "k": normal(0.25, DIM, DIM), "v": normal(0.25, DIM, DIM),
            "far": np.zeros(WINDOW, np.float32), "w1": normal(0.2, 2 * DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            "wc": normal(0.1, HIDDEN, len(starts) + 1), "bc": np.zeros(len(starts) + 1, np.float32),
            "wd": normal(0.1, self.n, HIDDEN),
            "bd": np.log((counts[own] + 1.0) / (counts[own].max() + 1.0)).astype(np.float32),
        }
        self.causal = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)
        self.back = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0)

    def copy(self) -> Model:
        out = Model.__new__(Model)
        out.__dict__ = self.__dict__ | {"p": {k: v.copy() for k, v in self.p.items()}}
        return out

    def windows(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions [n, WINDOW] into ``ids`` (texts end at ``ends``) and which of them
        each window scores.  The first window of a text scores all its positions, a
        later one those beyond the former's."""
        begins = np.concatenate([[0], ends[:-1]])
        size = ends - begins
        count = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        at = (begins[text] + nth * STRIDE)[:, None] + np.arange(WINDOW)
        scored = (at < ends[text][:, None]) & ((nth == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
        return at, scored

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every input row: query, key and value; its part of the hidden layer."""
        p = self.p
        return p["emb"] @ self.joint(), p["emb"] @ p["w1"][:DIM] + p["b1"]

    def joint(self) -> np.ndarray:
        p = self.p
        return np.concatenate([p["q"] * np.float32(DIM ** -0.5), p["k"], p["v"]], axis=1)

    def hidden(self, rows: np.ndarray, table: np.ndarray, lead: int = 0) -> dict:
        """Masked attention over a batch of windows of input rows [n, WINDOW]; the
        first ``lead`` positions are seen but ask nothing."""
        y = table.take(rows, axis=0)
        q, k, v = y[:, lead:, :DIM], y[..., DIM:2 * DIM], y[..., 2 * DIM:]
        e = np.matmul(q, k.transpose(0, 2, 1))
        e += (self.p["far"][self.back] + self.causal)[lead:]
        e, total = powers(e)
        a = np.matmul(e, v)
        a /= total
        return {"q": q, "k": k, "v": v, "e": e, "total": total, "a": a}

    def pieces(self, rows: np.ndarray, mask: np.ndarray, table: np.ndarray, batch: int = 64) -> tuple[list, np.ndarray, np.ndarray]:
        """Attention, a few windows at a time so that a processor's cache holds them, of
        those that score all their positions and of those that score the last STRIDE:
        windows, lead, values and the places of masked positions of each piece; the input
        rows at these places, and their order among all masked positions."""
        nth, out, own, order, whole = np.cumsum(mask).reshape(mask.shape) - 1, [], [], [], mask[:, :WINDOW - STRIDE].any(axis=1)
        for lead, some in ((0, np.flatnonzero(whole)), (WINDOW - STRIDE, np.flatnonzero(~whole))):
            for b in range(0, len(some), batch):
                which = some[b:b + batch]
                at = np.flatnonzero(mask[which, lead:])
                out.append((which, lead, self.hidden(rows[which], table, lead), at))
                own.append(rows[which, lead:].ravel()[at])
                order.append(nth[which, lead:].ravel()[at])
        return out, np.concatenate(own), np.concatenate(order)

    def heads(self, h: np.ndarray, target: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Log-probability (natural) of each target row given hidden values [m, HIDDEN];
        gradients are those of the mean of its negative."""
        p, cls = self.p, self.cls[target]
        # in the order of classes, so that each class is a slice
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        h, target, cls = h.take(order, axis=0), target[order], cls[order]
        z = h @ p["wc"]
        z += p["bc"]
        each, one = np.arange(len(h)), h.dtype.type(1 / len(h))
        logs = z[each, cls]
        e, total = powers(z)
        logs = np.minimum(logs, 60) - np.log(total[:, 0])
        if grads is not None:
            e *= one / total
            e[each, cls] -= one
            grads["wc"], grads["bc"], dh = h.T @ e, np.ones(len(e), e.dtype) @ e, e @ p["wc"].T
            grads["wd"], grads["bd"] = np.zeros_like(p["wd"]), np.zeros_like(p["bd"])
        edges = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=len(self.bounds)))])
        for c in range(len(self.bounds)):
            at = slice(edges[c], edges[c + 1])
            if at.start == at.stop:
                continue
            if c == len(self.bounds) - 1:
                logs[at] += self.rare[ids[order[at]]]
                continue
            lo, hi = self.bounds[c], self.bounds[c + 1]
            if hi - lo == 1:
                continue
            mine, wd = h[at], p["wd"][lo:hi]
            z = mine @ wd.T
            z += p["bd"][lo:hi]
            own = (each[:len(z)], target[at] - lo)
            is_ = np.minimum(z[own], 60)
            e, total = powers(z)
            logs[at] += is_ - np.log(total[:, 0])
            if grads is not None:
                e *= one / total
                e[own] -= one
                grads["wd"][lo:hi], grads["bd"][lo:hi] = e.T @ mine, np.ones(len(e), e.dtype) @ e
                dh[at] += e @ wd
        out = np.empty_like(logs)
        out[order] = logs
        if grads is not None:
            grads["h"] = np.empty_like(dh)
            grads["h"][order] = dh
        return out

    def inputs(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input and target rows: each text is read one step behind, from a start row."""
        target = self.place[ids]
        before = np.concatenate([[self.n + 1], target[:-1]])
        before[ends[:-1]] = self.n + 1
        return before, target

    def log10(self, ids: np.ndarray, ends: np.ndarray, batch: int = 512) -> np.ndarray:
        """log10 probability of each id, texts ending at ``ends``; every text has one at least."""
        before, target = self.inputs(ids, ends)
        out, (at, scored), (keys, first) = np.zeros(len(ids)), self.windows(ids, ends), self.tables()
        before = np.append(before, np.zeros(WINDOW, before.dtype))
        for b in range(0, len(at), batch):
            where, mask = at[b:b + batch], scored[b:b + batch]
            parts, rows, order = self.pieces(before[where], mask, keys)
            own = where[mask][order]
            h = np.concatenate([f["a"].reshape(-1, DIM).take(i, axis=0) for *_, f, i in parts]) @ self.p["w1"][DIM:]
            h += first.take(rows, axis=0)
            np.maximum(h, 0, out=h)
            out[own] = self.heads(h, target[own], ids[own])
        return out / LN10

    def step(self, rows: np.ndarray, mask: np.ndarray, target: np.ndarray, ids: np.ndarray) -> tuple[float, dict]:
        """Mean loss and gradients of a batch of windows."""
        p, g, joint = self.p, {}, self.joint()
        keys = p["emb"] @ joint
        parts, own, order = self.pieces(rows, mask, keys)
        # what the hidden layer reads: the row itself, what it attends to
        x = np.concatenate([p["emb"].take(own, axis=0), np.concatenate([f["a"].reshape(-1, DIM).take(i, axis=0) for *_, f, i in parts])], axis=1)
        h = x @ p["w1"]
        h += p["b1"]
        np.maximum(h, 0, out=h)
        loss = -self.heads(h, target[order], ids[order], g)
        dz = g.pop("h")
        dz *= h > 0
        g["w1"], g["b1"] = x.T @ dz, np.ones(len(dz), dz.dtype) @ dz
        dx = dz @ p["w1"].T
        far, dj, begin = np.zeros((WINDOW, WINDOW)), np.zeros_like(joint), 0
        seen, slopes = [own], [dx[:, :DIM]]
        for which, lead, f, i in parts:
            da = np.zeros_like(f["a"])
            da.reshape(-1, DIM)[i] = dx[begin:begin + len(i), DIM:]
            begin += len(i)
            s, dy = np.divide(f["e"], f["total"], out=f["e"]), np.zeros((len(which), WINDOW, 3 * DIM), keys.dtype)
            ds = np.matmul(da, f["v"].transpose(0, 2, 1))
            ds -= (da * f["a"]) @ np.ones((DIM, 1), da.dtype)
            ds *= s
            far[lead:] += ds.sum(axis=0)
            dy[:, lead:, :DIM] = np.matmul(ds, f["k"])
            dy[..., DIM:2 * DIM], dy[..., 2 * DIM:] = np.matmul(ds.transpose(0, 2, 1), f["q"]), np.matmul(s.transpose(0, 2, 1), da)
            dy, all_ = dy.reshape(-1, 3 * DIM), rows[which].ravel()
            dj += p["emb"].take(all_, axis=0).T @ dy
            seen.append(all_)
            slopes.append(dy @ joint.T)
        g["q"], g["k"], g["v"] = dj[:, :DIM] * np.float32(DIM ** -0.5), dj[:, DIM:2 * DIM], dj[:, 2 * DIM:]
        g["far"] = np.bincount(self.back.ravel(), far.ravel(), WINDOW).astype(np.float32)
        rows, slopes, g["emb"] = np.concatenate(seen), np.concatenate(slopes), np.zeros_like(p["emb"])
        order = rows.astype(np.uint16).argsort(kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g["emb"][rows[starts]] = np.add.reduceat(slopes.take(order, axis=0), starts)
        return float(loss.mean()), g


class Adam:
    """Gradient steps on a model."""

    def __init__(self, model: Model):
        self.model, self.t = model, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))

    def step(self, rows: np.ndarray, mask: np.ndarray, target: np.ndarray, ids: np.ndarray, rate: float) -> None:
        _, g = self.model.step(rows, mask, target, ids)
        self.t += 1
        for k, x in self.model.p.items():
            d, m, v = g[k], self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * d
            v *= 0.99
            d *= d
            d *= 0.01
            v += d
            np.sqrt(v, out=d)
            d *= (1 - 0.99 ** self.t) ** -0.5
            d += 1e-6
            np.divide(m, d, out=d)
            d *= rate / (1 - 0.9 ** self.t)
            x -= d


def train(model: Model, ids: np.ndarray, ends: np.ndarray, steps: int = 2000, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Model:
    """Steps over random batches of windows; the rate falls to a fifth."""
    before, target = model.inputs(ids, ends)
    at, scored = model.windows(ids, ends)
    at = np.minimum(at, len(ids) - 1)
    r, adam = np.random.default_rng(seed), Adam(model)
    for t in range(1, steps + 1):
        pick = r.integers(0, len(at), batch)
        mask, where = scored[pick], at[pick]
        own = where[mask]
        adam.step(before[where], mask, target[own], ids[own], rate * (1 - 0.8 * t / steps))
    return model


def slices(train_docs: DataFrame, share: int, seed: int) -> DataFrame:
    """``text``: one of ``share`` characters of all texts; of a long text a slice at a
    place given by its hash, of short ones a slice of some."""
    size, h = F.length("text").cast("long"), lambda name: F.xxhash64(F.lit(f"{name}{seed}"), "doc_id", "text")
    wide = F.greatest(F.lit(SLICE), F.floor(size / share)).cast("int")
    at = F.pmod(h("place"), F.greatest(F.lit(1), size - wide + 1)).cast("int")
    return (train_docs.where((size > 0) & (F.pmod(h("slice"), F.least(size, F.lit(SLICE)) * share) < size))
            .select(F.substr("text", at + 1, wide).alias("text")))


def round_of(train_docs: DataFrame, k: int) -> DataFrame:
    """The texts of round ``k``: each text is in one of ROUNDS."""
    return train_docs.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(ROUNDS)) == k)


def train_on_all(model: Model, train_docs: DataFrame, ranks, share: int, seed: int, rate: float, batch: int = 256) -> Model:
    """One round: each task's own steps on one of ``share`` characters, all windows of
    it, then the average, weighted by windows.  The model stays only where the slices
    are empty."""
    shared = train_docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    names = sorted(model.p)

    def run(batches):
        from pyspark import TaskContext

        keep_memory()
        task, v = TaskContext.get().partitionId(), vocabulary(ranks.value)
        m, held, n_held, n_all = shared.value.copy(), [], 0, 0
        adam = Adam(m)

        def steps(least: int) -> tuple[list, int]:
            """Steps on the windows held, as long as there are ``least``; what is left."""
            rows, mask, target, ids = (np.concatenate(x) for x in zip(*held))
            j = 0
            while len(rows) - j >= least:
                some = slice(j, j + batch)
                adam.step(rows[some], mask[some], target[some][mask[some]], ids[some][mask[some]], rate)
                j += batch
            return [(rows[j:], mask[j:], target[j:], ids[j:])], max(0, len(rows) - j)

        for b in batches:
            texts = b["text"].to_pylist()
            for k in range(0, len(texts), 200):
                if len(v.ids) > v.most:
                    v.forget()
                words = [tokens_of(t) for t in texts[k:k + 200]]
                numbers = v.look_up([w for p in words for w in p])
                ids, ends = v.spell(numbers), np.cumsum(v.size[numbers])[np.cumsum([len(p) for p in words]) - 1]
                before, target = m.inputs(ids, ends)
                at, scored = m.windows(ids, ends)
                at = np.minimum(at, len(ids) - 1)
                held.append((before[at], scored, target[at], ids[at]))
                n_held, n_all = n_held + len(at), n_all + len(at)
                if n_held >= batch:
                    held, n_held = steps(batch)
        if n_held:
            steps(1)  # the last windows too, and those of a task that has few
        if n_all:
            yield packed_parts([m.p[k] for k in names], task, n_all)

    got = mean_of_tasks(slices(train_docs, share, seed).select(F.col("text").cast("binary").alias("text")).mapInArrow(run, PARTS), [model.p[k] for k in names])
    if got is None:
        return model
    out = model.copy()
    out.p.update(zip(names, got))
    return out


def remainder(modulus: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % modulus


def count_tokens(train_docs: DataFrame, ranks) -> DataFrame:
    """``kind, key, n``: counts of words (kind 0, key the word's hash) and of
    subwords (kind 1, key the id) over all texts, combined in each task first."""
    def run(batches):
        v, seen = vocabulary(ranks.value), Counter()

        def flush():
            words, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
            sub = np.zeros(IDS)
            if len(v.ids) > v.most:
                v.forget()
            numbers = v.look_up(words)
            for k in range(0, len(words), 20_000):
                some = numbers[k:k + 20_000]
                sub += np.bincount(v.spell(some), np.repeat(n[k:k + 20_000], v.size[some]), IDS)
            used, hashes = np.flatnonzero(sub), v.hashes[numbers]
            kind = np.concatenate([np.zeros(len(n), np.int32), np.ones(len(used), np.int32)])
            return pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(np.concatenate([hashes, used])), pa.array(np.concatenate([n, sub[used].astype(np.int64)]))], ["kind", "key", "n"])

        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(tokens_of(text))
                if len(seen) > SEEN:
                    yield flush()
                    seen.clear()
        yield flush()

    return (train_docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "kind int, key long, n long")
            .groupBy("kind", "key").agg(F.sum("n").alias("n")))


def sample(train_docs: DataFrame, ranks: bytes, n_docs: int, most: int, most_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of about ``most`` training texts, by hash order, for the first
    gradient steps; of each a run of at most ``most_chars`` characters at a place
    given by the hash."""
    share = min(1.0, most / max(1, n_docs))
    h = F.pmod(F.xxhash64(F.lit("lm"), "doc_id"), F.lit(1_000_000))
    at = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.lit(1), F.length("text") - most_chars + 1)).cast("int")
    rows = (train_docs.where(h < share * 1_000_000).select(h.alias("h"), "doc_id", F.substr("text", at + 1, F.lit(most_chars)).alias("text"))
            .orderBy("h", "doc_id", "text").limit(2 * most).collect())
    v = Vocabulary(ranks)
    ids = [v.spell(v.look_up(tokens_of(r.text))) for r in rows]
    return np.concatenate(ids or [np.zeros(0, np.int32)]), np.cumsum([len(x) for x in ids], dtype=np.int64)


class Fitted:
    """What was learnt: the model, words' counts ``hash, n`` (a DataFrame), those of
    the commonest, the number of tokens and of different words, the vocabulary."""

    def __init__(self, model, words, common, total, distinct, ranks):
        self.model, self.words, self.common, self.total, self.distinct, self.ranks = model, words, common, total, distinct, ranks


def fit(docs: DataFrame, modulus: int = 7, held: int = 2, tokenizer: str = TOKENIZER, sample_docs: int = 1_500, sample_chars: int = 20_000,
        share: int = SHARE) -> Fitted:
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    small_batches(spark)
    train_docs = docs.select("doc_id", "text").where(remainder(modulus) != held)
    counts = materialize(count_tokens(train_docs, ranks))
    words = counts.where("kind = 0").select(F.col("key").alias("hash"), "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    subword = np.zeros(IDS)
    for r in counts.where("kind = 1").collect():  # one row per id of the vocabulary at most
        subword[r.key] = r.n
    common = words.orderBy(F.col("n").desc(), "hash").limit(COMMON).toArrow().sort_by("hash")
    ids, ends = sample(train_docs, ranks.value, int(subword[END_ID]), sample_docs, sample_chars)
    model = Model(subword)
    if len(ids):
        train(model, ids, ends)
        for k in range(ROUNDS):
            model = train_on_all(model, round_of(train_docs, k), ranks, share, k, 0.002 / (k + 1))
    return Fitted(model, words, (common["hash"].to_numpy(), common["n"].to_numpy()), total, distinct, ranks)


def score(docs: DataFrame, modulus: int = 7, held: int = 2, **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    for every row of ``docs`` (doc_id, text).

    Learns from the rows whose crc32(doc_id as text) mod ``modulus`` is not
    ``held``: word and subword counts from all of them, attention weights from
    ``sample_docs`` of them (``sample_chars`` of each at most) and then, in ROUNDS
    rounds, from all of them (or one of ``share`` characters of each).  Null and empty texts hold only the end.  Words are
    known by a 64-bit hash.  Repeated rows count and are scored each; a null id
    counts as remainder 0.  Without training rows the model is untrained and
    all counts are 0.  Extra columns are ignored.  ``tokenizer``: file of the
    vocabulary, read by the driver.
    """
    return score_with(fit(docs, modulus, held, **options), docs, modulus, held)


def score_with(fitted: Fitted, docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """``score`` with what was learnt before."""
    docs, words, ranks = docs.select("doc_id", "text"), fitted.words, fitted.ranks
    total, distinct = fitted.total, fitted.distinct
    shared = docs.sparkSession.sparkContext.broadcast((fitted.model, *fitted.common))
    width = np.log10(total + distinct + 1.0)

    def run(batches):
        keep_memory()
        m, known, n_of = shared.value
        v = vocabulary(ranks.value)
        cost = np.zeros(0)  # log10 of a common word's share; nan for others

        for batch in batches:
            texts = batch["text"].to_pylist()
            for k in range(0, len(texts), 200):
                if len(v.ids) > v.most:
                    v.forget()
                    cost = np.zeros(0)
                parts = [tokens_of(t) for t in texts[k:k + 200]]
                numbers = v.look_up([w for p in parts for w in p])
                new = v.hashes[len(cost):]
                if len(new):
                    at = np.minimum(np.searchsorted(known, new), max(0, len(known) - 1))
                    hit = known[at] == new if len(known) else np.zeros(len(new), bool)
                    cost = np.concatenate([cost, np.where(hit, np.log10(n_of[at] + 1.0) - width if len(known) else 0.0, np.nan)])
                size = np.array([len(p) for p in parts])
                text = np.repeat(np.arange(len(parts)), size)
                each = cost[numbers]
                common_ = ~np.isnan(each)
                sub = v.size[numbers]
                last = np.cumsum(sub)
                word = np.add.reduceat(m.log10(v.spell(numbers), last[np.cumsum(size) - 1]), last - sub)
                mixed = np.log10(MIX * np.exp(LN10 * each[common_]) + (1 - MIX) * np.exp(LN10 * word[common_]))
                total_of = lambda x: np.bincount(text[common_], x, len(parts))
                rare = np.flatnonzero(~common_)
                row, own = batch["row"].to_numpy()[k:k + 200], batch["doc_id"].slice(k, 200)
                no, zero = np.zeros(len(rare)), np.zeros(len(row), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([row, row[text[rare]]])), pa.concat_arrays([own, pa.nulls(len(rare), own.type)]),
                    pa.array(np.concatenate([row, v.hashes[numbers[rare]]])), pa.array(np.concatenate([zero, zero[:1].repeat(len(rare)) + 1])),
                    pa.array(np.concatenate([size, no.astype(np.int64)])),
                    pa.array(np.concatenate([np.bincount(text[common_], minlength=len(parts)), no.astype(np.int64)])),
                    pa.array(np.concatenate([total_of(each[common_]), no])), pa.array(np.concatenate([total_of(mixed), word[rare]]))],
                    ["row", "doc_id", "hash", "n", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(
        run, f"row long, doc_id {kind}, hash long, n long, n_tokens long, n_known long, base_score double, score double")
    # a text's row has n = 0 and a hash that spreads it; each rarer word has a row with n = 1 and its subwords' score
    got = parts.join(words.withColumnRenamed("n", "c"), "hash", "left")
    c = F.coalesce("c", F.lit(0))
    share = F.log10(c + 1.0) - F.lit(float(width))
    mixed = F.log10(F.lit(MIX) * F.pow(F.lit(10.0), share) + F.lit(1 - MIX) * F.pow(F.lit(10.0), "score"))
    a_word = F.col("n") > 0
    out = got.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(a_word & (c > 0), F.lit(1)).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.when(a_word, share).otherwise(F.col("base_score"))).alias("base_score"),
        F.sum(F.when(a_word, mixed).otherwise(F.col("score"))).alias("score"))
    return out.select("doc_id", (remainder(modulus) == held).alias("held_out"), "n_tokens", "n_known",
                      F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
