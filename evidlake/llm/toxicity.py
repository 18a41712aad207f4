"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as two vectors: its own embedding, if the training texts hold it often enough, and the sum of the
embeddings of its character trigrams. The network reads windows of words that overlap by half; attention pools a
window's states into one logit, and a document's score is that of its highest window.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import pieces, texts, trimmed

LENGTH, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, STATES = 8, 8, 8
TRIGRAMS = 1 << 13
# Bounds of what is learned from: labelled rows of each class, and words with an embedding of their own.
ROWS_OF_A_CLASS, VOCABULARY, LEAST_ROWS = 1500, 20_000, 10
# SHARE: what texts of class 1 weigh together in the loss, whatever their number.
EPOCHS, BATCH, RATE, DECAY, SMOOTH, SHARE = 8, 128, 0.01, 0.02, 0.05, 0.35
# Few texts are gone through more often, up to about so many steps.
STEPS = 300
# Bytes of text, words and windows that are worked through at once.
RUN, WORDS_AT_ONCE, WINDOWS_AT_ONCE = 1 << 19, 1 << 16, 1024
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def letters() -> np.ndarray:
    """What each byte counts as within a word: itself, A-Z as a-z; 0 between words."""
    table = np.zeros(256, np.uint8)
    for c in range(256):
        if chr(c).isalnum() and c < 128 or c >= 128:
            table[c] = ord(chr(c).lower()) if c < 128 else c
    return table


LETTERS = letters()


class Words:
    """The words of some texts: hashes, and the trigram number of every byte of theirs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        x = LETTERS[data]
        inside = x > 0
        row_begins = np.zeros(n + 1, bool)
        row_begins[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | row_begins[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | row_begins[1:n]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        # Words of each row: from rows[i] to rows[i + 1].
        self.rows = np.searchsorted(self.begin, offsets)
        if not len(self.begin):
            self.hashes, self.trigrams = np.zeros(0, np.uint64), np.zeros(0, np.int32)
            self.bounds = np.zeros(1, np.int64)
            return
        power = np.cumprod(np.append(np.uint64(1), np.full(n, _STEP)), dtype=np.uint64)
        back = np.cumprod(np.append(np.uint64(1), np.full(n, _BACK)), dtype=np.uint64)
        h = np.add.reduceat(x.astype(np.uint64) * power[:n], self.begin) * back[self.begin]
        self.hashes = h ^ (h >> np.uint64(31))
        before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        before[1:], after[:-1] = x[:-1], x[1:]
        before[self.begin], after[self.end - 1] = 0, 0
        t = (before * np.uint32(65599) + x) * np.uint32(65599) + after
        t = (t * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAMS.bit_length() + 1)
        self.trigrams = t[inside].astype(np.int32)
        self.bounds = np.append(0, np.cumsum(self.end - self.begin))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window and its row; every word is in one, and rows without words have none."""
        n = np.diff(self.rows)
        count = np.where(n > 0, 1 + -(-np.maximum(n - LENGTH, 0) // STRIDE), 0)
        row = np.repeat(np.arange(len(n)), count)
        nr = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return self.rows[row] + nr * STRIDE, row

    def places(self, first: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Word numbers (LENGTH, windows), -1 after a row's last word."""
        at = first + np.arange(LENGTH)[:, None]
        return np.where(at < self.rows[row + 1], at, -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, p: dict[str, np.ndarray], vocabulary: np.ndarray):
        self.p, self.vocabulary = p, vocabulary

    def word_numbers(self, words: Words) -> np.ndarray:
        """Row of each word's embedding; 0 for words without one."""
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words.hashes, at + 1, 0) if len(words.hashes) else at

    def inputs(self, words: Words, numbers: np.ndarray, which: slice) -> np.ndarray:
        """Both vectors of the words."""
        bounds = words.bounds[which.start : which.stop + 1]
        chars = self.p["chars"][words.trigrams[bounds[0] : bounds[-1]]]
        summed = np.add.reduceat(chars, bounds[:-1] - bounds[0], axis=0) if len(bounds) > 1 else chars[:0]
        return np.concatenate([self.p["words"][numbers[which]], summed], axis=1)

    def gates(self, words: Words) -> np.ndarray:
        """What every word adds to the gates of both directions; the last row is for places after the last word: it keeps a state."""
        numbers = self.word_numbers(words)
        out = np.zeros((len(numbers) + 1, 6 * STATES), np.float32)
        for i in range(0, len(numbers), WORDS_AT_ONCE):
            part = slice(i, min(i + WORDS_AT_ONCE, len(numbers)))
            out[part] = self.inputs(words, numbers, part) @ self.p["in"] + self.p["in_bias"]
        out[-1, :STATES] = out[-1, 3 * STATES : 4 * STATES] = 30
        return out

    def states(self, g: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (LENGTH, windows, STATES) of one direction. g: gate inputs (LENGTH, windows, 3 * STATES)."""
        u = self.p["rec"][direction]
        h = np.zeros((g.shape[1], STATES), np.float32)
        out = np.empty((*g.shape[:2], STATES), np.float32)
        for t in range(LENGTH) if direction == 0 else range(LENGTH - 1, -1, -1):
            a = h @ u
            zr = sigmoid(g[t, :, : 2 * STATES] + a[:, : 2 * STATES])
            z, r = zr[:, :STATES], zr[:, STATES:]
            n = np.tanh(g[t, :, 2 * STATES :] + r * a[:, 2 * STATES :])
            if keep is not None:
                keep.append((t, h, z, r, n, a[:, 2 * STATES :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def pool(self, h: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention weights (LENGTH, windows) and pooled states. h: both directions."""
        s = h @ self.p["attend"]
        s[empty] = -1e9
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", s, h)
        return pooled @ self.p["out"] + self.p["out_bias"][0], s, pooled

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Logit and row of every window."""
        first, row = words.windows()
        gates = self.gates(words)
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), WINDOWS_AT_ONCE):
            part = slice(i, i + WINDOWS_AT_ONCE)
            at = words.places(first[part], row[part])
            g = gates[at]
            h = np.concatenate([self.states(g[..., d * 3 * STATES : (d + 1) * 3 * STATES], d) for d in (0, 1)], axis=2)
            out[part] = self.pool(h, at < 0)[0]
        return out, row

    def scores(self, words: Words, rows: int) -> np.ndarray:
        """Score of each row: of its highest window, or for a row without words of no evidence at all."""
        logits, row = self.window_logits(words)
        best = np.full(rows, -np.inf, np.float32)
        np.maximum.at(best, row, logits)
        best = np.where(np.isinf(best), np.minimum(self.p["out_bias"][0], -0.1), best)
        return 1 / (1 + np.exp(-best.astype(np.float64)))

    def gradients(self, words: Words, numbers: np.ndarray, first: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy of some windows, by going back through the pooling, both directions and the inputs."""
        p, s = self.p, STATES
        at = words.places(first, row)
        empty = at < 0
        used, local = np.unique(at[~empty], return_inverse=True)
        slot = np.full(at.shape, len(used))
        slot[~empty] = local
        n = words.bounds[used + 1] - words.bounds[used]
        chars = words.trigrams[np.repeat(words.bounds[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        owner = np.repeat(np.arange(len(used)), n)
        summed = np.add.reduceat(p["chars"][chars], np.cumsum(n) - n, axis=0)
        x = np.concatenate([p["words"][numbers[used]], summed], axis=1)
        gates = np.concatenate([x @ p["in"] + p["in_bias"], np.zeros((1, 6 * s), np.float32)])
        gates[-1, :s] = gates[-1, 3 * s : 4 * s] = 30
        g = gates[slot]
        kept: list[list] = [[], []]
        h = np.concatenate([self.states(g[..., d * 3 * s : (d + 1) * 3 * s], d, kept[d]) for d in (0, 1)], axis=2)
        logit, alpha, pooled = self.pool(h, empty)
        out: dict[str, np.ndarray] = {}
        e = ((sigmoid(logit) - y) * weight).astype(np.float32)
        out["out"], out["out_bias"] = pooled.T @ e, np.array([e.sum()], np.float32)
        to_pooled = e[:, None] * p["out"]
        by = np.einsum("tbh,bh->tb", h, to_pooled)
        to_s = alpha * (by - (alpha * by).sum(axis=0))
        out["attend"] = np.einsum("tb,tbh->h", to_s, h)
        to_h = alpha[..., None] * to_pooled + to_s[..., None] * p["attend"]
        to_g = np.zeros_like(g)
        out["rec"] = np.zeros_like(p["rec"])
        for d in (0, 1):
            u, back = p["rec"][d], np.zeros((at.shape[1], s), np.float32)
            for t, before, z, r, cand, mixed in reversed(kept[d]):
                dh = back + to_h[t, :, d * s : (d + 1) * s]
                dn = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (before - cand) * z * (1 - z)
                dr = dn * mixed * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                to_g[t, :, d * 3 * s : (d + 1) * 3 * s] = np.concatenate([dz, dr, dn], axis=1)
                out["rec"][d] += before.T @ da
                back = dh * z + da @ u.T
        flat = np.zeros((len(used) + 1, 6 * s), np.float32)
        np.add.at(flat, slot.ravel(), to_g.reshape(-1, 6 * s))
        flat = flat[:-1]
        out["in"], out["in_bias"] = x.T @ flat, flat.sum(axis=0)
        to_x = flat @ p["in"].T
        out["words"], out["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(out["words"], numbers[used], to_x[:, :WORD_DIM])
        np.add.at(out["chars"], chars, to_x[owner, WORD_DIM:])
        return out


def log_odds(items: np.ndarray, rows: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n items how much likelier rows of class 1 hold it, smoothed; within -1 and 1."""
    pair = np.unique(items.astype(np.int64) * len(y) + rows)
    item, label = pair // len(y), y[pair % len(y)]
    hit, miss = (np.bincount(item, weights=w, minlength=n) for w in (label, 1 - label))
    odds = np.log((hit + 1) / (y.sum() + 2)) - np.log((miss + 1) / ((1 - y).sum() + 2))
    return np.clip(odds / 4, -1, 1).astype(np.float32)


def train(rows: list[bytes], labels: np.ndarray, seed: int = 5) -> Network:
    """Fit the network on whole texts with labels 0 and 1.

    Embeddings start with the log odds of their word or trigram in one component. In each epoch the highest window of
    every text, as the network sees it then, and one more at random of texts of class 0 are learned with Adam; labels are
    smoothed and weights decay, as some labels are wrong.
    """
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float32)
    words = Words(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))
    owner = np.repeat(np.arange(len(rows)), np.diff(words.rows))
    distinct, number = np.unique(words.hashes, return_inverse=True)
    held = np.bincount(np.unique(number.astype(np.int64) * len(rows) + owner) // len(rows), minlength=len(distinct)) if len(number) else np.zeros(0)
    often = np.flatnonzero(held >= LEAST_ROWS)
    often = np.sort(often[np.argsort(-held[often], kind="stable")[:VOCABULARY]])
    vocabulary = distinct[often] if len(often) else np.zeros(1, np.uint64)
    dims = WORD_DIM + CHAR_DIM

    def start(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {
        "words": start(len(vocabulary) + 1, WORD_DIM, scale=0.05), "chars": start(TRIGRAMS, CHAR_DIM, scale=0.02),
        "in": start(dims, 6 * STATES, scale=0.3), "in_bias": np.zeros(6 * STATES, np.float32),
        "rec": start(2, STATES, 3 * STATES, scale=0.2), "attend": start(2 * STATES, scale=0.2),
        "out": start(2 * STATES, scale=0.3), "out_bias": np.zeros(1, np.float32),
    }
    net = Network(p, vocabulary)
    if not len(rows) or y.min() == y.max() or not len(owner):
        p["out_bias"][0] = 4.0 if len(rows) and y.min() == 1 else -4.0
        p["out"][:] = 0
        return net
    numbers = net.word_numbers(words)
    p["words"][:, 0] = log_odds(numbers, owner, y, len(vocabulary) + 1)
    p["words"][0] = 0
    p["chars"][:, 0] = log_odds(words.trigrams, np.repeat(owner, np.diff(words.bounds)), y, TRIGRAMS)
    first, row = words.windows()
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    balance = np.where(y == 1, SHARE / y.mean(), (1 - SHARE) / (1 - y.mean()))
    steps, per_epoch = 0, max(1, 2 * len(rows) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    # The first pick: the window with the highest sum of log odds.
    value = np.append(0, np.cumsum(p["words"][numbers, 0]))
    logits = value[np.minimum(first + LENGTH, words.rows[row + 1])] - value[first]
    for epoch in range(epochs):
        if epoch:
            logits = net.window_logits(words)[0]
        order = np.lexsort((logits, row))
        top = order[np.append(row[order][1:] != row[order][:-1], True)]
        extra = rng.permutation(len(row))
        extra = extra[y[row[extra]] == 0][: len(top)]
        chosen = rng.permutation(np.concatenate([top, extra]))
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for i in range(0, len(chosen), BATCH):
            some = chosen[i : i + BATCH]
            grads = net.gradients(words, numbers, first[some], row[some], SMOOTH + (1 - 2 * SMOOTH) * y[row[some]], balance[row[some]] / len(some))
            steps += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[k] -= rate * ((m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6) + DECAY * p[k] * (p[k].ndim > 1))
    return net


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_OF_A_CLASS) -> bytes:
    """The network, learned from at most ``rows`` labelled documents of each class: those first by a hash of doc_id.

    Held-out documents, null ids and labels don't count; a document with several labels has the highest, one with
    several texts the last of them. Without any, all scores are low. The fit runs
    in one task, whose rows have that bound; the driver gets the parameters alone (about 1 MB).
    """
    known = labels.where(labels["doc_id"].isNotNull() & labels["toxic"].isNotNull()).groupBy(
        labels["doc_id"].cast("long").alias("d")
    ).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("d")))
    order = F.xxhash64("d")
    some = known.where("toxic = 1").orderBy(order, "d").limit(rows).unionByName(known.where("toxic = 0").orderBy(order, "d").limit(rows))
    found = texts(docs).join(F.broadcast(some), F.col("doc_id") == F.col("d")).groupBy("d").agg(
        F.max("text").alias("text"), F.max("toxic").alias("toxic")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(d, t.encode(), y) for b in batches for d, t, y in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        held.sort()
        net = train([t for _, t, _ in held], np.array([y for *_, y in held], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([save(net)], pa.binary())], ["net"])

    learned = found.repartition(1).mapInArrow(trimmed(run), "net binary").first()
    return bytes(learned["net"]) if learned else save(train([], np.zeros(0, np.int64)))


def save(net: Network) -> bytes:
    to = io.BytesIO()
    np.savez(to, vocabulary=net.vocabulary, **net.p)
    return to.getvalue()


def load(raw: bytes) -> Network:
    with np.load(io.BytesIO(raw)) as f:
        p = {k: f[k] for k in f.files}
    return Network({k: v for k, v in p.items() if k != "vocabulary"}, p["vocabulary"])


def score(docs: DataFrame, net: bytes) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, over all its overlapping windows.

    A null, empty or wordless text has the score of the output's bias, below 0.5. Rows with the same doc_id or a
    null one are scored each. No rows: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(sent.value)
        for batch in batches:
            for data, offsets, rows in pieces(batch, size=RUN):
                values = model.scores(Words(data, offsets), len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], pa.array(values)], ["doc_id", "score"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below 0.5; columns stay. Rows are judged one by one, so equal texts fare alike."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    columns = [n for n in docs.columns]
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(sent.value)
        for batch in batches:
            filled = batch.set_column(columns.index("text"), "text", batch.column("text").fill_null(""))
            for data, offsets, rows in pieces(filled, size=RUN):
                values = model.scores(Words(data, offsets), len(offsets) - 1)
                yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array(values < 0.5))

    return docs.mapInArrow(trimmed(run), schema)
