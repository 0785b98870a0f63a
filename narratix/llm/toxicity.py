"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters.

A text's words are read in overlapping windows of ``WINDOW`` words, one every ``STEP``; every window of every text is scored. A
word's input joins a vector of its own (of the words that tell labels apart best in the sample) and the mean of vectors of
its character n-grams, so unseen forms of a word are read by their letters. Attention weighs the states of a window; the
document's score is that of its worst window, through a logistic curve fitted to the training documents.

The network is trained in numpy by backpropagation through time on a bounded sample: ``sample`` labelled training documents of at
most ``LONGEST`` words and ``BYTES`` bytes each (so 200 MB at most; longer ones are left out of training, never cut). Of each document the window held worst so far is
trained on, and of clean ones another at random. Vectors start from the log-odds of their word or n-gram in the sample.

Null, empty and wordless texts are read as one window without words and get its score. Without labels of both kinds the score
is the share of toxic labels (0 if there are none). Where ids repeat in the labels, the largest label counts; null ids or labels
teach nothing. Rows are scored one by one, so repeated rows repeat; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import ALNUM, LOWER, crc_mod, ranges, sample_share, span_hashes, text_chunks, word_spans

WINDOW, STEP, HIDDEN, LONGEST, BYTES = 32, 16, 8, 4000, 32_768
WORDS, GRAMS, WORD_DIM, GRAM_DIM = 4096, 1 << 15, 6, 6


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word, and where each word's begin: its first 3, 4 and 5 bytes, last 4, and all of 4."""
    n = ends - starts
    inner = np.maximum(n - 3, 0)
    count = 4 + inner
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    salt = (np.uint64(0x51), np.uint64(0x52), np.uint64(0x53), np.uint64(0x54), np.uint64(0x55))
    with np.errstate(over="ignore"):
        for k, size in enumerate((3, 4, 5)):
            out[at + k] = span_hashes(buf, starts, np.minimum(starts + size, ends)) * salt[k]
        out[at + 3] = span_hashes(buf, np.maximum(ends - 4, starts), ends) * salt[3]
        s = ranges(starts, starts + inner)
        word = buf.astype(np.uint64)
        h = (((word[s] * np.uint64(257) + word[s + 1]) * np.uint64(257) + word[s + 2]) * np.uint64(257) + word[np.minimum(s + 3, len(buf) - 1)]) if len(s) else s.astype(np.uint64)
        h = (h + salt[4]) * np.uint64(0x9E3779B97F4A7C15)
        out[ranges(at + 4, at + count)] = h ^ (h >> np.uint64(32))
        out *= np.uint64(0xD6E8FEB86659FD93)
    return (out >> np.uint64(49)).astype(np.int64), at  # 15 bits


class Words:
    """The distinct words of a stretch of text: where each occurs, its number in the vocabulary, its n-grams."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray):
        buf = LOWER[buf]
        s, e, self.at = word_spans(buf, offsets, ALNUM)
        self.hashes, first, self.number = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
        s, e = s[first], e[first]
        end = np.cumsum(e - s)  # the distinct words alone, one behind the other
        self.grams, self.gram_at = grams(buf[ranges(s, e)], end - (e - s), end) if len(s) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.place(vocabulary)

    def place(self, vocabulary: np.ndarray) -> None:
        k = np.minimum(np.searchsorted(vocabulary, self.hashes), max(0, len(vocabulary) - 1))
        self.known = np.where(vocabulary[k] == self.hashes, k + 1, 0) if len(vocabulary) else np.zeros(len(self.hashes), np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and number of words of every window; a row without words has one empty window."""
        n = np.diff(self.at)
        count = 1 + np.maximum(0, -(-(n - WINDOW) // STEP))
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return row, self.at[:-1][row] + k * STEP, np.minimum(WINDOW, n[row] - k * STEP)


def steps(number: np.ndarray, start: np.ndarray, size: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (WINDOW, windows), places after the end being blank, and which places are words."""
    k = np.arange(WINDOW)[:, None]
    valid = k < size
    if not len(number):
        return np.full(valid.shape, blank), valid
    return np.where(valid, number[np.minimum(start + k, len(number) - 1)], blank), valid


class Model:
    """Word numbers run from 0 for unknown words; the row after the last is blank space."""

    def __init__(self, vocabulary: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.vocabulary, inputs = vocabulary, WORD_DIM + GRAM_DIM
        words = rng.normal(0, 0.05, (len(vocabulary) + 2, WORD_DIM))
        words[1:-1, 0] += word_odds
        letters = rng.normal(0, 0.05, (GRAMS, GRAM_DIM))
        letters[:, 0] += gram_odds
        words[-1] = 0
        self.p = {"words": words.astype(np.float32), "grams": letters.astype(np.float32)}
        self.p |= {f"{s}{n}": v for s in "fb" for n, v in gru.init(rng, inputs, HIDDEN).items()}
        self.p |= {"a": rng.normal(0, 0.5, (2 * HIDDEN, 8)).astype(np.float32), "q": rng.normal(0, 0.5, 8).astype(np.float32), "o": rng.normal(0, 0.5, 2 * HIDDEN).astype(np.float32), "c": np.zeros(1, np.float32)}
        self.scale, self.shift, self.constant = 1.0, 0.0, None

    def part(self, side: str) -> dict:
        return {n: self.p[side + n] for n in ("w", "u", "b", "bn")}

    def inputs(self, words: Words) -> np.ndarray:
        """A row for each distinct word, and one for blank space."""
        x = np.zeros((len(words.hashes) + 1, WORD_DIM + GRAM_DIM), np.float32)
        if len(words.hashes):
            x[:-1, :WORD_DIM] = self.p["words"][words.known]
            ends = np.append(words.gram_at, len(words.grams))
            for lo in range(0, len(words.hashes), 1 << 15):
                part = ends[lo : lo + (1 << 15) + 1]
                got = np.add.reduceat(self.p["grams"][words.grams[part[0] : part[-1]]], part[:-1] - part[0], axis=0)
                x[lo : lo + len(got), WORD_DIM:] = got / np.diff(part)[:, None]
        return x

    def pooled(self, hf, hb, valid):
        h = np.concatenate([hf, hb], 2)
        act = np.tanh(h @ self.p["a"])
        score = np.where(valid, act @ self.p["q"], -30.0)
        w = np.exp(score - score.max(0))
        w /= w.sum(0)
        return h, act, w, np.einsum("tb,tbh->bh", w, h)

    def logits(self, words: Words, start: np.ndarray, size: np.ndarray, batch: int = 2048) -> np.ndarray:
        x = self.inputs(words)
        tables = {s: x @ self.part(s)["w"] + self.part(s)["b"] for s in "fb"}
        out = np.empty(len(start), np.float32)
        for lo in range(0, len(start), batch):
            k, valid = steps(words.number, start[lo : lo + batch], size[lo : lo + batch], len(x) - 1)
            hf = gru.states(tables["f"], k, self.part("f"))
            hb = gru.states(tables["b"], k[::-1], self.part("b"))[::-1]
            out[lo : lo + batch] = self.pooled(hf, hb, valid)[3] @ self.p["o"] + self.p["c"]
        return out

    def train_batch(self, words: Words, start: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: gru.Adam) -> None:
        k, valid = steps(words.number, start, size, len(words.hashes))
        used, k = np.unique(k, return_inverse=True)
        k = k.reshape(valid.shape)
        real = used[used < len(words.hashes)]
        x = np.zeros((len(used), WORD_DIM + GRAM_DIM), np.float32)
        x[: len(real), :WORD_DIM] = self.p["words"][words.known[real]]
        ends = np.append(words.gram_at, len(words.grams))
        count = ends[real + 1] - ends[real]
        pieces = words.grams[ranges(ends[real], ends[real + 1])]
        of = np.repeat(np.arange(len(real)), count)
        x[: len(real), WORD_DIM:] = gru.summed(of, self.p["grams"][pieces], len(real)) / count[:, None] if len(real) else 0
        f, b = self.part("f"), self.part("b")
        hf, sf = gru.forward((x @ f["w"] + f["b"])[k], f)
        hb, sb = gru.forward((x @ b["w"] + b["b"])[k[::-1]], b)
        h, act, w, ctx = self.pooled(hf, hb[::-1], valid)
        d = (gru.sigmoid(ctx @ self.p["o"] + self.p["c"]) - y) * weight / weight.sum()
        g = {"o": ctx.T @ d, "c": np.array([d.sum()])}
        dctx = d[:, None] * self.p["o"]
        dw = np.einsum("bh,tbh->tb", dctx, h)
        ds = w * (dw - (w * dw).sum(0))
        g["q"] = np.einsum("tb,tbk->k", ds, act)
        dact = ds[:, :, None] * self.p["q"] * (1 - act**2)
        g["a"] = np.einsum("tbh,tbk->hk", h, dact)
        dh = w[:, :, None] * dctx + dact @ self.p["a"].T
        dx = np.zeros_like(x)
        for side, saved, p, order, dd in (("f", sf, f, k, dh[:, :, :HIDDEN]), ("b", sb, b, k[::-1], dh[::-1, :, HIDDEN:])):
            dg, du, dbn = gru.backward(dd, saved, p)
            rows = gru.summed(order, dg, len(used))
            g |= {side + "u": du, side + "b": dg.sum((0, 1)), side + "bn": dbn, side + "w": x.T @ rows}
            dx += rows @ p["w"].T
        adam.step(self.p, g)
        # plain steps for the vectors that were read
        np.add.at(self.p["words"], words.known[real], -0.5 * dx[: len(real), :WORD_DIM])
        np.add.at(self.p["grams"], pieces, -0.5 * (dx[: len(real), WORD_DIM:] / count[:, None])[of])

    def worst(self, words: Words) -> np.ndarray:
        row, start, size = words.windows()
        z = self.logits(words, start, size)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        return np.maximum.reduceat(z, first) if len(row) else z

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        z = self.scale * self.worst(Words(buf, offsets, self.vocabulary)).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def odds(n: np.ndarray, pos: np.ndarray, base: float, least: int) -> np.ndarray:
    """Clipped log-odds of toxic given presence, from the documents and toxic documents of each item; 0 for rare items."""
    out = np.log((pos + 10 * base) / (n - pos + 10 * (1 - base))) - np.log(base / (1 - base))
    return np.where(n >= least, np.clip(out, -2, 4), 0)


def presence(words: Words, y: np.ndarray, docs: int = 200):
    """Documents, and toxic documents, of each distinct word and each n-gram bucket; some documents at a time."""
    ends = np.append(words.gram_at, len(words.grams))
    w, g = np.zeros((2, len(words.hashes))), np.zeros((2, GRAMS))
    for lo in range(0, len(y), docs):
        at = words.at[lo : lo + docs + 1]
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        pairs = np.unique(doc * len(words.hashes) + words.number[at[0] : at[-1]])
        doc, word = pairs // len(words.hashes), pairs % len(words.hashes)
        np.add.at(w[0], word, 1)
        np.add.at(w[1], word, y[lo + doc])
        seen = np.unique(np.repeat(doc, ends[word + 1] - ends[word]) * GRAMS + words.grams[ranges(ends[word], ends[word + 1])])
        np.add.at(g[0], seen % GRAMS, 1)
        np.add.at(g[1], seen % GRAMS, y[lo + seen // GRAMS])
    return w, g


def trained(texts: pa.Array, y: np.ndarray, rounds: int = 5, batch: int = 128, seed: int = 9) -> Model:
    y = y.astype(np.float64)
    if not len(y) or y.min() == y.max():
        model = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(GRAMS))
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    ((_, buf, offsets),) = text_chunks(texts, 1 << 40)
    words = Words(buf, offsets, np.zeros(0, np.uint64))
    w, g = presence(words, y)
    value, gram_odds = odds(*w, y.mean(), 3), odds(*g, y.mean(), 5)
    best = np.sort(np.argsort(-np.abs(value), kind="stable")[:WORDS])  # hashes are sorted, so the vocabulary is too
    model = Model(words.hashes[best], value[best], gram_odds)
    words.place(model.vocabulary)
    row, start, size = words.windows()
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.append(first, len(row)))
    rng, adam = np.random.Generator(np.random.PCG64(seed)), gru.Adam(0.01)
    # before training, the window with the most telling word or n-grams
    x = model.inputs(words)[:, [0, WORD_DIM]] @ np.array([1, 4], np.float32)
    for k in range(rounds):
        if k:
            z = model.logits(words, start, size)
        else:
            z = np.concatenate([np.where(v, x[s], -9).max(0) for s, v in (steps(words.number, start[i : i + 8192], size[i : i + 8192], len(words.hashes)) for i in range(0, len(start), 8192))])
        order = np.lexsort((z, row))
        worst = order[np.append(first[1:], len(row)) - 1]
        other = first + rng.integers(0, count)
        use = np.concatenate([worst, other[y == 0]])
        label = np.concatenate([y, np.zeros(int((y == 0).sum()))])
        weight = np.where(label == 1, min(5.0, (label == 0).sum() / max(1, (label == 1).sum())), 1.0)
        adam.rate = 0.01 / (1 + k)
        for at in np.array_split(rng.permutation(len(use)), max(1, len(use) // batch)):
            model.train_batch(words, start[use[at]], size[use[at]], label[at], weight[at], adam)
    z = model.worst(words).astype(np.float64)
    a, b = 1.0, 0.0
    for _ in range(300):  # Newton steps, held back so that separable labels do not run off
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((q - y) * z).sum() + 1.0 * (a - 1), (q - y).sum() + 0.1 * b])
        v = q * (1 - q)
        hess = np.array([[(v * z * z).sum() + 1.0, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
    model.scale, model.shift = float(a), float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, sample: int = 6000) -> Model:
    """Learn from labels of documents whose crc32(doc_id) mod `mod` is not 0; `sample` labelled documents at most."""
    known = labels.where((crc_mod("doc_id", mod) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = sample_share(known.count(), sample)
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0
    texts = docs.where((crc_mod("doc_id", mod) != 0) & pick & (F.coalesce(F.octet_length("text"), F.lit(0)) <= BYTES) & (F.size(F.split(F.coalesce("text", F.lit("")), r"\s+", LONGEST + 1)) <= LONGEST)).select("doc_id", "text")
    got = texts.join(known.where(pick), "doc_id").limit(sample).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("double").alias("toxic"))
    got = got.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return trained(got.column("text").combine_chunks(), got.column("toxic").to_numpy())


def _score(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, buf, offsets in text_chunks(batch.column("text"), 1 << 22):
                out[first : first + len(offsets) - 1] = model.scores(buf, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out)], [*keep, "score"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score for every row."""
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), list(keep)), f"{own}, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents (all columns) that score below the threshold."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return score(rows, model, ("row",)).where(F.col("score") < threshold).select("row.*")
