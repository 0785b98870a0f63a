"""Language identification: a bidirectional gated recurrent network over bytes.

Every byte of every text is labelled, in windows of ``WINDOW`` bytes that tile the text; the document's language is that with
the largest mean of log-probabilities over its positions, its score the softmax of those means; they are summed window by window. The
network is trained in numpy by backpropagation through time on windows from a bounded sample: ``sample`` training documents, an equal
share for each language (``least`` at least), ``per_doc`` windows of each.

A null text or one without a letter is `und` with score 0, and so is every text when nothing can be learned. Texts are
scored row by row, so repeated rows repeat; an empty table gives an empty result. Ties go to the first language by name. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gru
from .common import crc_mod, sample_share, text_chunks

WINDOW, HIDDEN, UNKNOWN = 96, 8, "und"


def windows(sizes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the windows that tile stretches of bytes."""
    n = -(-sizes // width)
    of = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return starts[of] + k * width, np.minimum(width, sizes[of] - k * width)


class Model:
    def __init__(self, languages: list[str], seed: int = 11, hidden: int = HIDDEN):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.languages, k = languages, len(languages)
        self.p = {f"f{n}": v for n, v in gru.init(rng, 256, hidden).items()} | {f"b{n}": v for n, v in gru.init(rng, 256, hidden).items()}
        self.p |= {"vf": rng.normal(0, 0.3, (hidden, k)).astype(np.float32), "vb": rng.normal(0, 0.3, (hidden, k)).astype(np.float32), "c": np.zeros(k, np.float32)}

    def part(self, side: str) -> dict:
        return {n: self.p[side + n] for n in ("w", "u", "b", "bn")}

    def train(self, data: np.ndarray, label: np.ndarray, rounds: int = 500, batch: int = 128, seed: int = 5) -> None:
        """data: (windows, WINDOW) bytes, whole windows only; every position has its window's label."""
        rng, adam = np.random.Generator(np.random.PCG64(seed)), gru.Adam(0.015)
        for k in range(rounds):
            adam.rate = 0.015 * (1 - k / rounds) + 0.001
            at = rng.integers(0, len(data), batch)
            x, y = data[at].T, label[at]
            f, b = self.part("f"), self.part("b")
            hf, sf = gru.forward(f["w"][x] + f["b"], f)
            hb, sb = gru.forward(b["w"][x[::-1]] + b["b"], b)
            logits = hf @ self.p["vf"] + hb[::-1] @ self.p["vb"] + self.p["c"]
            e = np.exp(logits - logits.max(2, keepdims=True))
            d = e / e.sum(2, keepdims=True)
            d[:, np.arange(len(y)), y] -= 1
            d /= d.shape[0] * d.shape[1]
            g = {"vf": np.einsum("tbh,tbk->hk", hf, d), "vb": np.einsum("tbh,tbk->hk", hb[::-1], d), "c": d.sum((0, 1))}
            for side, h, saved, steps, dd in (("f", f, sf, x, d), ("b", b, sb, x[::-1], d[::-1])):
                dg, du, dbn = gru.backward(dd @ self.p["v" + side].T, saved, h)
                g |= {side + "w": gru.summed(steps, dg, 256), side + "u": du, side + "b": dg.sum((0, 1)), side + "bn": dbn}
            adam.step(self.p, g)

    def labelled(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cells: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows by number, log-probabilities (places, windows, languages) of their positions, and which places are theirs; about `cells` numbers at once."""
        order = np.argsort(-sizes, kind="stable")
        tables = {s: self.part(s)["w"] + self.part(s)["b"] for s in "fb"}
        batch = max(16, cells // (WINDOW * max(HIDDEN, len(self.languages))))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            s, n = starts[own], sizes[own]
            k = np.arange(int(n.max()))[:, None]
            valid = k < n
            ahead = gru.states(tables["f"], buf[np.where(valid, s + k, s)], self.part("f"))
            back = gru.states(tables["b"], buf[np.where(valid, s + n - 1 - k, s)], self.part("b"))
            back = back[np.where(valid, n - 1 - k, 0), np.arange(len(own))]
            out = ahead @ self.p["vf"] + back @ self.p["vb"] + self.p["c"]
            out -= out.max(2, keepdims=True)
            out -= np.log(np.exp(out).sum(2, keepdims=True))
            yield own, out, valid

    def positions(self, text: str) -> list[str]:
        """The language of every byte of a text."""
        buf = np.frombuffer(text.encode(), np.uint8)
        starts, sizes = windows(np.array([len(buf)]), np.array([0]), WINDOW)
        best = np.zeros(len(buf), np.int64)
        for own, out, valid in self.labelled(buf, starts, sizes):
            k, w = np.nonzero(valid)
            best[starts[own[w]] + k] = out.argmax(2)[k, w]
        return [self.languages[k] for k in best]

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities (rows, languages), pooled over all positions of each row; empty rows are uniform."""
        sizes = np.diff(offsets)
        starts, width = windows(sizes, offsets[:-1], WINDOW)
        sums = np.zeros((len(starts), len(self.languages)))
        for own, out, valid in self.labelled(buf, starts, width):
            sums[own] = np.where(valid[:, :, None], out, 0).sum(0, dtype=np.float64)
        full = np.flatnonzero(sizes)
        mean = np.zeros((len(sizes), len(self.languages)))
        if len(full):
            mean[full] = np.add.reduceat(sums, np.searchsorted(starts, offsets[:-1][full]), axis=0) / sizes[full, None]
        e = np.exp(mean - mean.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _cut(per_doc: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for lang, text in zip(f["lang"], f["text"], strict=True):
                raw = text.encode()
                at = np.unique(np.linspace(0, max(0, len(raw) - WINDOW), per_doc).astype(int))
                rows += [(lang, (raw[a : a + WINDOW] * (WINDOW // max(1, len(raw)) + 1))[:WINDOW]) for a in at]
            yield pd.DataFrame(rows, columns=["lang", "data"])

    return run


def fit(docs: DataFrame, mod: int = 5, sample: int = 3000, least: int = 50, per_doc: int = 6) -> Model:
    """Learn from documents whose crc32(doc_id) mod `mod` is not 0, per_doc windows of each.

    Languages are counted over all of them, and each gets an equal share of `sample` documents, but `least` or all that it has, so
    a rare language is learned too.
    """
    own = docs.where((crc_mod("doc_id", mod) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    each = max(least, sample // max(1, len(counts)))
    shares = docs.sparkSession.createDataFrame([(k, sample_share(n, each)) for k, n in sorted(counts.items())], "lang string, share long")
    drawn = own.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.col("share")) == 0)
    # copies of one text can be drawn together: of each language no more than its share comes back
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"))
    drawn = drawn.withColumn("place", F.row_number().over(place)).where(F.col("place") <= each).select("lang", "text")
    got = drawn.mapInPandas(_cut(per_doc), "lang string, data binary").toPandas()
    got = got.sort_values(["lang", "data"], kind="stable")
    languages = sorted(got["lang"].unique())
    model = Model(languages)
    if len(languages) > 1:
        model.train(np.frombuffer(b"".join(got["data"]), np.uint8).reshape(-1, WINDOW), np.searchsorted(languages, got["lang"].to_numpy()))
    return model


def _predict(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            lang, score = [], []
            letter = batch.column("letter").to_pylist()
            for first, buf, offsets in text_chunks(batch.column("text"), 1 << 20):
                p = model.documents(buf, offsets) if model.languages else np.zeros((len(offsets) - 1, 1))
                best = p.argmax(1)
                for i, (k, q) in enumerate(zip(best.tolist(), p.max(1).tolist(), strict=True)):
                    known = letter[first + i] and model.languages
                    lang.append(model.languages[k] if known else UNKNOWN)
                    score.append(min(1.0, q) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_predict(shared, list(keep)), f"{own}, lang_pred string, score double")
