"""Language-model scores: smoothed unigrams over the whole training corpus, and a log-bilinear neural model.

Words of every training document are counted, partially in each task and then by a shuffle on the word. The neural model
predicts classes: the ``TOP`` most frequent tokens are classes of their own, all others fall into ``BUCKETS`` classes by their last
bytes, and a word's share of its class is its smoothed count. Two preceding classes predict the next one by a sum of products
of their vectors with a matrix for each place. The parameters are trained in numpy by noise-contrastive estimation on class trigrams of
all training documents, whose counts one pass over the texts sums: on the driver up to ``DRAWS`` tokens. Of a larger corpus a draw of so many from the counts, by a hash, gives the start
alone; tasks then train on every distinct trigram, weighted by its count, in ``PASSES`` shares between which their models are averaged. The places of a context add up
before the softmax, so one matrix product gives the normalisers of all contexts (1089 squared), and a token's log-probability is three numbers looked up.

Scoring looks up counts of the ``FREQUENT`` most frequent tokens (a broadcast of that many hashes and counts, bounded whatever
the corpus) by 64-bit hash; all other tokens of a document are joined with the counted words by the word itself.

Null, empty and wordless texts hold the end token alone. Without training documents every class is equally likely. Rows are
scored one by one, so repeated rows repeat; an empty table gives an empty result. A null doc_id belongs to the fold of the
empty text. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import LOWER, SPACED, crc_mod, materialize, ranges, span_hashes, text_chunks, word_spans

TOP, BUCKETS, FREQUENT, DRAWS, ALPHA, END = 1024, 64, 1 << 20, 1 << 22, 0.1, ""
CLASSES, START = TOP + BUCKETS, TOP + BUCKETS
CHUNK = 1 << 22
#: Passes over shares of all trigrams, and the most models that one pass gives.
PASSES, TASKS = 4, 48
#: Trigrams that a task holds before it sums them; their order among tasks and batches is that of the code times this odd number.
HELD, MIX = 1 << 22, np.uint64(0x9E3779B97F4A7C15)
#: Leading bits by which a frequent word's hash is found.
LEAD = 20


def words_of(buf: np.ndarray, offsets: np.ndarray):
    buf = LOWER[buf]
    s, e, at = word_spans(buf, offsets, SPACED)
    return buf, s, e, at, span_hashes(buf, s, e)


def strings(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    offsets = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
    data = buf[ranges(s, e)]
    return pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = 0
    for batch in batches:
        ends += batch.num_rows
        for _, buf, offsets in text_chunks(batch.column("text"), 2 * CHUNK):
            buf, s, e, _, h = words_of(buf, offsets)
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([strings(buf, s[first], e[first]), pa.array(n.astype(np.int64))], ["word", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([END], pa.string()), pa.array([ends], pa.int64())], ["word", "n"])


def bucket(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A word's class among the rare: by its last two bytes that are not ASCII punctuation, roughly its ending."""
    last = e - 1
    mark = np.isin(buf[last], np.frombuffer(b".,;:!?)\"'", np.uint8)) & (last > s)
    last = last - mark
    two = np.where(last > s, buf[np.maximum(last - 1, 0)], 0).astype(np.uint64) * np.uint64(256) + buf[last]
    with np.errstate(over="ignore"):
        return TOP + ((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, bucket and count of each word; the end has hash 0 and bucket 0."""
    for batch in batches:
        for lo, buf, at in text_chunks(batch.column("word"), 1 << 22):
            n = batch.column("c").to_numpy()[lo : lo + len(at) - 1]
            full = at[1:] > at[:-1]
            k, h = np.zeros(len(n), np.int64), np.zeros(len(n), np.uint64)
            k[full] = bucket(buf, at[:-1][full], at[1:][full])
            h[full] = span_hashes(buf, at[:-1][full], at[1:][full])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k), pa.array(n)], ["h", "k", "c"])


def placed(values: np.ndarray, near: np.ndarray, x: np.ndarray) -> np.ndarray:
    """np.searchsorted(values, x), the last place at most; near: a place for each, not behind that."""
    most = len(values) - 1
    k = np.minimum(near, most)
    short = np.flatnonzero(values[k] < x)
    for _ in range(8):
        k[short] = np.minimum(k[short] + 1, most)
        short = short[values[k[short]] < x[short]]
    k[short] = np.minimum(np.searchsorted(values, x[short]), most)
    return k


@dataclass
class Tables:
    """What scoring looks up; size is bounded by TOP, BUCKETS and FREQUENT."""

    hashes: np.ndarray  # of frequent words, sorted
    counts: np.ndarray  # by hash
    kind: np.ndarray  # their class, -1: by bucket
    end_count: int
    total: int
    distinct: int
    bucket_log: np.ndarray  # log10 of each bucket's smoothed total
    model: tuple[np.ndarray, ...] = ()  # vectors of the last class and of the one before, of the predicted class, its bias
    log_z: np.ndarray | None = None  # by context; this and the following are made in the process that looks
    products: tuple[np.ndarray, ...] = ()  # of the last class, its bias included, and of the one before with each predicted class
    leads: np.ndarray | None = None  # the first of the hashes with these leading bits, or behind them

    def look(self, h: np.ndarray):
        """The first place of each hash among the sorted ones, or -1: a few steps on from the first of its leading bits."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        if self.leads is None:
            self.leads = np.searchsorted(self.hashes, np.arange(1 << LEAD, dtype=np.uint64) << np.uint64(64 - LEAD)).astype(np.int32)
        k = placed(self.hashes, self.leads[h >> np.uint64(64 - LEAD)], h)
        return np.where(self.hashes[k] == h, k, -1)

    def classes(self, buf, s, e, at, found) -> np.ndarray:
        """Classes of each row's words and its end, row after row."""
        kind = np.where(found >= 0, self.kind[found] if len(self.kind) else -1, -1)
        rest = kind < 0
        kind[rest] = bucket(buf, s[rest], e[rest])
        rows = len(at) - 1
        out = np.zeros(len(s) + rows, np.int64)  # the end is class 0
        out[np.arange(len(s)) + np.repeat(np.arange(rows), np.diff(at))] = kind
        return out

    def log_p(self, context: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log10 of the model's probability of each class in its context."""
        if self.log_z is None:
            last, before, q, b = (x.astype(np.float64) for x in self.model)
            of_last, of_before = last @ q.T + b, before @ q.T
            self.log_z = normalisers(of_last, of_before).astype(np.float32).ravel()
            self.products = of_last.astype(np.float32).ravel(), of_before.astype(np.float32).ravel()
        two, one = np.divmod(context, CLASSES + 1)
        out = self.products[0][one * CLASSES + kind].astype(np.float64)
        out += self.products[1][two * CLASSES + kind]
        out -= self.log_z[context]
        return out / math.log(10)

    def contexts(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of the context before each token."""
        rows = len(at) - 1
        first = at[:-1] + np.arange(rows)
        one, two = np.roll(classes, 1), np.roll(classes, 2)
        one[first], two[first] = START, START
        second = first + 1
        second = second[second < np.append(first[1:], len(classes))] if rows else second
        two[second] = START
        return two * (CLASSES + 1) + one


def normalisers(of_last: np.ndarray, of_before: np.ndarray) -> np.ndarray:
    """log of the sum over the classes of exp(of_before[two] + of_last[one]) for each (two, one)."""
    top, top_before = of_last.max(1), of_before.max(1)
    sums = np.exp(of_before - top_before[:, None]) @ np.exp(of_last - top[:, None]).T
    with np.errstate(divide="ignore"):
        out = np.log(sums) + top_before[:, None] + top
    two, one = np.nonzero(sums < 1e-200)  # the classes likely after the one are beyond reach after the other: products may have vanished
    for lo in range(0, len(two), 4096):
        z = of_before[two[lo : lo + 4096]] + of_last[one[lo : lo + 4096]]
        top = z.max(1)
        out[two[lo : lo + 4096], one[lo : lo + 4096]] = top + np.log(np.exp(z - top[:, None]).sum(1))
    return out


def summed(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams and their counts, in the order of the mixed code: what lies together has nothing in common."""
    with np.errstate(over="ignore"):
        mixed = code.astype(np.uint64) * MIX
    if n is None:
        mixed, n = np.unique(mixed, return_counts=True)
        with np.errstate(over="ignore"):
            return (mixed * np.uint64(pow(int(MIX), -1, 1 << 64))).astype(np.int64), n.astype(np.int64)
    order = np.argsort(mixed)
    mixed = mixed[order]
    first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]])) if len(mixed) else np.zeros(0, np.int64)
    return code[order[first]], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def _batches(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(code), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(code[lo : lo + (1 << 18)]), pa.array(n[lo : lo + (1 << 18)])], ["code", "n"])


def _trigrams(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = shared.value
        held, size = [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, buf, offsets in text_chunks(batch.column("text"), CHUNK):
                buf, s, e, at, h = words_of(buf, offsets)
                k = t.classes(buf, s, e, at, t.look(h))
                held.append(t.contexts(k, at) * CLASSES + k)
                size += len(k)
                if size >= HELD:
                    yield from _batches(*summed(np.concatenate(held)))
                    held, size = held[:1], 0
        yield from _batches(*summed(np.concatenate(held)))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a trigram as one; only distinct trigrams are kept, whose number the classes bound."""
    held, size, own = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0, 0
    for batch in batches:
        held.append((batch.column("code").to_numpy(), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size >= max(HELD // 4, own):
            held, size = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0
            own = len(held[0][0])
    yield from _batches(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))


def drawn_from(trigrams: DataFrame, share: int) -> DataFrame:
    """One in `share` of the tokens of each trigram, what is over by its hash: a draw that no order or dealing of the rows changes."""
    return trigrams.select("code", F.expr(f"(n + pmod(xxhash64(code, 17), {share}L)) div {share}L").alias("n")).where("n > 0")


def start(code: np.ndarray, n: np.ndarray, dims: int = 24, noise: int = 12, rounds: int | None = None, batch: int = 1024, seed: int = 17) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Noise-contrastive estimation on drawn trigrams; a round for each batch of them drawn, 500 at least and 5,000 at most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rounds = rounds or int(np.clip(n.sum() // batch, 500, 5000))
    unigram = np.bincount(code % CLASSES, weights=n, minlength=CLASSES) + 0.5
    unigram /= unigram.sum()
    r = rng.normal(0, 0.3, (CLASSES + 1, dims)) * (len(code) > 0)
    parts = [r, np.eye(dims) * 0.7, np.eye(dims) * 0.3, rng.normal(0, 0.3, (CLASSES, dims)), np.log(unigram)]
    sums = [np.full(x.shape, 1e-6) for x in parts]
    upto, draw = np.cumsum(n.astype(np.float64)), noise_of(unigram)
    for k in range(rounds if len(code) else 0):
        at = np.minimum(np.searchsorted(upto, rng.random(batch) * upto[-1]), len(code) - 1)
        step(parts, sums, code[at], np.full(batch, 1 / batch), unigram, draw, noise, 0.1 * (1 - k / rounds) + 0.005, rng)
    return parts, sums


def noise_of(unigram: np.ndarray):
    """A function from uniform numbers to classes with these shares."""
    upto, parts = np.cumsum(unigram), 1 << 16
    near = np.searchsorted(upto, np.arange(parts) / parts)
    return lambda x: placed(upto, near[(x.ravel() * parts).astype(np.int64)], x.ravel()).reshape(x.shape)


def step(parts: list[np.ndarray], sums: list[np.ndarray], code: np.ndarray, weight: np.ndarray, unigram: np.ndarray, draw, noise: int, rate: float, rng) -> None:
    """One step of noise-contrastive estimation in place, scaled by the sums of squared gradients; weight: of each trigram; draw: see noise_of."""
    r, c1, c2, q, b = parts
    context, word = code // CLASSES, code % CLASSES
    two, one = context // (CLASSES + 1), context % (CLASSES + 1)
    w = np.concatenate([word[:, None], draw(rng.random((len(code), noise)))], 1)
    pred, own = r[one] @ c1 + r[two] @ c2, q.take(w, axis=0)
    s = np.einsum("bd,bkd->bk", pred, own) + (b - np.log(noise * unigram))[w]
    d = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    d[:, 0] -= 1
    d *= weight[:, None]
    dpred = np.einsum("bk,bkd->bd", d, own)
    flat, by, row = w.ravel(), d.ravel(), np.repeat(np.arange(len(code)), noise + 1)
    gb = np.bincount(flat, weights=by, minlength=CLASSES)
    gq = np.stack([np.bincount(flat, weights=x[row] * by, minlength=CLASSES) for x in pred.T.copy()], 1)  # no row of a vector for each pair
    gr = gru.summed(np.concatenate([one, two]), np.concatenate([dpred @ c1.T, dpred @ c2.T]), CLASSES + 1)
    for x, g, acc in zip(parts, (gr, r[one].T @ dpred, r[two].T @ dpred, gq, gb), sums, strict=True):
        acc += g * g
        x -= rate * g / np.sqrt(acc)


def vectors(parts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The model as scoring takes it."""
    r, c1, c2, q, b = parts
    return tuple(x.astype(np.float32) for x in (r @ c1, r @ c2, q, b))


def train(code: np.ndarray, n: np.ndarray, **options) -> tuple[np.ndarray, ...]:
    """The model of all the trigrams given."""
    return vectors(start(code, n, **options)[0])


def _pass(shared, most: int, mean: float, rate: float, seed: int, noise: int = 12, batch: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sums, unigram = shared.value
        parts, sums, draw = [x.copy() for x in parts], [x.copy() for x in sums], noise_of(unigram)
        rng, seen, shown = np.random.Generator(np.random.PCG64([seed, TaskContext.get().partitionId() if TaskContext.get() else 0])), 0, 0
        for rows in batches:
            code, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
            times = -(-n // most)  # a frequent trigram is shown several times, with its share of the count
            code, weight = np.repeat(code, times), np.repeat(n / times, times)
            order = rng.permutation(len(code))
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                step(parts, sums, code[at], weight[at] / (mean * batch), unigram, draw, noise, rate, rng)
            seen, shown = seen + int(n.sum()), shown + len(code)
        if shown:
            blob = np.concatenate([x.ravel() for x in (*parts, *sums)]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([seen], pa.int64()), pa.array([shown], pa.int64())], ["parts", "seen", "shown"])

    return run


def refine(trigrams: DataFrame, parts: list[np.ndarray], sums: list[np.ndarray], passes: int = PASSES) -> tuple[list[np.ndarray], int]:
    """The model after every distinct trigram (code, n) of the corpus, weighted by its count, and the tokens seen.

    Each pass takes the trigrams of one share by hash, in parallel from the same model, and the results are averaged by
    what they were shown; at most TASKS models come to the driver at once.
    """
    spark = trigrams.sparkSession
    facts = trigrams.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    most = max(1, -(-facts["n"] // facts["v"]))
    unigram = np.full(CLASSES, 0.5)
    for row in trigrams.groupBy((F.col("code") % CLASSES).alias("w")).agg(F.sum("n").alias("n")).collect():  # one row for each class
        unigram[row["w"]] += row["n"]
    unigram /= unigram.sum()
    shown = trigrams.agg(F.sum(F.ceil(F.col("n") / most))).first()[0]
    seen = 0
    for k in range(passes):
        shared = spark.sparkContext.broadcast((parts, sums, unigram))
        own = trigrams.where(F.pmod(F.xxhash64("code"), F.lit(passes)) == k).coalesce(TASKS)
        got = own.mapInArrow(_pass(shared, most, facts["n"] / shown, 0.05 * (1 - k / passes) + 0.005, k), "parts binary, seen long, shown long").toArrow().to_pylist()
        seen += sum(g["seen"] for g in got)
        all_ = sum(g["shown"] for g in got)
        if not all_:
            continue
        flat = sum(np.frombuffer(g["parts"]) * (g["shown"] / all_) for g in got)
        ends = np.cumsum([x.size for x in (*parts, *sums)])[:-1]
        new = [x.reshape(y.shape) for x, y in zip(np.split(flat, ends), (*parts, *sums), strict=True)]
        parts, sums = new[: len(parts)], new[len(parts) :]
        shared.unpersist()
    return parts, seen


def _score(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = shared.value
        key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        log_c = np.log10(t.counts + ALPHA)
        for batch in batches:
            for lo, buf, offsets in text_chunks(batch.column("text"), CHUNK):
                buf, s, e, at, h = words_of(buf, offsets)
                rows = len(at) - 1
                found = t.look(h)
                rare = found < 0
                kind = t.classes(buf, s, e, at, found)
                lm = t.log_p(t.contexts(kind, at), kind)
                lm[kind >= TOP] -= t.bucket_log[kind[kind >= TOP] - TOP]
                own = np.where(rare, 0.0, log_c[found] if len(log_c) else 0.0)  # rare words' counts come later
                known = np.where(rare, 0, t.counts[found] > 0 if len(log_c) else 0)
                row = np.repeat(np.arange(rows), np.diff(at))
                in_class = kind[np.arange(len(s)) + row] >= TOP
                sums = lambda x, r=row, n=rows: np.bincount(r, weights=x, minlength=n)
                first = at[:-1] + np.arange(rows)
                lm_sum = np.add.reduceat(lm, first) if rows else np.zeros(0)
                end = math.log10(t.end_count + ALPHA)
                # rare words of each row, once each
                of, which = row[rare], h[rare]
                order = np.lexsort((which, of))
                of, which = of[order], which[order]
                new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (which[1:] != which[:-1])])) if len(of) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(of)))
                at_word = np.flatnonzero(rare)[order][new]
                items = pa.StructArray.from_arrays([strings(buf, s[at_word], e[at_word]), pa.array(times.astype(np.int64))], ["word", "n"])
                bounds = np.searchsorted(of[new], np.arange(rows + 1)).astype(np.int32)
                rare_list = pa.ListArray.from_arrays(pa.array(bounds), items)
                part = batch.slice(lo, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + np.arange(rows)),
                        *(part.column(c) for c in keep),
                        pa.array(np.diff(at) + 1),
                        pa.array((sums(known) + (t.end_count > 0)).astype(np.int64)),
                        pa.array(sums(own) + end),
                        pa.array(lm_sum + sums(np.where(in_class, own, 0.0))),
                        rare_list,
                    ],
                    ["key", *keep, "n_tokens", "n_known", "log_c", "log_p", "rare"],
                )
                key += rows

    return run


def score(docs: DataFrame, mod: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, held_out, n_tokens, n_known, train_tokens, base_score and score; learns where crc32(doc_id) mod `mod` is not 0."""
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    learn = docs.where(crc_mod("doc_id", mod) != 0).select("text")
    words = learn.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    words = materialize(words, "lm-words")
    facts = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = facts["n"] or 0, facts["v"]
    # the least count that leaves no more than FREQUENT words; one row per power-of-two-like class of counts comes back
    step = F.floor(F.log2("c") * 16)
    least, held = 0, 0
    for r in words.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("k")).collect():
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["c"]
    # hashes, buckets and counts come to the driver, never words: 24 bytes each
    hashed = words.mapInArrow(_hashed, "h long, k long, c long")
    frequent = hashed.where((F.col("c") >= least) & (F.col("h") != 0) if least else F.lit(False)).toArrow()
    hashes, count = frequent.column("h").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    order = np.argsort(hashes, kind="stable")
    top = np.lexsort((hashes, -count))[: TOP - 1]
    kind = np.full(len(hashes), -1, np.int64)
    kind[top] = 1 + np.arange(len(top))
    ends = words.where(F.col("word") == END).first()
    # sums and sizes of the buckets, without the words that are classes of their own
    sums = np.zeros((2, CLASSES))
    for r in hashed.where("k > 0").groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        sums[:, r["k"]] = r["c"], r["v"]
    k = frequent.column("k").to_numpy()[top]
    np.add.at(sums[0], k, -count[top])
    np.add.at(sums[1], k, -1)
    tables = Tables(hashes[order], count[order].astype(np.int64), kind[order], ends["c"] if ends else 0, total, distinct, np.log10(sums[0, TOP:] + ALPHA * (sums[1, TOP:] + 1)))
    trigrams = learn.mapInArrow(_trigrams(broadcast(tables)), "code long, n long").repartition("code").mapInArrow(_merged, "code long, n long")
    share = max(1, -(-total // DRAWS))
    if share > 1:  # the draw gives a start only
        trigrams = materialize(trigrams, "lm-trigrams")
    drawn = (drawn_from(trigrams, share) if share > 1 else trigrams).toArrow().sort_by("code")
    drawn = drawn.column("code").to_numpy(), drawn.column("n").to_numpy()
    model = vectors(refine(trigrams, *start(*drawn))[0]) if share > 1 else train(*drawn)
    tables = replace(tables, model=model)
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"key long, {own}, n_tokens long, n_known long, log_c double, log_p double, rare array<struct<word:string,n:long>>"
    scored = materialize(docs.select(*keep, "text").mapInArrow(_score(broadcast(tables), list(keep)), schema), "lm-scored")
    rare = scored.where(F.size("rare") > 0).select("key", F.explode("rare").alias("x")).select("key", "x.word", "x.n").join(words, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("key").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10(c + F.lit(ALPHA))).alias("rare_log"))
    out = scored.drop("rare").join(rare, "key", "left")
    more = F.coalesce("rare_log", F.lit(0.0))
    unit = math.log10(total + ALPHA * (distinct + 1))
    return out.select(
        *keep,
        (crc_mod("doc_id", mod) == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_c") + more - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("log_p") + more).alias("score"),
    )
