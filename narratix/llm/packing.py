"""Packing of token sequences by cutting-stock column generation.

Every document is cut into full sequences and a remainder. The histogram of remainder lengths (at most ``size`` - 1 entries,
however large the corpus) feeds a linear program over patterns of lengths that fill a sequence exactly; a knapsack dynamic
program prices new patterns against its duals. Patterns are rounded down, fractions are tried again against what is left,
and the copies of a pattern are dealt to remainders by their rank within a length. Ranks are sums of counts over buckets
of documents and places within a bucket, so a length that a third of all documents share is spread over many tasks.
Remainders that no pattern took are laid end to end and cut where a sequence ends; the last stretch is cut at powers of two,
so no sequence needs padding. Where no lengths add up to a sequence there are no patterns, and all remainders are cut so.

The document's token ids come from the byte-level BPE vocabulary with its end id behind them. Null text counts as empty: one
piece with the end id alone. Repeated rows are packed one by one. An empty table gives an empty result. Other columns are
ignored. Rows are told apart by their number in the written table of tokens, so equal rows are neither joined with each other
nor kept in one task.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SIZE = 1024
#: Rows of a bucket, and the most cut pieces that are broadcast (about 60 bytes each); more are joined by a shuffle.
BUCKET, BROADCAST = 2048, 50_000
#: A run of white space from which on the library's expression may exceed its stack.
WIDE = 100_000
SPACE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
RUNS = re.compile(rf"(?<!{SPACE}){SPACE}{{{WIDE},}}+")


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The strings that the vocabulary's JSON lists as tokens of their own."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def encoder(path: str | None = None, added: dict[str, int] | None = None):
    """The vocabulary of byte_bpe_50k.json; its rank file gives the same ids several times as fast. added: tokens of their own."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {})


def token_ids(vocabulary, text: str) -> np.ndarray:
    """The ids of a text. A long run of white space is one piece, but for its last sign where text follows, and is merged without the expression."""
    if len(text) < WIDE:
        return vocabulary.encode_to_numpy(text, allowed_special="all")
    out, lo, added = [], 0, tuple(vocabulary.special_tokens_set)
    for m in RUNS.finditer(text):
        hi = m.end() - (m.end() < len(text) and not text.startswith(added, m.end()))
        out += [vocabulary.encode_to_numpy(text[lo : m.start()], allowed_special="all"), np.array(vocabulary._encode_single_piece(text[m.start() : hi]), np.uint32)]
        lo = hi
    return np.concatenate([*out, vocabulary.encode_to_numpy(text[lo:], allowed_special="all")])


def _tokens(size: int, path: str | None, added: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path, added)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, full, crc, rest = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = np.append(token_ids(vocabulary, text) if text else np.zeros(0, np.uint32), np.uint32(0)).astype("<u4")
                    k = len(ids) // size * size
                    n.append(len(ids))
                    full.append([zlib.crc32(ids[i : i + size]) for i in range(0, k, size)])
                    crc.append(zlib.crc32(ids[k:]))
                    rest.append(ids[k:].astype("<u2" if ids[k:].max(initial=0) < 1 << 16 else "<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(crc, pa.int64()), pa.array(rest, pa.binary())],
                    ["doc_id", "doc_tokens", "full_crc", "rest_crc", "rest"],
                )

    return run


def price(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: least value of a multiset of lengths with each exact sum up to size, and the last item it takes (-1: none)."""
    best = np.full(size + 1, np.inf)
    best[0] = 0
    item = np.full(size + 1, -1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        if k := upto[c]:
            way = best[c - lengths[:k]] + values[:k]
            i = int(way.argmin())
            best[c], item[c] = way[i], i if way[i] < np.inf else -1
    return best, item


def column_generation(lengths: np.ndarray, counts: np.ndarray, size: int = SIZE, gap: float = 0.01, rounds: int = 150, columns: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows, by length) that fill size exactly and how often each is used: max sum(x), patterns^T x <= counts.

    A revised simplex over the patterns found so far. It stops when the dual bound is within gap of the value reached, or after
    so many rounds of pricing; any point on the way is a valid packing, so this bounds its work and not what is packed.
    """
    m = len(lengths)
    inverse, value = np.eye(m), counts.astype(float)
    basis: list[np.ndarray | None] = [None] * m  # None: slack
    cost = np.zeros(m)
    tiny = 1e-9

    def enter(column: np.ndarray, gain: float, pattern) -> bool:
        u = inverse @ column
        up = u > 1e-7
        if not up.any():
            return False
        ratio = np.full(m, np.inf)
        ratio[up] = value[up] / u[up]
        r = int(ratio.argmin())
        step = max(0.0, ratio[r])
        value[:] -= step * u
        value[r] = step
        np.maximum(value, 0, out=value)
        row = inverse[r] / u[r]
        inverse[:] -= np.outer(u, row)
        inverse[r] = row
        basis[r], cost[r] = pattern, gain
        return True

    for i in range(int(np.searchsorted(lengths, size / 2, "right"))):  # start with pairs that fill a sequence
        j = int(np.searchsorted(lengths, size - lengths[i]))
        if j < m and lengths[i] + lengths[j] == size:
            pattern = np.zeros(m)
            pattern[i] += 1
            pattern[j] += 1
            enter(pattern, 1.0, pattern)
    # lengths / size price every exact pattern at 1, so they are feasible duals; prices are drawn towards the best such point
    center, bound = lengths / size, float(lengths @ counts) / size
    for _ in range(rounds):
        dual = cost @ inverse
        while (low := int(dual.argmin())) >= 0 and dual[low] < -1e-7:
            unit = np.zeros(m)
            unit[low] = 1
            if not enter(unit, 0.0, None):
                break
            dual = cost @ inverse
        dual = np.maximum(dual, 0)
        smooth, entered = 0.7, 0
        while True:
            point = smooth * center + (1 - smooth) * dual
            best, item = price(point, lengths, size)
            if best[size] > 0 and point @ counts / best[size] < bound:
                center, bound = point / best[size], float(point @ counts / best[size])
            if bound <= (1 + gap) * (cost @ value):
                break
            # the best pattern that holds each length, cheapest first
            first = point + best[size - lengths]
            entered, duals = 0, dual
            for i in np.argsort(first, kind="stable")[:columns]:
                if not np.isfinite(first[i]):
                    break
                pattern = np.zeros(m)
                pattern[i] += 1
                c = size - int(lengths[i])
                while c:
                    pattern[item[c]] += 1
                    c -= int(lengths[item[c]])
                if duals @ pattern < 1 - 1e-6 and enter(pattern, 1.0, pattern):
                    entered += 1
                    duals = cost @ inverse
            if entered or smooth == 0:
                break
            smooth = 0.0 if smooth < 0.2 else smooth / 2
        if bound <= (1 + gap) * (cost @ value) or not entered:
            break
    kept = [(p, v) for p, v in zip(basis, value, strict=True) if p is not None and v > tiny]
    if not kept:
        return np.zeros((0, m), np.int64), np.zeros(0)
    return np.array([p for p, _ in kept]).astype(np.int64), np.array([v for _, v in kept])


def rounded(patterns: np.ndarray, uses: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole uses: rounded down, then once more for each fraction (largest first) that the remaining counts allow."""
    whole = np.floor(uses + 1e-9).astype(np.int64)
    left = counts - patterns.T @ whole if len(patterns) else counts.copy()
    while len(patterns) and (left < 0).any():  # rounding noise of the program
        j = int(np.argmax(((patterns[:, left < 0] > 0).any(axis=1)) * whole))
        whole[j] -= 1
        left += patterns[j]
    for j in np.argsort(-(uses - whole), kind="stable"):
        if (patterns[j] <= left).all():
            whole[j] += 1
            left -= patterns[j]
    return whole


class Plan:
    """Where each remainder goes, by length and rank; size is bounded by the number of lengths."""

    def __init__(self, counts: dict[int, int], full: int, size: int = SIZE):
        self.size, self.next = size, full
        lengths = np.array(sorted(counts), dtype=np.int64)
        n = np.array([counts[x] for x in lengths.tolist()], dtype=np.int64)
        patterns, uses = column_generation(lengths, n, size) if len(lengths) else (np.zeros((0, 0), np.int64), np.zeros(0))
        whole = rounded(patterns, uses, n) if len(lengths) else np.zeros(0, np.int64)
        used = np.zeros(len(lengths), np.int64)
        rows = []
        for pattern, times in zip(patterns, whole, strict=True):
            offset = 0
            for i in np.flatnonzero(pattern) if times else ():
                rows.append((lengths[i], used[i], self.next, pattern[i], offset))
                used[i] += times * pattern[i]
                offset += pattern[i] * lengths[i]
            self.next += int(times)
        rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.rows, self.key = rows, rows[:, 0] << 44 | rows[:, 1]
        left = n - used
        self.taken = np.zeros(size + 1, np.int64)
        self.base = np.zeros(size + 1, np.int64)
        self.taken[lengths] = used
        self.base[lengths] = np.cumsum(left * lengths) - left * lengths
        total = int((left * lengths).sum())
        cuts = list(range(0, total // size * size + 1, size))[-1:]
        rest = total - cuts[0]
        while rest:
            cuts.append(cuts[-1] + (1 << (rest.bit_length() - 1)))
            rest -= 1 << (rest.bit_length() - 1)
        self.tail = np.array(cuts, dtype=np.int64)  # where the last, shorter sequences begin and end

    def place(self, length: np.ndarray, rank: np.ndarray):
        """For whole remainders: sequence and offset; sequence -1 and the place in the stream for those left over."""
        sequence, offset = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
        left = rank >= self.taken[length]
        offset[left] = self.base[length[left]] + (rank[left] - self.taken[length[left]]) * length[left]
        x, r = length[~left], rank[~left]
        if len(x):
            row = self.rows[np.searchsorted(self.key, x << 44 | r, "right") - 1]
            k = r - row[:, 1]
            sequence[~left], offset[~left] = row[:, 2] + k // row[:, 3], row[:, 4] + k % row[:, 3] * x
        return sequence, offset

    def cut(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start, length, sequence, offset) of a stretch of the stream."""
        out, start = [], 0
        while start < length:
            p = at + start
            if p < self.tail[0]:
                begin, end, sequence = p // self.size * self.size, (p // self.size + 1) * self.size, self.next + p // self.size
            else:
                k = int(np.searchsorted(self.tail, p, "right")) - 1
                begin, end, sequence = int(self.tail[k]), int(self.tail[k + 1]), self.next + int(self.tail[0]) // self.size + k
            n = min(length - start, end - p)
            out.append((start, n, sequence, p - begin))
            start += n
        return out


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placed(plan):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p: Plan = plan.value
        for whole in frames:
            for lo in range(0, len(whole), 2000):
                f = whole.iloc[lo : lo + 2000]
                length, n = f["rest_tokens"].to_numpy(np.int64), f["doc_tokens"].to_numpy(np.int64)
                sequence, offset = p.place(length, f["rank"].to_numpy(np.int64))
                rows = []
                for row, doc, crc, rest, r, total, s, o, first in zip(f["row"].tolist(), f["doc_id"], f["full_crc"], f["rest_crc"], length.tolist(), n.tolist(), sequence.tolist(), offset.tolist(), f["full_before"].tolist(), strict=True):
                    rows += [(row, doc, k * p.size, p.size, int(c), total, first + k, 0) for k, c in enumerate(crc)]
                    pieces = [(0, r, s, o)] if s >= 0 else p.cut(o, r)
                    rows += [(row, doc, total - r + a, x, int(rest) if x == r else None, total, q, b) for a, x, q, b in pieces]
                out = pd.DataFrame(rows, columns=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
                out["ids_crc32"] = out["ids_crc32"].astype("Int64")
                yield out

    return run


def _cut_crc(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        crc = []
        for rest, total, start, n in zip(f["rest"], f["doc_tokens"], f["start"], f["length"], strict=True):
            size = f["rest_tokens"].iat[len(crc)]
            ids = np.frombuffer(rest, "<u2" if len(rest) == 2 * size else "<u4")
            a = start - (total - size)
            crc.append(zlib.crc32(ids[a : a + n].astype("<u4").tobytes()))
        yield f.assign(ids_crc32=np.array(crc, dtype=np.int64))[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a rank file. added: strings that are tokens of their own, those of byte_bpe_50k.json if not given ({}: none).
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    added = added_tokens() if added is None else added
    tokens = docs.select("doc_id", "text").mapInArrow(_tokens(size, tokenizer, added), f"doc_id {kind}, doc_tokens long, full_crc array<long>, rest_crc long, rest binary")
    # rows are numbered as they are written, so equal rows are told apart and dealt apart
    tokens = materialize(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens").withColumn("rest_tokens", F.col("doc_tokens") % size)
    buckets = max(1, -(-tokens.count() // BUCKET))
    light = tokens.drop("rest").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    full = F.sum(F.size("full_crc").cast("long"))
    counts = materialize(light.groupBy("bucket", "rest_tokens").agg(F.count(F.lit(1)).alias("n"), full.alias("f")), "lengths")
    # at most `size` rows
    totals = counts.groupBy("rest_tokens").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).orderBy("rest_tokens").collect()
    plan = spark.sparkContext.broadcast(Plan({r["rest_tokens"]: r["n"] for r in totals if r["rest_tokens"]}, sum(r["f"] for r in totals), size))
    class_base = np.cumsum([0, *(r["f"] for r in totals)]).tolist()
    before = Window.partitionBy("rest_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.create_map(*(x for r, b in zip(totals, class_base, strict=False) for x in (F.lit(r["rest_tokens"]), F.lit(b)))) if totals else F.create_map(F.lit(0).cast("long"), F.lit(0))
    starts = counts.select(
        F.col("bucket").alias("_b"), F.col("rest_tokens").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), (F.coalesce(F.sum("f").over(before), F.lit(0)) + base[F.col("rest_tokens")]).alias("f0")
    )
    own = Window.partitionBy("bucket", "rest_tokens").orderBy("row")
    ranked = light.join(starts, (F.col("bucket") == F.col("_b")) & (F.col("rest_tokens") == F.col("_r")))
    ranked = ranked.withColumn("rank", F.col("n0") + F.row_number().over(own) - 1)
    ranked = ranked.withColumn("full_before", F.col("f0") + F.coalesce(F.sum(F.size("full_crc").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.select("row", "doc_id", "doc_tokens", "rest_tokens", "full_crc", "rest_crc", "rank", "full_before")
    placed = materialize(ranked.mapInPandas(_placed(plan), f"row long, doc_id {kind}, {PIECES}"), "pieces")
    cut = placed.where("ids_crc32 is null").drop("ids_crc32", "doc_id", "doc_tokens")
    if cut.count() <= BROADCAST:
        cut = F.broadcast(cut)
    rests = tokens.where("rest_tokens > 0").select("row", "doc_id", "doc_tokens", "rest", "rest_tokens")
    filled = rests.join(cut, "row").mapInPandas(_cut_crc, f"doc_id {kind}, {PIECES}")
    return placed.where("ids_crc32 is not null").drop("row").unionByName(filled)
