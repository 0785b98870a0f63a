"""Benchmark decontamination with suffix arrays over the training text.

The training documents are cut into shards of whole documents. Each shard gets a suffix array over its words; every suffix
of every benchmark item is binary-searched in it, which yields the longest verbatim match and all its places. Suffixes of
a shard that begin in a stretch of words too short to hold any window of words known to the benchmark can match nothing and
are left out of the array.

Benchmark items are dealt by a hash into blocks of about ``block_bytes`` of text. Mostly there is one, which is broadcast. Of several,
one at a time is: the documents are numbered and written once, pass each block, and the rows that it hits are written; those of
all blocks are joined at the end. Windows with the same words are one, and the items that hold them are listed once for each set
of items, so what many items share is neither searched nor reported for each of them.

Null and empty texts have no words: such documents come out clean, such items match nothing. Items with a null id mark
words as hit but are not listed. Repeated documents are judged one by one; repeated item ids count once. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, materialize, ranges, span_hashes, text_chunks, word_spans

WINDOW = 13


class Suffixes:
    """The windows and suffixes of a block of benchmark items as word numbers; equal windows have one number."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        texts = pa.array([t or "" for _, t in items], type=pa.large_string())
        words, item = [], []
        for first, buf, offsets in text_chunks(texts, 1 << 24):
            buf = LOWER[buf]
            s, e, at = word_spans(buf, offsets, ALNUM)
            words.append(span_hashes(buf, s, e))
            item.append(np.repeat(np.arange(first, first + len(at) - 1), np.diff(at)))
        hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)
        item = np.concatenate(item) if item else np.zeros(0, np.int64)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        self.words = (number + 1).astype(np.int64)
        self.bits = np.zeros(1 << 18, dtype=bool)
        self.bits[(self.vocabulary >> np.uint64(46)).astype(np.int64)] = True
        size = np.bincount(item, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        left = np.cumsum(size)[item] - np.arange(len(item))
        need = np.minimum(size, window)[item]
        self.start = np.flatnonzero(left >= need)  # of every window
        self.left = left[self.start]  # words from there to the item's end
        need = need[self.start]  # words of the window
        self.least = int(need.min()) if len(need) else 0
        self.need = need
        # number of the window that begins at each start, and the words of each numbered window
        key = need.astype(np.uint64)
        for k in range(window):
            more = need > k
            key[more] = (key[more] ^ hashes[self.start[more] + k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        _, first, self.number = np.unique(key, return_index=True, return_inverse=True)
        self.size = need[first]
        # windows that the same items hold are one class; its items are listed once, those with an id alone
        ids = sorted({i for i, _ in items if i is not None})
        place = {x: k for k, x in enumerate(ids)}
        code = np.array([-1 if i is None else place[i] for i, _ in items], np.int64)[item[self.start]] if len(need) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([self.number, code], 1)[code >= 0], axis=0)
        classes: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []
        self.kind = np.full(len(first), -1, np.int64)  # of each window
        bounds = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        for w, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if lo < hi:
                own = pairs[lo:hi, 1]
                self.kind[w] = k = classes.setdefault(own.tobytes(), len(self.lists))
                if k == len(self.lists):
                    self.lists.append(own.copy())
        self.ids = ids

    def items(self, kinds: tuple[int, ...]) -> list[str]:
        """The items of windows of these classes, by id."""
        return [self.ids[k] for k in np.unique(np.concatenate([self.lists[x] for x in kinds]))] if kinds else []

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """A number for each word of the benchmark, 0 for all others."""
        out = np.zeros(len(hashes), dtype=np.int64)
        if len(self.vocabulary):
            may = np.flatnonzero(self.bits[(hashes >> np.uint64(46)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[may]), len(self.vocabulary) - 1)
            out[may] = np.where(self.vocabulary[at] == hashes[may], at + 1, 0)
        return out


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the word 0 ends a stretch, so suffixes are told apart no further than that."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    stop = words == 0
    order, k = np.argsort(rank, kind="stable"), 1
    ends = np.flatnonzero(stop)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) if len(ends) else np.full(n, n)
    longest = int(room.max(initial=0)) + 1
    while k < longest:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:-k] = rank[k:] + 1
        nxt[room < k] = 0
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        rank, k = new, 2 * k
        if int(rank[order[-1]]) == n - 1:
            break
    return order


def narrow(sa: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray):
    """Within each interval [lo, hi) of the suffix array, the part whose suffixes have the wanted word at depth: binary search."""

    def bound(upper: bool):
        a, b = lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                return a
            mid = (a[live] + b[live]) >> 1
            at = np.minimum(sa[mid] + depth, len(words) - 1)
            less = words[at] <= wanted[live] if upper else words[at] < wanted[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]

    return bound(False), bound(True)


def search(index: Suffixes, sa: np.ndarray, words: np.ndarray):
    """Every numbered window that occurs, with its interval of sa, and for each place of sa the longest match with a window at its begin.

    All suffixes go down the array word by word. Suffixes with the same words so far share an interval, and those of one depth are
    disjoint, so a place leaves the search once, at the longest match that begins there.
    """
    q = np.arange(len(index.start))
    lo, hi, last = np.zeros(len(q), np.int64), np.full(len(q), len(sa), dtype=np.int64), np.zeros(len(q), np.int64)
    longest = np.zeros(len(sa), np.int64)
    found, depth = [], 0
    while len(q):
        parents, which = np.unique(lo, return_inverse=True)  # disjoint, so begins tell them apart
        ends, value = np.zeros(len(parents), np.int64), np.zeros(len(parents), np.int64)
        ends[which], value[which] = hi, last
        value[which[index.need[q] <= depth]] = depth  # a window ends here or did before
        last = value[which]
        if (whole := index.need[q] == depth).any():
            number, one = np.unique(index.number[q[whole]], return_index=True)
            found.append((number, lo[whole][one], hi[whole][one]))
        more = index.left[q] > depth
        a, b = narrow(sa, words, lo[more], hi[more], depth, index.words[index.start[q[more]] + depth])
        on = a < b
        # what the next intervals leave of these
        first, one = np.unique(a[on], return_index=True)
        begin, end = np.sort(np.concatenate([parents, b[on][one]])), np.sort(np.concatenate([first, ends]))
        of = value[np.searchsorted(parents, begin, "right") - 1]
        some = (end > begin) & (of > 0)
        longest[ranges(begin[some], end[some])] = np.repeat(of[some], (end - begin)[some])
        q, lo, hi, last = q[more][on], a[on], b[on], last[more][on]
        depth += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3, longest
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)), longest


def shard_matches(index: Suffixes, hashes: np.ndarray, at: np.ndarray):
    """For words of whole documents (at: each document's first word): window and place of all that occur; places and lengths of longest matches."""
    none = (np.zeros(0, np.int64),) * 4
    if not index.least or not len(hashes):
        return none
    number = index.numbers(hashes)
    known = number > 0
    edge = known.copy()
    edge[1:] &= ~known[:-1]
    cut = at[:-1][at[:-1] < len(hashes)]
    edge[cut] = known[cut]
    start = np.flatnonzero(edge)
    run = np.cumsum(edge) - 1
    size = np.bincount(run[known], minlength=len(start))
    keep = size >= index.least
    start, size = start[keep], size[keep]
    if not len(start):
        return none
    total = int((size + 1).sum())
    words, place = np.zeros(total, np.int64), np.zeros(total, np.int64)
    put = ranges(np.cumsum(size + 1) - size - 1, np.cumsum(size + 1) - 1)
    place[put] = ranges(start, start + size)
    words[put] = number[place[put]]
    sa = suffix_array(words)
    sa = sa[words[sa] > 0]
    (window, lo, hi), longest = search(index, sa, words)
    some = longest > 0
    return np.repeat(window, hi - lo), place[sa[ranges(lo, hi)]], place[sa[some]], longest[some]


def _judge(index: Suffixes, batch: pa.RecordBatch, shard_bytes: int):
    """By shard of whole documents: the first row, first words, hit words (marks), the rows' classes of windows, longest matches and their places."""
    for first, buf, offsets in text_chunks(batch.column("text"), shard_bytes):
        buf = LOWER[buf]
        s, e, at = word_spans(buf, offsets, ALNUM)
        n = len(at) - 1
        window, place, begin, longest = shard_matches(index, span_hashes(buf, s, e), at)
        marks = np.zeros(len(s) + 1, np.int64)
        np.add.at(marks, place, 1)
        np.add.at(marks, place + index.size[window] if len(window) else place, -1)
        hit = np.cumsum(marks)[:-1] > 0
        best, best_at = np.zeros(n, np.int64), np.full(n, -1)
        if len(begin):
            doc = np.searchsorted(at, begin, "right") - 1
            order = np.lexsort((begin, -longest, doc))
            one = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
            best[doc[one]], best_at[doc[one]] = longest[one], begin[one] - at[doc[one]]
        kinds: list[tuple[int, ...]] = [()] * n
        if len(window):
            pairs = np.stack([np.searchsorted(at, place, "right") - 1, index.kind[window]], 1)
            pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
            bounds = np.searchsorted(pairs[:, 0], np.arange(n + 1))
            for d in np.flatnonzero(np.diff(bounds)):
                kinds[d] = tuple(pairs[bounds[d] : bounds[d + 1], 1].tolist())
        yield first, at, hit, kinds, best, best_at


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _whole(shared, shard_bytes: int, keep: list[str]):
    """The result, where one block holds the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Suffixes = shared.value
        known: dict[tuple[int, ...], tuple[int, str]] = {(): (0, _digest([]))}
        for batch in batches:
            n_words, n_hit, best, best_at = (np.zeros(batch.num_rows, np.int64) for _ in range(4))
            n_items, sha = np.zeros(batch.num_rows, np.int64), []
            for first, at, hit, kinds, b, b_at in _judge(index, batch, shard_bytes):
                own = slice(first, first + len(at) - 1)
                n_words[own], best[own], best_at[own] = np.diff(at), b, b_at
                n_hit[own] = np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
                for d, k in enumerate(kinds):
                    if k not in known:
                        if len(known) > 10_000:
                            known = {(): known[()]}
                        items = index.items(k)
                        known[k] = (len(items), _digest(items))
                    n_items[first + d] = known[k][0]
                    sha.append(known[k][1])
            bad = (n_hit > 0) & (20 * n_hit >= n_words)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(sha, pa.string()), pa.array(bad), pa.array(best), pa.array(best_at, mask=best_at < 0)],
                [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at"],
            )

    return run


FOUND = "row long, block int, n_words long, hits array<long>, items array<string>, longest_match long, longest_at long"


def _found(shared, block: int, shard_bytes: int):
    """Of the rows that a block's windows occur in: stretches of hit words (begin, end), items, longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Suffixes = shared.value
        for batch in batches:
            row = batch.column("row").to_pylist()
            for first, at, hit, kinds, best, best_at in _judge(index, batch, shard_bytes):
                edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                on, off = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                stretches: dict[int, list[int]] = {}
                for d, a, b in zip((np.searchsorted(at, on, "right") - 1).tolist(), on.tolist(), off.tolist(), strict=True):
                    while a < b:  # hit words may run over the end of a document into the next one
                        end = min(b, int(at[d + 1]))
                        stretches.setdefault(d, []).extend((a - int(at[d]), end - int(at[d])))
                        a, d = end, d + 1
                for d in sorted(stretches):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row[first + d]], pa.int64()), pa.array([block], pa.int32()), pa.array([int(at[d + 1] - at[d])], pa.int64()), pa.array([stretches[d]], pa.list_(pa.int64())), pa.array([index.items(kinds[d])], pa.list_(pa.string())), pa.array([int(best[d])], pa.int64()), pa.array([int(best_at[d])], pa.int64())],
                        [x.split()[0] for x in FOUND.split(", ")],
                    )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for first, buf, offsets in text_chunks(batch.column("text"), 1 << 22):
            _, _, at = word_spans(LOWER[buf], offsets, ALNUM)
            n[first : first + len(at) - 1] = np.diff(at)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n)], ["row", "n_words"])


def _union(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks' results of each row as one."""
    for f in frames:
        out = []
        for row, n_words, found in zip(f["row"], f["n_words"], f["found"], strict=True):
            spans = sorted(p for x in found for p in zip(x["hits"][::2], x["hits"][1::2], strict=True))
            n_hit = end = 0
            for a, b in spans:
                n_hit, end = n_hit + max(0, b - max(a, end)), max(end, b)
            items = sorted({i for x in found for i in x["items"]})
            best = min(found, key=lambda x: (-x["longest_match"], x["longest_at"]))
            out.append((row, n_hit, len(items), _digest(items), n_hit > 0 and 20 * n_hit >= n_words, best["longest_match"], best["longest_at"]))
        yield pd.DataFrame(out, columns=["row", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at"])


def _block(items: DataFrame, block: int, blocks: int) -> list[tuple[str | None, str]]:
    own = items.where(F.pmod(F.xxhash64("i", "text"), F.lit(blocks)) == block)
    return sorted(((r["i"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 8_000_000, shard_bytes: int = 4_000_000, keep: list[str] | None = None) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, and longest_match with its first word longest_at.

    keep: the columns of docs that stand before these, doc_id if not given.
    """
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    if blocks == 1:
        own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        shared = spark.sparkContext.broadcast(Suffixes(_block(items, 0, 1), window))
        return docs.select(*keep, "text").mapInArrow(_whole(shared, shard_bytes, keep), f"{own}, {RESULT}")
    items = materialize(items, "items")
    rows = materialize(docs.select(*keep, "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = []
    for k in range(blocks):  # one block at a time is on the driver and in the workers, and only the rows it hits are written
        shared = spark.sparkContext.broadcast(Suffixes(_block(items, k, blocks), window))
        found.append(materialize(rows.select("row", "text").mapInArrow(_found(shared, k, shard_bytes), FOUND), "hits").inputFiles())
        shared.destroy()
    files = [x for part in found for x in part]
    hits = spark.read.schema(FOUND).parquet(*files) if files else spark.createDataFrame([], FOUND)
    hits = hits.groupBy("row").agg(F.first("n_words").alias("n_words"), F.collect_list(F.struct("hits", "items", "longest_match", "longest_at")).alias("found"))
    hits = hits.mapInPandas(_union, "row long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long")
    out = rows.join(rows.select("row", "text").mapInArrow(_counted, "row long, n_words long"), "row").join(hits, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*keep, "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"), zero("longest_match"), "longest_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents (all their columns) that are not contaminated, judged row by row; one pass without a shuffle where the benchmark is one block."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    return contamination(rows.withColumnRenamed("row", "_row"), benchmark, keep=["_row"], **options).where(~F.col("contaminated")).select("_row.*")
