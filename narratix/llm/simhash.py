"""SimHash near-duplicate detection over 3-word shingles.

Fingerprints of 64 bits link at 2 or fewer differing bits. Two linked fingerprints differ in at most two of their eight
bytes, so six positional bytes agree at least (``SHARED``). A list of all fingerprints with one byte in common would hold a 256th of
them, so the inverted index lists fingerprints under four positional bytes at once (two of four two-byte groups: six shared bytes
imply two whole groups), and within each list under every other positional byte. Shared bytes are tallied for each pair that meets
there, pairs that reach SHARED are retained and verified by counting bits. Lists are over distinct fingerprints.

A list with more than ``hot`` members (one near-copied text) is split by each two more positional bytes into parts that share six.
Such a part differs in 16 bits, so it has 65,536 members at most and no pair needs a tally; its links are a spanning forest found by
looking up each member's 136 neighbours at one or two bits, which connects what all its verified pairs would.

Components come from alternating large-star and small-star rounds over tables in the shared folder.

Null and empty texts have fingerprint zero and link like any other. A null doc_id takes part with no say in component_id; a
component of null ids only has a null one. Repeated rows come out repeatedly. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, joined_apart, materialize, remove, text_chunks, word_spans

SEED, NEAR = 42, 2
#: Fingerprints that differ in NEAR bits share at least this many of their eight positional bytes.
SHARED = 8 - NEAR


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 13):
        part = np.unpackbits(hashes[lo : lo + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.uint16) if len(part) < 1 << 16 else part.sum(axis=0)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.uint64)
            for first, buf, offsets in text_chunks(batch.column("text"), 1 << 20):
                buf = LOWER[buf]
                s, e, at = word_spans(buf, offsets, SPACED)
                if not len(s):
                    continue
                # all words, one space between them: shingles are slices of this
                size = e - s
                start = np.cumsum(size + 1) - size - 1
                flat = np.full(int(start[-1] + size[-1]), 32, dtype=np.uint8)
                keep = np.zeros(len(buf) + 1, dtype=np.int8)
                keep[s] += 1
                np.add.at(keep, e, -1)
                put = np.ones(len(flat), dtype=bool)
                put[(start + size)[:-1]] = False
                flat[put] = buf[np.cumsum(keep[:-1]).astype(bool)]
                flat, end = flat.tobytes(), (start + size).tolist()
                start = start.tolist()
                for d in range(len(at) - 1):
                    a, b = int(at[d]), int(at[d + 1])
                    if a == b:
                        continue
                    w = min(words, b - a)
                    h = [digest(flat[i:j], SEED) for i, j in zip(start[a : b - w + 1], end[a + w - 1 : b], strict=True)]
                    out[first + d] = fingerprint_of(np.array(h, dtype=np.uint64))
            rest = [batch.column(k) for k in range(batch.num_columns) if batch.schema.field(k).name != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out.view(np.int64))], [*names, "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long."""
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(_fingerprints(words), f"{own}, fp long")


def _masked(positions) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


#: The lists: two of the four two-byte groups, so four positional bytes; of eight bytes that agree but for two, two groups agree whole.
GROUPS = [tuple(p for g in two for p in (2 * g, 2 * g + 1)) for two in combinations(range(4), 2)]


def _listed(fps: DataFrame) -> DataFrame:
    """fp under each four positional bytes: (kind, key, fp)."""
    parts = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_masked(four))).alias("key")) for k, four in enumerate(GROUPS)]
    return fps.select("fp", F.explode(F.array(*parts)).alias("x")).select("x.kind", "x.key", "fp")


def _others(parts):
    """For a list's kind, an array over the positions (or sets of them) outside its four bytes: (place, those bytes)."""
    every = [F.array(*(F.struct(F.lit(sum(1 << p for p in x)).alias("place"), F.col("fp").bitwiseAND(F.lit(_masked(x))).alias("byte")) for x in parts(set(range(8)) - set(four)))) for four in GROUPS]
    return F.explode(F.get(F.array(*every), F.col("kind"))).alias("x")


def tallied(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the lists that share SHARED positional bytes: four are the list's, the others are tallied from lists of single bytes."""
    byte = members.select("kind", "key", "fp", _others(lambda rest: [(p,) for p in sorted(rest)])).select("kind", "key", "x.place", "x.byte", "fp")
    a, b = byte.withColumnRenamed("fp", "a"), byte.withColumnRenamed("fp", "b")
    shared = a.join(b, ["kind", "key", "place", "byte"]).where("a < b").groupBy("kind", "key", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return shared.where(F.col("n") + 4 >= SHARED).select("a", "b")


NEIGHBOURS = [1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)]


def _forest(mask: int):
    """Links of a list whose members share six positional bytes, at most 65,536 of them: as good as all its verified pairs, but no more than members."""
    places = [p for p in range(8) if not mask >> p & 1]

    def run(batch: pa.Table) -> pa.Table:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        low = sum(((fp >> np.uint64(8 * p)) & np.uint64(255)) << np.uint64(8 * k) for k, p in enumerate(places)).astype(np.int64)
        root = np.full(1 << 16, -1, np.int64)
        root[low] = np.arange(len(fp))
        out_a, out_b = [], []
        label = np.arange(len(fp))
        while True:  # each takes the least label around it, and the link that it came by
            least, by = label.copy(), np.full(len(fp), -1)
            for x in NEIGHBOURS:
                at = root[low ^ x]
                better = (at >= 0) & (label[at] < least)
                least[better], by[better] = label[at[better]], at[better]
            if not (by >= 0).any():
                break
            moved = np.flatnonzero(by >= 0)
            # of each label the member that reaches least carries the whole label over
            order = np.lexsort((moved, least[moved], label[moved]))
            first = moved[order][np.concatenate([[True], label[moved][order][1:] != label[moved][order][:-1]])]
            out_a.append(fp[first])
            out_b.append(fp[by[first]])
            to = np.arange(len(fp))
            to[label[first]] = least[first]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
        a = np.concatenate(out_a).view(np.int64) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b).view(np.int64) if out_b else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _split(batch: pa.Table) -> pa.Table:
    return _forest(batch.column("place")[0].as_py())(batch)


def links(fps: DataFrame, hot: int = 64) -> DataFrame:
    """Edges (a, b) that connect exactly what fingerprints at 2 or fewer differing bits connect; fps: distinct fp.

    Pairs of lists up to `hot` members are tallied and verified. A longer list is split by each two more positional bytes: what
    shares six bytes meets in one of the parts.
    """
    lists = _listed(fps)
    grouped = lists.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(lists.join(grouped, ["kind", "key"]), "simhash-lists")
    pairs = tallied(members.where(F.col("n") <= hot)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR)
    long = members.where(F.col("n") > hot)
    four = F.element_at(F.array(*(F.lit(sum(1 << p for p in x)) for x in GROUPS)), F.col("kind") + 1)
    parts = long.select("kind", "key", "fp", four.alias("four"), _others(lambda rest: list(combinations(sorted(rest), 2))))
    # the six bytes name the part, whichever list it came from
    parts = parts.select((F.col("four").bitwiseOR(F.col("x.place"))).alias("place"), F.col("key").bitwiseOR(F.col("x.byte")).alias("six"), "fp").distinct()
    several = parts.groupBy("place", "six").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    near = parts.join(several, ["place", "six"]).groupBy("place", "six").applyInArrow(_split, "a long, b long")
    return pairs.union(near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes with an edge; large-star/small-star rounds.

    Distances along a component halve with each round. Every round is written to the shared folder, and the one before it
    deleted. A node with very many links is dealt over several tasks.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # large star: every neighbour above a node goes to the smallest node around
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = joined_apart(both, least.drop("n"), "a", least.select("a", "n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node itself, go to the smallest of them; these are few for every node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        after = materialize(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        remove(edges)
        edges = after
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = state


def _rooted(fps: DataFrame, hot: int) -> DataFrame:
    """fps (distinct fp, other columns) with root: the fingerprint that names its component."""
    roots = components(links(fps.select("fp"), hot))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int = 3, hot: int = 64, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, fp and component_id (smallest doc_id reachable, itself included)."""
    marked = materialize(fingerprints(docs, words, keep), "fingerprints")
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    named = materialize(_rooted(prints, hot), "roots")
    # least ids are taken before the shuffle, so a component of a third of all fingerprints is no task's own
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = joined_apart(named.select("fp", "root"), least.drop("n"), "root", least.select("root", "n")).select("fp", "component_id")
    return joined_apart(marked, named, "fp", prints.select("fp", "n")).select(*keep, "fp", "component_id")


def deduplicate(docs: DataFrame, words: int = 3, hot: int = 64) -> DataFrame:
    """The documents (all columns) that stay: of each component one row, that of its smallest doc_id.

    Of several rows with that doc_id the one with the least hash of the text, then of the row, stays; null ids come last. The row
    to keep is found for each fingerprint first, in each task and then by a shuffle, and rows repeated whole become one in each
    task first, so a text or a row copied to a third of all documents stays spread.
    """
    keys = ["_null", "_id", "_hash", "_whole"]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("text"),
        F.col("doc_id").isNull().alias("_null"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
        F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))).alias("_whole"),
        F.col("doc_id").alias("_order"),
    )
    marked = materialize(fingerprints(rows, words, (*keys, "_order")), "fingerprints")
    order = lambda x="": F.struct(F.col(f"{x}_null"), F.col(f"{x}_order"), F.col(f"{x}_hash"), F.col(f"{x}_whole"))
    best = materialize(marked.groupBy("fp").agg(F.min_by(F.struct(*keys, "_order"), order()).alias("x")), "prints")
    kept = _rooted(best, hot).groupBy("root").agg(F.min_by("x", order("x.")).alias("x")).select("x._null", "x._id", "x._hash", "x._whole")
    return rows.groupBy(*keys).agg(F.first("row").alias("row")).join(kept, keys).select("row.*")
