"""Helpers shared by the training-data operators: shared storage, Arrow text chunks, vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and one machine runs all (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder where executors run elsewhere ({master})")
        top = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='narratix-')}"
        shared_dir.own = top
    return top.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/narratix/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def joined_apart(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "inner", hot: int = 20_000, parts: int = 64) -> DataFrame:
    """left joined with right, which has one row for each key, where some keys may hold much of left.

    counts: (key, n) of left. The keys with the most rows, 1,000 at most and of at least `hot` rows, are dealt over `parts` tasks,
    right's row of such a key being repeated there; any other key has under a thousandth of the rows or under `hot`.
    """
    keys = [r[0] for r in counts.where(F.col("n") >= hot).orderBy(F.desc("n"), key).limit(1000).select(key).collect()]
    if not keys:
        return left.join(right, key, how)
    kind = right.schema[key].dataType.simpleString()
    many = F.col(key).isin(keys)
    left = left.withColumn("_part", F.when(many, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(0))
    right = right.withColumn(key, F.col(key).cast(kind)).withColumn("_part", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_part"], how).drop("_part")


def crc_mod(column: str, mod: int):
    """crc32 of the decimal text of an id, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def sample_share(rows: int, sample: int) -> int:
    """Of how many hash classes one is drawn, so that a tenth less than sample rows are expected: a limit then cuts none, by chance or order."""
    return max(1, -(-10 * rows // (9 * sample))) if rows > sample else 1


def text_chunks(column, max_bytes: int = 2_000_000):
    """Slices of an Arrow string column as (first row, bytes, row offsets into them); whole texts only, null is empty.

    A slice holds as many rows as fit max_bytes, and at least one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def byte_class(excluded) -> np.ndarray:
    """True for the bytes of words; excluded: the bytes (or ranges) that separate words."""
    out = np.ones(256, dtype=bool)
    for x in excluded:
        out[x] = False
    return out


#: Words of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z are lower-cased).
SPACED = byte_class([32, slice(9, 14)])
ALNUM = byte_class([slice(0, 0x30), slice(0x3A, 0x61), slice(0x7B, 0x80)])


def word_spans(buf: np.ndarray, offsets: np.ndarray, words: np.ndarray):
    """Starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = words[buf]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    cut = offsets[:-1][offsets[:-1] < len(buf)]
    first[cut] = m[cut]
    cut = offsets[1:] - 1
    cut = cut[cut >= 0]
    last[cut] = m[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_M = 0x9E3779B97F4A7C15 | 1
_MINV = pow(_M, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """64-bit polynomial hashes of buf[start:end], all at once by prefix sums; work is done in pieces of about step bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + step, "right")))
            a, b = int(starts[lo]), int(ends[hi - 1])
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_BYTES[buf[a:b]] * _powers(_M, b - a), out=sums[1:])
            s, e = starts[lo:hi] - a, ends[lo:hi] - a
            h = (sums[e] - sums[s]) * _powers(_MINV, b - a)[s]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            out[lo:hi] = h
            lo = hi
    return out


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The integers of all [lo, hi), one after the other."""
    n = hi - lo
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    at = np.cumsum(n) - n
    keep = n > 0
    first, at = lo[keep], at[keep]
    out[at] = first
    out[at[1:]] -= (hi[keep] - 1)[:-1]
    return np.cumsum(out)
