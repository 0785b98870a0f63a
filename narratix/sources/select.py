"""Which files and pages are read: listings (path, mtime, size) as tables, names as rules."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Folders and files under a book's root.
MARKERS = ("chapters", "narration", "narration_raw", "chunks", "wav", "chapters_audio", "reports", "books")
ROOT_FILES = ("layout.json", "book.json", "manifest.json")
READY = (r"^book\.json$", r"^manifest\.json$", r"^chapters/chapter_[^/]*\.json$", r"^narration/narration_[^/]*\.txt$")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, mtime and size of the files under a folder; their contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", name("path").alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_pdf(files: DataFrame) -> DataFrame:
    """The first document of a folder by path."""
    return files.where(F.col("path").endswith(".pdf")).orderBy("path").limit(1)


def only_pdf(files: DataFrame, explicit: str | None = None, configured: str | None = None) -> str:
    """The document asked for, else the configured one if it is there, else the only one of the folder; anything else is an error that lists the choice."""
    if explicit:
        if files.where(F.col("path") == explicit).isEmpty():
            raise FileNotFoundError(explicit)
        return explicit
    if configured and not files.where(F.col("path") == configured).isEmpty():
        return configured
    found = [r["path"] for r in files.where(F.col("path").endswith(".pdf")).orderBy("path").select("path").limit(50).collect()]
    if len(found) != 1:
        raise FileNotFoundError("no document found" if not found else "choose one of: " + ", ".join(found))
    return found[0]


def source_pdf(explicit: Column, recorded: Column, beside: Column, other: Column) -> Column:
    """The first of these paths that exists; each is null where it does not."""
    return F.coalesce(explicit, F.when(recorded.startswith("/"), recorded), beside, other)


def output_root(path: Column) -> Column:
    """The book's root that a path lies in: before the first folder with a known name, the folder of a known file, or a path right under output."""
    parts = F.split(path, "/")
    at = F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(p.isin(*MARKERS) & (i > 0), i)), lambda i: i.isNotNull()))
    up = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    size = F.size(parts)
    return F.when(at.isNotNull(), up(at)).when(F.element_at(parts, -1).isin(*ROOT_FILES), F.when(size == 1, ".").otherwise(up(size - 1))).when((size >= 3) & (F.try_element_at(parts, F.lit(-2)) == "output"), path)


def ready(files: DataFrame, root: str = "root", path: str = "path") -> DataFrame:
    """root and ready: whether a book has all its first outputs; path is relative to the root."""
    return files.groupBy(root).agg(F.array_contains(F.array(*(F.max(F.col(path).rlike(p)) for p in READY)), False).alias("_no")).select(root, (~F.col("_no")).alias("ready"))


def book_root(expected: DataFrame, roots: DataFrame) -> DataFrame:
    """expected and root: of the ready roots the newest whose name is the same, else the newest that contains it, else the expected name.

    expected: name and stem (of the document); roots: root, mtime, ready.
    """
    e = expected.select("name", T.norm_key(F.col("name")).alias("_a"), T.norm_key(F.col("stem")).alias("_b")).distinct()
    r = roots.where("ready").select("root", "mtime", T.norm_key(F.col("root")).alias("_c"))
    same = (F.col("_c") == F.col("_a")) | (F.col("_c") == F.col("_b"))
    part = F.col("_c").contains(F.col("_a")) | F.col("_c").contains(F.col("_b"))
    exact = e.select("name", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_c")).join(r, "_c").select("name", "root", "mtime", F.lit(2).alias("class"))
    # names within names need no equality; the list of roots is a folder's and is broadcast
    some = e.join(F.broadcast(r), part & ~same).select("name", "root", "mtime", F.lit(1).alias("class"))
    best = exact.unionByName(some).groupBy("name").agg(F.max_by("root", F.struct("class", "mtime", "root")).alias("root"))
    return expected.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("root", "name").alias("root"))


def numbered(files: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """The files whose name the pattern matches, with its number, in order of it (ord from 1 within keys)."""
    rows = files.where(F.col("name").rlike(pattern)).withColumn("number", F.regexp_extract("name", pattern, 1).cast("long"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("number", "name")))


#: Patterns of numbered files and folders.
CHUNK, CHAPTER_DIR, CHAPTER_WAV, CHAPTER_JSON = r"^([0-9]+)\.txt$", r"^chapter_([0-9]+)$", r"^chapter_([0-9]+)\.wav$", r"^chapter_([0-9]{3})_.*\.json$"


def chapter_files(chapters: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """Chapters with the first of their files by name, null where there is none; chapters: keys, chapter."""
    own = files.where(F.col("name").rlike(CHAPTER_JSON)).withColumn("chapter", F.regexp_extract("name", CHAPTER_JSON, 1).cast("long"))
    return chapters.join(own.groupBy(*keys, "chapter").agg(F.min("name").alias("file")), [*keys, "chapter"], "left")


def wanted_pages(page: Column, switch: Column, spec: Column) -> Column:
    """Whether recognition is on for a page: not switched off, and in the list of pages and ranges (all without one; bad parts count for nothing)."""
    off = F.lower(T.strip(F.coalesce(switch, F.lit("1")))).isin("0", "false", "no", "off")
    parts = F.transform(F.split(spec, ","), T.strip)
    low = lambda p: F.regexp_extract(p, r"^\s*([+-]?[0-9]+)\s*(?:-\s*([+-]?[0-9]+)\s*)?$", 1).try_cast("long")
    high = lambda p: F.coalesce(F.regexp_extract(p, r"^\s*([+-]?[0-9]+)\s*-\s*([+-]?[0-9]+)\s*$", 2).try_cast("long"), low(p))
    return ~off & ((T.strip(F.coalesce(spec, F.lit(""))) == "") | F.exists(parts, lambda p: F.coalesce(page.between(low(p), high(p)), F.lit(False))))


def wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, frames, sample_rate, channels of the WAV files under a folder, from their headers."""
    @F.pandas_udf("frames long, sample_rate int, channels int")
    def header(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            with wave.open(io.BytesIO(d)) as w:
                rows.append((w.getnframes(), w.getframerate(), w.getnchannels()))
        return pd.DataFrame(rows, columns=["frames", "sample_rate", "channels"])

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", header("content").alias("h")).select("path", "h.*")


def samples(content: Column) -> Column:
    """A WAV file's 16-bit samples between -1 and 1: an array for one channel, else an array of each frame's channels."""
    @F.pandas_udf("array<array<float>>")
    def read(data: pd.Series) -> pd.Series:
        out = []
        for d in data:
            with wave.open(io.BytesIO(d)) as w:
                x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
                out.append(x.reshape(-1, w.getnchannels()).tolist())
        return pd.Series(out)

    return read(content)
