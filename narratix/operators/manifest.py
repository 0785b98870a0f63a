"""Audio plans and production totals: arithmetic over tables of files, frames and stage results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def concat_plan(wavs: DataFrame, gap: float = 0.5, key: str = "chapter") -> DataFrame:
    """Frames before each file when files are joined in order with a silent gap between; files of one key need one sample rate."""
    own = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(key)
    same = F.min("sample_rate").over(every) == F.max("sample_rate").over(every)
    checked = F.when(same, F.col("sample_rate")).otherwise(F.raise_error(F.lit("files of one output differ in sample rate")))
    rows = wavs.withColumn("sample_rate", checked)
    silence = F.greatest(F.lit(0), F.bround(F.lit(gap) * F.col("sample_rate"))).cast("long")
    return rows.withColumn("offset", F.coalesce(F.sum(F.col("frames") + silence).over(own), F.lit(0)))


def totals(plan: DataFrame, key: str = "chapter") -> DataFrame:
    out = plan.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.max(F.col("offset") + F.col("frames")).alias("frames"), F.max("sample_rate").alias("sample_rate"))
    return out.withColumn("seconds", T.half_even(F.col("frames") / F.col("sample_rate"), 2))


def to_render(chunks: DataFrame, wavs: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Chunks without audio yet; all of them if forced."""
    return chunks if force else chunks.join(wavs.select(*keys).distinct(), keys, "left_anti")


def last_results(stages: DataFrame, key: str = "run") -> DataFrame:
    """The last result of each stage of a run."""
    return stages.groupBy(key, "name").agg(F.max_by(F.struct("status", "skipped", "elapsed_seconds", "message"), "ord").alias("r")).select(key, "name", "r.*")


def production(stages: DataFrame, files: DataFrame, key: str = "run") -> DataFrame:
    """Totals of stages and of files by suffix; files: run, path, size."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    made = files.groupBy(key).agg(*(F.count_if(suffix == s).alias(f"n_{s}") for s in ("wav", "mp3", "txt", "json")), F.sum("size").alias("bytes"), F.max(F.when(suffix == "mp3", F.col("path"))).alias("deliverable"))
    done = last_results(stages, key).groupBy(key).agg(F.count(F.lit(1)).alias("stages"), F.count_if("skipped").alias("skipped"), F.sum(F.coalesce("elapsed_seconds", F.lit(0.0))).alias("elapsed_seconds"), F.bool_and(F.col("status") == "complete").alias("complete"))
    return done.join(made, key, "left")


#: What a book's root may hold, by the name in the manifest.
OUTPUTS = {
    "book_identity": "book_identity.json", "book_json": "book.json", "source_manifest": "manifest.json", "layout_json": "layout.json", "chunk_manifest": "chunks/manifest.json",
    "front_matter_txt": "front_matter/front_matter.txt", "front_matter_wav": "front_matter/front_matter.wav", "metadata_report": "reports/mp3_metadata.json", "render_book_report": "reports/render_book.json", "pipeline_status": "reports/pipeline_status.json",
}


def outputs(files: DataFrame, key: str = "run") -> DataFrame:
    """Which outputs are there, counts of files, and the last book of each kind by name; files: key, path relative to the root."""
    path = F.col("path")
    last = lambda p: F.max(F.when(path.rlike(p), path))
    flags = [F.max((path == p)).alias(f"has_{n}") for n, p in OUTPUTS.items()]
    numbers = [F.count_if(path.rlike(p)).alias(n) for n, p in (("chapters_audio_files", r"^chapters_audio/chapter_[^/]*\.wav$"), ("chunk_text_files", r"^chunks/chapter_[^/]*/[^/]*\.txt$"), ("chunk_wav_files", r"^wav/chapter_[^/]*/[^/]*\.wav$"))]
    return files.groupBy(key).agg(*flags, *numbers, F.coalesce(last(r"^books/[^/]*_full\.wav$"), last(r"^books/[^/]*\.wav$")).alias("book_wav"), last(r"^books/[^/]*\.mp3$").alias("book_mp3"), last(r"^books/[^/]*\.m4b$").alias("book_m4b"))


def deliverables(files: DataFrame, reports: DataFrame, key: str = "run") -> DataFrame:
    """Every MP3 with the reports of its name; reports: key, path, status, compression_ratio."""
    mp3 = files.where(F.col("path").rlike(r"\.mp3$")).withColumn("stem", F.regexp_replace("path", r"\.mp3$", ""))
    of = lambda suffix: reports.where(F.col("path").endswith(suffix)).withColumn("stem", F.expr(f"left(path, length(path) - {len(suffix)})"))
    meta = of(".metadata.json").select(key, "stem", F.col("path").alias("metadata_report_file"))
    own = of(".json").where(~F.col("path").endswith(".metadata.json")).select(key, "stem", F.col("path").alias("report_file"), "status", "compression_ratio")
    return mp3.join(own, [key, "stem"], "left").join(meta, [key, "stem"], "left").drop("stem")


def audio_seconds(stages: DataFrame, reports: DataFrame, key: str = "run") -> DataFrame:
    """The seconds that the last stage with any names, else those of the book's report; stages: key, ord, audio_seconds."""
    last = stages.where("audio_seconds is not null").groupBy(key).agg(F.max_by("audio_seconds", "ord").alias("s"))
    return reports.select(key, F.col("audio_seconds").alias("r")).join(last, key, "full_outer").select(key, F.coalesce("s", "r").alias("audio_seconds"))


def published(pairs: DataFrame, force: bool = False) -> DataFrame:
    """Whether a converted file is current, and how much smaller it is; pairs: source and output mtime and size, null where there is no file."""
    current = F.lit(not force) & F.coalesce(F.col("output_mtime") >= F.col("source_mtime"), F.lit(False))
    ratio = T.half_even(F.nullif("source_size", F.lit(0)) / F.nullif("output_size", F.lit(0)).cast("double"), 2)
    return pairs.withColumn("status", F.when(current, "skipped_existing").otherwise("convert")).withColumn("compression_ratio", ratio)


def render_counts(chunks: DataFrame, wavs: DataFrame, keys: list[str], by: str, force: bool = False) -> DataFrame:
    """By chapter: chunks, those with audio, to render and reused."""
    rows = chunks.select(*keys).join(wavs.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    there = F.coalesce("_there", F.lit(False))
    todo = F.lit(True) if force else ~there
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(there).alias("existing"), F.count_if(todo).alias("to_render"), F.count_if(~todo).alias("skipped"))


def book_totals(reports: DataFrame, key: str = "run") -> DataFrame:
    """Chunks, rendered and reused ones and seconds of all chapters of a book; missing numbers count as none."""
    of = lambda c, n, zero=0: F.sum(F.coalesce(c, F.lit(zero))).alias(n)
    out = reports.groupBy(key).agg(F.count(F.lit(1)).alias("chapters"), of("chunks", "chunks_total"), of("rendered", "chunks_rendered"), of("skipped", "chunks_reused"), of("seconds", "seconds", 0.0))
    return out.withColumn("audio_seconds", T.half_even(F.col("seconds"), 2)).drop("seconds")
