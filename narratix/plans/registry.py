"""All queries of the library by name, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, markers
from ..functions import patterns as P
from ..functions import text as T
from ..operators import chapters, checks, chunks, layout, narration
from ..streaming import status
from . import oracle

#: Lines that hold what the documents lack: markers, classes and labels to tell apart.
LITERALS = ["2", "1982", "1988 2008", "1.1 1988 2008", "( 1968 )", "1 9 8 2", "", "He had 3 apples.", "In 1968, he left.", "Fig. 1.1 Photograph of X", "Table of Contents", "Copyright 2020, ISBN 1", "Preface and Acknowledgements", "42", "https://a.b", "doi 10.1234/x", "© 2020 X", "Chapter 3: A Title", "Foreword", "12.5, 7", "By Jane Doe"]

#: The most bytes of a table that are shuffled to make up for a single row group.
DEALT = 64 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of at most DEALT bytes is dealt to all cores, since it may be one row group, which a reader cannot split.

    The bound is on the table, not on the cores: larger tables are read as they lie on a cluster of any size.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= DEALT else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def with_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, and the literal lines under negative ids."""
    extra = spark.createDataFrame([(-1 - k, 1, x) for k, x in enumerate(LITERALS)], "doc_id long, line_no int, line string")
    return narration.lines(documents(spark, sf_dir)).unionByName(extra)


def first_line(c: Column) -> Column:
    return F.get(F.split(c, "\n"), F.lit(0))


def str_clean_text(spark, d):
    return documents(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text_clean"))


def str_norm_key(spark, d):
    return documents(spark, d).select("doc_id", T.norm_key(F.col("text")).alias("norm_key"))


def str_sentence_split(spark, d):
    return documents(spark, d).select("doc_id", T.let(T.sentences(F.col("text")), lambda x: F.struct(F.size(x).alias("n_sentences"), F.array_join(x, " | ").alias("sentences"))).alias("s")).select("doc_id", "s.*")


def str_word_counts(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", T.word_count(t).alias("n_words"), T.token_count(t).alias("n_tokens"), T.count(t, P.MEANINGFUL).alias("n_meaningful"), T.count(t, P.LETTER).alias("n_letters"))


def str_preview(spark, d):
    return documents(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview"))


def flt_markers(spark, d):
    x = F.col("line")
    flags = {"layout": markers.layout(x), "speech": markers.speech(x), "cleaner": markers.cleaner(x), "narration": markers.narration(x), "strict": markers.narration(x, strict=True)}
    return with_literals(spark, d).select("doc_id", "line_no", *(c.alias(n) for n, c in flags.items()))


def flt_heading_unit(spark, d):
    return with_literals(spark, d).select("doc_id", "line_no", F.when(T.heading_unit(F.col("line")), "heading").otherwise("body").alias("kind"))


def prj_classify_text(spark, d):
    return with_literals(spark, d).groupBy(classify.text_class(F.col("line")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def prj_front_matter(spark, d):
    return with_literals(spark, d).select("doc_id", "line_no", classify.front_matter(F.col("line")).alias("labels"))


def prj_identity_score(spark, d):
    rows = with_literals(spark, d)
    scores = classify.identity_scores(T.compact(F.col("line")), F.lit(1))
    return rows.select("doc_id", "line_no", scores.alias("s")).select("doc_id", "line_no", "s.*")


def nar_render(spark, d):
    return narration.render(documents(spark, d))


def chk_chunks(spark, d):
    return chunks.chunks(documents(spark, d), narration.blocks(F.col("text")))


def chk_manifest(spark, d):
    return chunks.manifest(chk_chunks(spark, d))


def _toc(spark, d):
    rows = read(spark, d, "conversations")
    toc = rows.where("role = 'user'").select(F.col("conv_id").alias("book"), F.col("turn").alias("idx"), F.lit(1).alias("level"), (F.col("turn") + 1).alias("page"), F.lit("t").alias("title"))
    totals = rows.groupBy(F.col("conv_id").alias("book")).agg((F.max("turn") + 1).alias("total_pages"))
    return chapters.ranges(toc, totals)


def win_chapter_ranges(spark, d):
    return _toc(spark, d).select("book", "chapter", "start_page", "end_page")


def jn_page_chapter(spark, d):
    pages = read(spark, d, "conversations").select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("page"), T.token_count(F.col("text")).alias("words"))
    return chapters.words(pages, _toc(spark, d)).select("book", "chapter", "word_count")


def agg_skip_hist(spark, d):
    x = F.col("line")
    rows = with_literals(spark, d).select(F.when(F.col("doc_id") < 0, "literal").otherwise("document").alias("origin"), narration.skip_reason(x, classify.text_class(x), strict=True).alias("reason"))
    return narration.skip_histogram(rows, "origin")


def agg_type_counts(spark, d):
    rows = with_literals(spark, d).select(classify.text_class(F.col("line")).alias("type"))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(classify.narrated(F.col("type"))).alias("narrated"))


def win_dedupe_best(spark, d):
    """Of all lines with the same key the longest, ties to the first."""
    rows = with_literals(spark, d).select("doc_id", "line_no", F.length("line").alias("n_chars"), T.norm_key(F.col("line")).alias("key"))
    best = rows.groupBy("key").agg(F.max_by(F.struct("doc_id", "line_no", "n_chars"), F.struct("n_chars", -F.col("doc_id"), -F.col("line_no"))).alias("x"))
    return best.select("key", "x.*")


def jn_fallback(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.concat(F.lit("quality "), F.col("quality").cast("string")), "source").alias("value"))


def jn_resume_anti(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def jn_heading_suffix(spark, d):
    rows = narration.lines(documents(spark, d)).where(T.heading_unit(F.col("line"))).select("doc_id", F.col("line_no").alias("idx"), F.col("line").alias("text"))
    ends = rows.select("doc_id", F.col("idx") + 1000000, F.regexp_replace("text", r"\A[^ ]+ ", "")).toDF("doc_id", "idx", "text")
    return layout.heading_fragments(rows.unionByName(ends), ["doc_id"])


def chk_regression(spark, d):
    """Each benchmark passage must occur in the document of its number: found by a join on the passage's first words, short ones in all texts."""
    words = lambda c: F.split(T.compact(c), " ")
    cases = read(spark, d, "benchmark").select("item_id", T.compact(F.col("text")).alias("phrase"))
    # a passage of 8 words or more is in a text only where its second to seventh are, so they pick the documents to look into
    long = F.size(words(F.col("phrase"))) >= 8
    probes = cases.where(long).withColumn("probe", F.array_join(F.slice(words(F.col("phrase")), 2, 6), " "))
    docs = documents(spark, d).select("doc_id", T.compact(F.col("text")).alias("all"))
    # grams carry the document's id alone, and only those of some passage leave their task; texts are fetched for these
    found = F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, F.lit(6)), " "))
    grams = docs.select("doc_id", words(F.col("all")).alias("w")).select("doc_id", F.explode(F.when(F.size("w") >= 7, F.array_distinct(found))).alias("probe"))
    pairs = grams.join(probes.select("item_id", "phrase", "probe"), "probe").select("doc_id", "item_id", "phrase").distinct()
    hits = docs.join(pairs, "doc_id").where(F.col("all").contains(F.col("phrase"))).select("item_id")
    short = docs.crossJoin(F.broadcast(cases.where(~long))).where(F.col("all").contains(F.col("phrase"))).select("item_id")
    hits = hits.unionByName(short).groupBy("item_id").agg(F.lit(True).alias("found"))
    rows = cases.join(hits, "item_id", "left")
    return rows.select("item_id", checks.status(F.coalesce("found", F.lit(False)), F.when(F.col("item_id") % 5 == 0, "known_fail")).alias("status"))


def sum_clean(spark, d):
    extra = spark.createDataFrame([(-1 - k, x) for k, x in enumerate(oracle.MARKDOWN)], "doc_id long, text string")
    return documents(spark, d).unionByName(extra).select("doc_id", T.clean_for_speech(F.col("text")).alias("text"))


def sum_validate(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "text")
    extra = spark.createDataFrame([(-1 - k, 0, x) for k, x in enumerate(oracle.SUMMARIES)], "conv_id long, turn long, text string")
    return rows.unionByName(extra).select("conv_id", "turn", F.size(checks.validation_errors(F.col("text"))).alias("n_errors"))


def win_progress(spark, d):
    return status.progress(read(spark, d, "events").select("event_id", "user_id", "ts")).select("event_id", "current", "total", "percent")


def status_latest(spark, d):
    return status.latest(read(spark, d, "events")).select("user_id", "status", F.date_format("last_update", "yyyy-MM-dd HH:mm:ss").alias("last_update"))


def srt_topk(spark, d):
    rows = narration.lines(documents(spark, d)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "line").limit(20)


def jn_similar(spark, d):
    """Headings of each document, and the literal lines as those of one more."""
    own = F.col("doc_id") < 0
    rows = with_literals(spark, d).where(own | T.heading_unit(F.col("line")))
    rows = rows.select(F.when(own, -1).otherwise(F.col("doc_id")).alias("doc_id"), F.when(own, -F.col("doc_id")).otherwise(F.col("line_no").cast("long")).alias("idx"), F.col("line").alias("text"))
    return layout.similar_pairs(rows, ["doc_id"], 0.6).select("doc_id", "a_idx", "b_idx", "similarity")


def win_line_cluster(spark, d):
    """Words on pages made of embeddings: the first components give places."""
    e = F.col("embedding")
    words = read(spark, d, "embeddings").select(
        (F.col("vec_id") / 500).cast("int").alias("doc_id"), F.col("label").alias("page"), F.col("vec_id").alias("ord"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("text"),
        (e[0] * 500 + 300).cast("double").alias("x0"), (e[1] * 700 + 400).cast("double").alias("y0"), (e[0] * 500 + 330).cast("double").alias("x1"), (e[1] * 700 + 412).cast("double").alias("y1"),
    )
    return layout.lines(layout.cluster_lines(words)).select("doc_id", "page", "line", "text")


def win_paragraphs(spark, d):
    """Lines of each document on pages of sixty lines with a step of 10 points, each eleventh indented, then paragraphs."""
    rows, n = narration.lines(documents(spark, d)), F.col("line_no") - 1
    y = (n % 60 + 1).cast("double") * 10
    rows = rows.select("doc_id", (n / 60).cast("int").alias("page"), F.col("line_no").alias("line"), F.col("line").alias("text"), F.when(n % 11 == 10, 108.0).otherwise(72.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 9).alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return layout.merged(layout.paragraphs(rows)).select("doc_id", "page", "paragraph", "text")


QUERIES = {
    f.__name__: f
    for f in (
        str_clean_text, str_norm_key, str_sentence_split, str_word_counts, str_preview, flt_markers, flt_heading_unit, prj_classify_text, prj_front_matter, prj_identity_score, nar_render, chk_chunks, chk_manifest,
        win_chapter_ranges, jn_page_chapter, agg_skip_hist, agg_type_counts, win_dedupe_best, jn_fallback, jn_resume_anti, jn_heading_suffix, chk_regression, sum_clean, sum_validate, win_progress, status_latest, srt_topk, jn_similar, win_line_cluster, win_paragraphs,
    )
}

ORACLE_SQL = oracle.sql(LITERALS)
