"""Chapters: ranges of pages from a table of contents, pages and words of each chapter, book manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows of a table of contents that are broadcast at most (about 100 bytes each); more are joined by book with a shuffle.
BROADCAST = 100_000


def ranges(toc: DataFrame, totals: DataFrame, book: str = "book") -> DataFrame:
    """book, chapter, title, start_page, end_page: a chapter ends before the next one in table order begins.

    Entries of level 1 with a page other than 0 count; a book without any is one chapter over all its pages.
    """
    own = Window.partitionBy(book).orderBy("idx")
    rows = toc.where((F.col("level") == 1) & (F.col("page") != 0)).join(totals, book)
    rows = rows.select(book, F.row_number().over(own).alias("chapter"), "title", F.col("page").alias("start_page"), F.coalesce(F.lead("page").over(own) - 1, F.col("total_pages")).alias("end_page"))
    whole = totals.join(rows, book, "left_anti").select(book, F.lit(1).alias("chapter"), F.lit("Full Book").alias("title"), F.lit(1).alias("start_page"), F.col("total_pages").alias("end_page"))
    return rows.unionByName(whole)


def pages_in(pages: DataFrame, chapters: DataFrame, book: str = "book", size: int | None = None) -> DataFrame:
    """Pages with their chapters: equal book, page between start and end. size: the chapters' count, if known to be small."""
    c = chapters.withColumnRenamed(book, "_book")
    if size is not None and size <= BROADCAST:
        c = F.broadcast(c)
    return pages.join(c, (F.col(book) == F.col("_book")) & F.col("page").between(F.col("start_page"), F.col("end_page"))).drop("_book")


def words(pages: DataFrame, chapters: DataFrame, book: str = "book") -> DataFrame:
    """Each chapter's words; chapters without pages have 0. pages: book, page, words."""
    n = pages_in(pages, chapters, book).groupBy(book, "chapter").agg(F.sum("words").alias("word_count"))
    return chapters.join(n, [book, "chapter"], "left").withColumn("word_count", F.coalesce("word_count", F.lit(0).cast("long")))


def text(pages: DataFrame, chapters: DataFrame, book: str = "book") -> DataFrame:
    """Each chapter's text, pages in order with blank lines between."""
    rows = pages_in(pages, chapters, book).where("text <> ''").groupBy(book, "chapter").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("all"))
    return rows.select(book, "chapter", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("text"), F.transform("all", lambda x: x["page"]).alias("pages"))


def book_manifest(pages: DataFrame, book: str = "book") -> DataFrame:
    out = pages.groupBy(book).agg(F.count(F.lit(1)).alias("total_pages"), F.sum("words").alias("total_words"))
    return out.withColumn("estimated_minutes", T.minutes(F.col("total_words")))
