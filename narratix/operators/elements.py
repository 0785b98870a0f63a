"""Elements of a page from three sources (blocks, words outside blocks, recognised words) to flags and reports.

Tables carry doc_id and page; everything but the comparison of repeated headers stays within a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as T
from ..session import written
from . import layout, recovery
from .layout import PAGE

#: Sources, their first confidence, and types that are spoken whatever else holds.
CONFIDENCE = {"block": 0.82, "orphan_words": 0.70, "ocr_recovery": 0.62, "ocr_recovery_paragraph": 0.68}
SPOKEN = ("footnote", "table_candidate", "recovered_ocr_paragraph")
BOX = ["x0", "y0", "x1", "y1"]


def confidence(source: Column, kind: Column | None = None) -> Column:
    """By source; recovered paragraphs count for more than other recovered text."""
    out = F.when(source == "block", CONFIDENCE["block"]).when(source == "orphan_words", CONFIDENCE["orphan_words"])
    if kind is not None:
        out = out.when((source == "ocr_recovery") & (kind == "recovered_ocr_paragraph"), CONFIDENCE["ocr_recovery_paragraph"])
    return out.when(source == "ocr_recovery", CONFIDENCE["ocr_recovery"]).otherwise(0.75)


def source_info(source: Column) -> Column:
    return F.struct((source == "block").alias("block"), (source == "orphan_words").alias("orphan_words"), (source == "ocr_recovery").alias("ocr"))


def geometry(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Centre, height and width of a box as shares of its page; null on a page without extent."""
    w, h = F.nullif(width, F.lit(0.0)), F.nullif(height, F.lit(0.0))
    return F.struct(((x0 + x1) / 2 / w).alias("center_x_ratio"), (y0 / h).alias("y_ratio"), ((x1 - x0) / w).alias("width_ratio"))


def sources(*elements: DataFrame) -> DataFrame:
    """All elements with their source's confidence and flags."""
    out = elements[0]
    for e in elements[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    source = F.col("source")
    return out.withColumn("confidence", confidence(source, F.col("type"))).withColumn("source_info", source_info(source)).withColumn("narrate", F.lit(True))


def finish(elements: DataFrame) -> DataFrame:
    """Types and narrate flags in their last state: markers, repeated headers and footers, endings of headings, types that are always spoken."""
    rows = layout.promote_repeats(layout.mark_markers(elements))
    band = F.col("type").isin("header", "footer")
    rows = written(rows.withColumn("confidence", F.when(band, 0.9).when(F.col("type").isin("header_candidate", "footer_candidate"), 0.55).otherwise(F.col("confidence"))), "promoted-elements")
    heads = rows.where("type = 'heading'").select(*PAGE, "idx", F.lower(T.strip(F.col("text"))).alias("text"))
    cut = layout.heading_fragments(heads).select(*PAGE, "idx", F.lit(True).alias("_cut"))
    rows = rows.join(cut, [*PAGE, "idx"], "left")
    kind = F.when(F.col("_cut"), "duplicate_heading_fragment").otherwise(F.col("type"))
    rows = rows.withColumn("confidence", F.when(F.col("_cut"), 0.9).otherwise(F.col("confidence"))).withColumn("type", kind).drop("_cut")
    return rows.withColumn("narrate", final_narrate(F.col("type")))


def final_narrate(kind: Column) -> Column:
    return kind.isin(*SPOKEN) | classify.narrated(kind)


def block_elements(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements of the page's own text blocks; blocks: page keys, ord, box, text."""
    rows = blocks.withColumn("text", T.normalize_text(F.col("text"))).where("text <> ''").join(pages.select(*PAGE, "width", "height"), PAGE)
    kind = classify.element_class(F.col("text"), *(F.col(c) for c in (*BOX, "width", "height")))
    return rows.select(*PAGE, "ord", "text", *BOX, kind.alias("type"), F.lit("block").alias("source"))


def orphan_elements(words: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements of words that stand in no block: lines by their tops, paragraphs by gaps, table rows counted."""
    left = layout.cluster_lines(layout.orphans(words, blocks).select(*PAGE, "ord", "text", *BOX))
    rows = layout.lines(left).join(pages.select(*PAGE, "width", "height"), PAGE).join(recovery.table_rows(left), [*PAGE, "line"], "left")
    rows = layout.paragraphs(rows)
    table = rows.groupBy(*PAGE, "paragraph").agg(F.count_if("is_row").alias("table_rows"), F.first("width").alias("width"), F.first("height").alias("height"))
    out = layout.merged(rows).join(table, [*PAGE, "paragraph"]).where("text <> ''")
    kind = classify.element_class(F.col("text"), *(F.col(c) for c in (*BOX, "width", "height")), F.col("table_rows"))
    return out.select(*PAGE, (F.lit(1_000_000) + F.col("paragraph")).alias("ord"), "text", *BOX, kind.alias("type"), F.lit("orphan_words").alias("source"))


def page_layout(pages: DataFrame, blocks: DataFrame, words: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Every element of every page, in reading order with ids, types, confidence, source and narrate flag.

    pages: doc_id, page, width, height. blocks: page keys, ord, box, text. words: page keys, ord, box, text. seen: recognised words
    with a line besides, of the pages where recognition is on (``sources.select.wanted_pages``).
    """
    found = written(block_elements(blocks, pages).unionByName(orphan_elements(words, blocks, pages)), "elements")
    if seen is not None:
        known = found.select(*PAGE, F.col("ord").alias("idx"), "text", *BOX)
        more = recovery.recover(seen, known, pages).select(*PAGE, (F.lit(2_000_000) + F.col("paragraph")).alias("ord"), "text", *BOX, "type", F.lit("ocr_recovery").alias("source"))
        found = found.unionByName(more)
    return finish(written(layout.reading_order(sources(found)), "ordered-elements"))


def report(elements: DataFrame) -> DataFrame:
    """section, key, n and narrated: elements by type and by source (none: unknown), as the report lists them, in order of section and key."""
    kinds = elements.groupBy(F.lit("type").alias("section"), F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if("narrate").alias("narrated"))
    own = F.coalesce("source", F.lit("unknown"))
    origin = elements.groupBy(F.lit("source").alias("section"), own.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if("narrate").alias("narrated"))
    return kinds.unionByName(origin).orderBy("section", "key")


def samples(elements: DataFrame, n: int = 180) -> DataFrame:
    """The first lines of the report's sample."""
    line = F.concat_ws(" | ", F.format_string("p%03d", "page"), F.rpad("type", 18, " "), F.concat(F.lit("narrate="), F.initcap(F.col("narrate").cast("string"))), F.coalesce("source", F.lit("")), F.left("text", F.lit(220)))
    return elements.orderBy("doc_id", "page", "idx").limit(n).select("doc_id", "page", "idx", line.alias("sample"))


def warnings(logs: DataFrame, key: str = "page") -> DataFrame:
    """key and message: the lines of a decoder's log, trimmed, without empty ones, in order (pos)."""
    rows = logs.select(key, F.posexplode(F.split("log", "\n")).alias("pos", "message"))
    return rows.withColumn("message", T.strip(F.col("message"))).where("message <> ''")


def frequent_warnings(rows: DataFrame, key: str = "page", n: int = 20) -> DataFrame:
    """The most frequent messages; of equally frequent ones the one met first."""
    out = rows.groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "pos")).alias("first"))
    return out.orderBy(F.desc("n"), "first").limit(n).select("message", "n")


def fragments(rows: DataFrame, key: str = "doc_id", n: int = 8) -> DataFrame:
    """Texts of at most three words by key: how many, and the first few; rows: key, idx, text."""
    short = rows.where(T.token_count(F.col("text")).between(1, 3))
    # a partial aggregate keeps the first few alone
    own = Window.partitionBy(key).orderBy("idx")
    few = short.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("all"))
    return short.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(few, key).select(key, "n", F.transform("all", lambda x: x["text"]).alias("first"))


def with_text(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Layout pages with the plain text of the same place in their document; a page without one has an empty text."""
    return pages.join(texts.select(*PAGE, F.col("text").alias("raw_text")), PAGE, "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


def debug(rows: DataFrame) -> DataFrame:
    """Boxes rounded to two places, text trimmed, and its first 300 characters."""
    text = T.strip(F.coalesce("text", F.lit("")))
    return rows.select(*PAGE, "idx", *(T.half_even(F.col(c), 2).alias(c) for c in BOX), text.alias("text"), F.left(text, F.lit(300)).alias("preview"))
