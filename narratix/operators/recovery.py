"""Recovery of text that the page's blocks lack from recognised words, line by line; tables by the gaps in their lines.

Words and elements carry doc_id and page; one page's rows are few, so lists and comparisons stay within a page.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import classify, speech
from ..functions import patterns as P
from ..functions import text as T
from ..session import written
from .layout import PAGE, inside, merged

BOX = ["x0", "y0", "x1", "y1"]
#: Classes of recognised lines that are never recovered.
FURNITURE = ("empty", "page_number", "url", "doi", "footer", "footer_candidate", "header", "header_candidate", "extraction_artifact")


def table_rows(words: DataFrame, by: str = "line") -> DataFrame:
    """doc_id, page, by and is_row: four words, two gaps over 18 points and two words with digits at least."""
    rows = words.groupBy(*PAGE, by).agg(F.array_sort(F.collect_list(F.struct("x0", "ord", "x1", "text"))).alias("w"))
    return rows.select(*PAGE, by, _row(F.col("w")).alias("is_row"))


def _row(w: Column) -> Column:
    gaps = F.zip_with(F.slice(w, 2, F.size(w)), F.slice(w, F.lit(1), F.size(w) - 1), lambda b, a: b["x0"] - a["x1"])
    wide, digits = F.size(F.filter(gaps, lambda g: g > 18)), F.size(F.filter(w, lambda x: x["text"].rlike("[0-9]")))
    return (F.size(w) >= 4) & (wide >= 2) & (digits >= 2)


def covered(words: DataFrame, elements: DataFrame, pad: float = 1.0) -> DataFrame:
    """doc_id, page, line, coverage and covered_text: each word belongs to the first element that holds its centre."""
    e = elements.select(*(F.col(c).alias(f"_{c}") for c in PAGE), F.col("idx"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hits = words.join(e, (F.col("doc_id") == F.col("_doc_id")) & (F.col("page") == F.col("_page")) & inside(x, y, "box", pad), "left")
    first = hits.groupBy(*PAGE, "line", "ord").agg(F.min("idx").alias("idx"))
    own = first.groupBy(*PAGE, "line").agg(F.avg(F.col("idx").isNotNull().cast("double")).alias("coverage"))
    texts = first.dropna(subset=["idx"]).select(*PAGE, "line", "idx").distinct().join(elements.select(*PAGE, "idx", "text"), [*PAGE, "idx"])
    texts = texts.where("text <> ''").groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("all"))
    out = own.join(texts, [*PAGE, "line"], "left")
    return out.select(*PAGE, "line", "coverage", F.coalesce(F.array_join(F.transform("all", lambda x: x["text"]), " "), F.lit("")).alias("covered_text"))


def common_most(a: str, masks: dict[str, int], b: str) -> int:
    """The length of the longest common subsequence, which no matching exceeds: one step of long integers for each sign of b."""
    every = (1 << len(a)) - 1
    v = every
    for x in b:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def over(text: str, others: list[str], threshold: float) -> bool:
    """Whether the matching ratio of the text with any of the others is over the threshold; bounds that no ratio exceeds come first."""
    t, masks, n = text.lower(), {}, Counter()
    for o in map(str.lower, others):
        total = len(t) + len(o)
        if not total or 2.0 * min(len(t), len(o)) / total <= threshold:
            if not total and threshold < 1:  # two empty texts are alike
                return True
            continue
        n = n or Counter(t)
        if 2.0 * sum((n & Counter(o)).values()) / total <= threshold:
            continue
        if not masks:
            for k, x in enumerate(t):
                masks.setdefault(x, []).append(k)
            masks = {x: _bits(at, len(t)) for x, at in masks.items()}
        if 2.0 * common_most(t, masks, o) / total > threshold and SequenceMatcher(None, t, o).ratio() > threshold:
            return True
    return False


def _bits(at: list[int], size: int) -> int:
    row = np.zeros(size, np.uint8)
    row[at] = 1
    return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")


def similar(threshold: float):
    """Of a text and an array of others: whether any is more alike than the threshold; none is in a null array."""

    @F.pandas_udf(BooleanType())
    def run(text: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([o is not None and over(t, o, threshold) for t, o in zip(text, others, strict=True)], dtype=bool)

    return run


def once(c: Column) -> Column:
    """A column that is computed once: filters and projections that use it are not merged with it."""
    return F.explode(F.array(c))


def ocr_groups(lines: DataFrame) -> DataFrame:
    """Lines with their paragraph: a new one begins at a wide gap, a far jump, a caption or a footnote. lines: page keys, line, box, width."""
    page = Window.partitionBy(*PAGE)
    own = page.orderBy("y0", "x0", "line")
    out = lines.withColumn("_med", F.median(F.col("y1") - F.col("y0")).over(page))
    gap, left = F.col("y0") - F.lag("y1").over(own), F.abs(F.col("x0") - F.lag("x0").over(own))
    head = T.strip(F.col("text")).rlike(P.CAPTION) | T.strip(F.col("text")).rlike(rf"(?i)\Afootnote\.{P.SPACE}*[0-9]+(?:[^\p{{L}}\p{{N}}_]|\z)")
    cut = (gap > F.col("_med") * 2.8) | ((gap > F.col("_med") * 0.55) & (left > F.col("width") * 0.22)) | head
    out = out.withColumn("_cut", F.when(F.lag("line").over(own).isNull(), 0).otherwise(F.coalesce(cut.cast("int"), F.lit(0))))
    return out.withColumn("paragraph", F.sum("_cut").over(own)).drop("_med", "_cut")


def word_lines(words: DataFrame) -> DataFrame:
    """page keys, line and w, its words by x0: array of x0, ord, text, x1, y0, y1."""
    return words.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("x0", "ord", "text", "x1", "y0", "y1"))).alias("w"))


def _hits(boxes: str, ord_: str, x: str, y: str, pad: float = 1.0) -> Column:
    """coverage and covered_text of a line from the arrays of its words' numbers and centres, as ``covered`` has them; boxes: its page's elements."""
    near = F.filter(boxes, lambda b: (F.array_max(x) >= b["x0"] - pad) & (F.array_min(x) <= b["x1"] + pad) & (F.array_max(y) >= b["y0"] - pad) & (F.array_min(y) <= b["y1"] + pad))
    held = lambda cx, cy, b: cx.between(b["x0"] - pad, b["x1"] + pad) & cy.between(b["y0"] - pad, b["y1"] + pad)
    first = lambda all_: F.zip_with(x, y, lambda cx, cy: F.array_min(F.transform(F.filter(all_, lambda b: held(cx, cy, b)), lambda b: b["idx"])))
    # rows of one word number count once, with the first element of any
    whole = lambda found: F.when(F.size(F.array_distinct(ord_)) == F.size(ord_), found).otherwise(F.transform(F.array_distinct(ord_), lambda o: F.array_min(F.transform(F.filter(F.arrays_zip(F.col(ord_).alias("o"), found.alias("i")), lambda z: z["o"] == o), lambda z: z["i"]))))

    def of(found: Column) -> Column:
        own = F.filter(found, lambda i: i.isNotNull())
        texts = F.filter(boxes, lambda b: F.array_contains(own, b["idx"]) & (b["text"] != ""))
        return F.struct((F.size(own) / F.size(found)).alias("coverage"), F.array_join(F.transform(texts, lambda b: b["text"]), " ").alias("covered_text"))

    none = F.struct(F.lit(0.0).alias("coverage"), F.lit("").alias("covered_text"))
    return T.let(near, lambda all_: F.when(F.size(all_) == 0, none).otherwise(T.let(first(all_), lambda found: T.let(whole(found), of))))


def recover(words: DataFrame, elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements that only recognition saw: doc_id, page, paragraph, type, text, box, avg_coverage.

    words: page keys, line, ord, text, box; elements: page keys, idx, text, box; pages: page keys, width, height.
    """
    return recover_lines(word_lines(words), elements, pages)


def recover_lines(rows: DataFrame, elements: DataFrame, pages: DataFrame) -> DataFrame:
    """``recover`` of lines that are arrays of words already, as ``word_lines`` makes them."""
    each = lambda f: F.transform("w", f)
    box = [F.array_min(each(lambda w: w["x0"])).alias("x0"), F.array_min(each(lambda w: w["y0"])).alias("y0"), F.array_max(each(lambda w: w["x1"])).alias("x1"), F.array_max(each(lambda w: w["y1"])).alias("y1")]
    middle = [each(lambda w: w["ord"]).alias("_ord"), each(lambda w: (w["x0"] + w["x1"]) / 2).alias("_x"), each(lambda w: (w["y0"] + w["y1"]) / 2).alias("_y")]
    rows = rows.where(F.col("line").isNotNull()).select(*PAGE, "line", once(F.col("w")).alias("w"))
    lines = rows.select(*PAGE, "line", once(speech.ocr_normalize(F.array_join(each(lambda w: w["text"]), " "))).alias("text"), *box, *middle, _row(F.col("w")).alias("is_row"))
    lines = lines.where(speech.viable_ocr_line(F.col("text")))
    place = [F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")]
    lines = lines.join(pages.select(*PAGE, "width", "height"), PAGE).where(~classify.element_class(F.col("text"), *place).isin(*FURNITURE))
    own = elements.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("idx", "text", "x0", "y0", "x1", "y1"))).alias("e"))
    # the texts of a page's elements, and none of a page without any
    listed = F.transform(F.filter("e", lambda b: b["text"] != ""), lambda b: b["text"])
    known = lambda df: df.join(own, PAGE, "left").withColumn("e", F.coalesce("e", F.array().cast(own.schema["e"].dataType))).withColumn("known", once(listed))
    lines = known(lines).where(~F.lower(F.array_join("known", " ")).contains(F.lower("text")))
    lines = lines.withColumn("_hit", once(_hits("e", "_ord", "_x", "_y"))).drop("_ord", "_x", "_y", "e").select("*", "_hit.*")
    letters, meaning = (lambda c: T.count(F.col(c), P.LETTER)), (lambda c: T.count(F.col(c), P.MEANINGFUL))
    whole = (F.col("coverage") >= 0.8) & (meaning("covered_text") >= F.greatest(F.lit(3), (meaning("text") / 3).cast("int")))
    few = letters("text") <= letters("covered_text") + 16
    lines = lines.where(~(whole & few)).withColumn("_covered", F.when(whole, F.array("covered_text")))
    lines = lines.where(~similar(0.72)("text", "_covered")).where(~similar(0.90)("text", "known"))
    # both the paragraphs and their facts are made of these lines
    lines = written(lines.select(*PAGE, "line", "text", *BOX, "width", "height", "is_row", "coverage"), "recovered-lines")
    groups = ocr_groups(lines)
    extra = groups.groupBy(*PAGE, "paragraph").agg(F.count_if("is_row").alias("table_rows"), F.first("width").alias("width"), F.first("height").alias("height"), T.half_even(F.avg("coverage"), 3).alias("avg_coverage"))
    found = merged(groups).select(*PAGE, "paragraph", once(speech.ocr_normalize(F.col("text"))).alias("text"), *BOX).where((F.length("text") >= 24) & (meaning("text") >= 5))
    found = known(found.join(extra, [*PAGE, "paragraph"])).where(~similar(0.88)("text", "known"))
    found = found.withColumn("type", once(classify.element_class(F.col("text"), *place, F.col("table_rows")))).where(~F.col("type").isin(*FURNITURE))
    return found.select(*PAGE, "paragraph", F.when(F.col("type") == "paragraph", "recovered_ocr_paragraph").otherwise(F.col("type")).alias("type"), "text", "x0", "y0", "x1", "y1", "avg_coverage")
