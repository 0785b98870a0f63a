"""Page layout: words to lines, lines to paragraphs, repeated headers, similar lines. Tables carry doc and page keys."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, markers
from ..functions import text as T

PAGE = ["doc_id", "page"]


def reading_order(elements: DataFrame) -> DataFrame:
    """Elements numbered per page by y0, x0 and source order, with their ids."""
    own = Window.partitionBy(*PAGE).orderBy("y0", "x0", "ord")
    out = elements.withColumn("idx", F.row_number().over(own) - 1)
    return out.withColumn("id", F.format_string("p%04d_e%04d", "page", "idx"))


def inside(x: Column, y: Column, box: str, pad: float = 1.5) -> Column:
    return x.between(F.col(f"{box}.x0") - pad, F.col(f"{box}.x1") + pad) & y.between(F.col(f"{box}.y0") - pad, F.col(f"{box}.y1") + pad)


def orphans(words: DataFrame, blocks: DataFrame, pad: float = 2.0) -> DataFrame:
    """Words whose centre lies in no block of their page."""
    b = blocks.select(*(F.col(c).alias(f"_{c}") for c in PAGE), F.struct("x0", "y0", "x1", "y1").alias("box"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return words.join(b, (F.col("doc_id") == F.col("_doc_id")) & (F.col("page") == F.col("_page")) & inside(x, y, "box", pad), "left_anti")


def _cluster(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values(["y0", "x0", "ord"], kind="stable").reset_index(drop=True)
    tolerance = max(2.2, float(np.median(f["y1"] - f["y0"])) * 0.5)
    groups: list[list[float]] = []
    line = []
    for y in f["y0"]:
        for k, ys in enumerate(groups):
            if abs(y - float(np.median(ys))) <= tolerance:
                ys.append(y)
                line.append(k)
                break
        else:
            groups.append([y])
            line.append(len(groups) - 1)
    return f.assign(line=line)


def cluster_lines(words: DataFrame) -> DataFrame:
    """Words with their line: the first whose running median of y0 is near enough. One page is a group, so groups are small."""
    return words.groupBy(*PAGE).applyInPandas(_cluster, words.schema.simpleString()[7:-1].replace(":", " ", words.schema.simpleString().count(":")) + ", line long")


def lines(words: DataFrame, by: str = "line") -> DataFrame:
    """Words of a line joined by x0, with the union of their boxes."""
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    out = words.groupBy(*PAGE, by).agg(F.array_sort(F.collect_list(F.struct("x0", "ord", "text"))).alias("all"), *box)
    return out.withColumn("text", T.normalize_text(F.array_join(F.transform("all", lambda w: w["text"]), " "))).drop("all").where("text <> ''")


def paragraphs(rows: DataFrame, width: str = "width", height: str = "height", ocr: bool = False) -> DataFrame:
    """Lines with their paragraph number: gaps and islands over breaks by gap, indent, headings and the footer band."""
    page = Window.partitionBy(*PAGE)
    own = page.orderBy("y0", "x0", "line")
    med = F.median(F.col("y1") - F.col("y0")).over(page)
    head = classify.heading(F.col("text"), F.col("x0"), F.col("x1"), F.col(width))
    foot = F.col("y1") > F.col(height) * 0.88
    out = rows.withColumn("_med", med).withColumn("_head", head | foot)
    gap, left = F.col("y0") - F.lag("y1").over(own), F.abs(F.col("x0") - F.lag("x0").over(own))
    cut = (gap > F.col("_med") * (5.5 if ocr else 1.45)) | F.col("_head") | F.lag("_head").over(own)
    if not ocr:
        cut = cut | ((left > 24) & (gap >= F.col("_med") * -0.2))
    out = out.withColumn("_cut", F.coalesce(cut.cast("int"), F.lit(0)))
    return out.withColumn("paragraph", F.sum("_cut").over(own)).drop("_med", "_head", "_cut")


def merged(rows: DataFrame) -> DataFrame:
    """One element per paragraph: lines joined, split words healed, boxes united."""
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    out = rows.groupBy(*PAGE, "paragraph").agg(F.array_sort(F.collect_list(F.struct("y0", "line", "text"))).alias("all"), *box)
    return out.withColumn("text", T.merge_lines(F.transform("all", lambda x: x["text"]))).drop("all")


def mark_markers(elements: DataFrame) -> DataFrame:
    """Standalone markers become duplicate_marker, unspoken, with a confidence of 0.92 at least."""
    m = markers.layout(F.col("text"))
    kept = elements.withColumn("confidence", F.when(m, F.greatest("confidence", F.lit(0.92))).otherwise(F.col("confidence")))
    return kept.withColumn("narrate", F.when(m, False).otherwise(F.col("narrate"))).withColumn("type", F.when(m, "duplicate_marker").otherwise(F.col("type")))


def heading_fragments(headings: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Headings that are a proper ending of an earlier heading of their page and longer than 6; key, idx, text."""
    key = key or PAGE
    early = headings.select(*(F.col(c).alias(f"_{c}") for c in key), F.col("idx").alias("_idx"), F.col("text").alias("_text"))
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    cond = (F.col("_idx") < F.col("idx")) & F.col("_text").endswith(F.col("text")) & (F.col("_text") != F.col("text")) & (F.length("text") > 6)
    for s in same:
        cond = s & cond
    return headings.join(early, cond, "left_semi")


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def ratio_over(a: str, b: str, threshold: float) -> float:
    """The ratio, or 0 where a quick bound shows that it is not over the threshold."""
    m = SequenceMatcher(None, a.lower(), b.lower())
    return m.ratio() if m.real_quick_ratio() > threshold and m.quick_ratio() > threshold else 0.0


def _similar(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.assign(similarity=[ratio_over(a, b, threshold) for a, b in zip(f["a_text"], f["b_text"], strict=True)])
            yield f[f["similarity"] > threshold]

    return run


def similar_pairs(rows: DataFrame, key: list[str], threshold: float = 0.82) -> DataFrame:
    """Pairs (a before b) of texts of one key whose matching ratio is over threshold; rows: key, idx, text.

    The ratio is at most 2 min / (la + lb), so texts meet only in neighbouring classes of length: each text is listed
    under its class and the next one, and pairs whose lengths rule the threshold out never reach Python.
    """
    step = 2 / threshold - 1
    band = F.floor(F.log(F.greatest(F.length("text"), F.lit(1)).cast("double")) / F.log(F.lit(step)))
    base = rows.select(*key, "idx", "text", band.alias("band"))
    side = lambda p: base.select(*key, *(F.col(c).alias(f"{p}_{c}") for c in ("idx", "text", "band")))
    a, b = side("a").withColumn("at", F.explode(F.array(F.col("a_band") - 1, F.col("a_band"), F.col("a_band") + 1))), side("b").withColumn("at", F.col("b_band"))
    la, lb = F.length("a_text"), F.length("b_text")
    pairs = a.join(b, [*key, "at"]).where((F.col("a_idx") < F.col("b_idx")) & (2 * F.least(la, lb) > F.lit(threshold) * (la + lb)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), f"a_idx {kinds['idx']}", f"b_idx {kinds['idx']}", "a_text string", "b_text string", "similarity double"])
    return pairs.select(*key, "a_idx", "b_idx", "a_text", "b_text").mapInPandas(_similar(threshold), schema)


def promote_repeats(elements: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Header and footer candidates with two similar ones or more in their document lose `_candidate`.

    Equal texts are counted by group; only distinct texts are compared.
    """
    some = elements.where(F.col("type").isin("header_candidate", "footer_candidate"))
    texts = some.groupBy("doc_id", "type", "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("idx"))
    pairs = similar_pairs(texts.select("doc_id", "type", "idx", "text"), ["doc_id", "type"], threshold)
    both = pairs.select("doc_id", "type", F.col("a_text").alias("text"), F.col("b_text").alias("other")).unionByName(pairs.select("doc_id", "type", F.col("b_text").alias("text"), F.col("a_text").alias("other")))
    near = both.join(texts.select("doc_id", "type", F.col("text").alias("other"), "n"), ["doc_id", "type", "other"]).groupBy("doc_id", "type", "text").agg(F.sum("n").alias("m"))
    up = texts.join(near, ["doc_id", "type", "text"], "left").where(F.col("n") - 1 + F.coalesce("m", F.lit(0)) >= 2).select("doc_id", "type", "text", F.lit(True).alias("_up"))
    out = elements.join(up, ["doc_id", "type", "text"], "left")
    return out.withColumn("type", F.when(F.col("_up"), F.regexp_replace("type", "_candidate$", "")).otherwise(F.col("type"))).drop("_up")
