"""From elements to narration: skip reasons, spoken text, chapter text, skip histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, markers
from ..functions import text as T

#: Types of headings.
HEADINGS = ("heading", "subtitle", "chapter_title", "section_heading")


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, line_no (from 1) and line: one element per line."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def duplicate_heading(heading: Column, title: Column) -> Column:
    h, t = T.norm_key(heading), T.norm_key(title)
    inside = t.contains(h)
    return (h != "") & (t != "") & ((h == t) | (inside & ((F.size(F.split(h, " ")) >= 2) | h.rlike(r"\Achapter [0-9]+\z"))))


def skip_reason(text: Column, kind: Column, title: Column | None = None, narrate: Column | None = None, strict: bool = False) -> Column:
    """Why an element is not spoken, null if it is; the first reason counts. A null narrate flag speaks."""
    reason = F.when(T.compact(F.coalesce(text, F.lit(""))) == "", "empty").when(kind.isin(*classify.SKIP), kind)
    if narrate is not None:
        reason = reason.when(~F.coalesce(narrate, F.lit(True)), "not_narrated")
    reason = reason.when(markers.narration(text, strict), "marker")
    if title is not None:
        reason = reason.when(kind.isin(*HEADINGS) & duplicate_heading(text, title), "duplicate_heading")
    return reason


def spoken(text: Column, kind: Column) -> Column:
    return F.when(kind == "footnote", T.footnote(text)).when(kind == "figure_caption", T.figure_caption(text)).when(kind.isin(*HEADINGS), T.add_period(T.narration_paragraph(text))).otherwise(T.narration_paragraph(text))


def blocks(text: Column, strict: bool = False) -> Column:
    """The spoken blocks of a text whose lines are elements, as an array; no shuffle."""

    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), classify.text_class(x).alias("kind")))
    keep = F.filter(lines, lambda x: skip_reason(x["line"], x["kind"], strict=strict).isNull())
    return F.filter(F.transform(keep, lambda x: spoken(x["line"], x["kind"])), lambda x: x != "")


def render(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and narration: blocks with a blank line between them."""
    return docs.select(key, F.array_join(blocks(F.col("text")), "\n\n").alias("narration"))


def with_title(parts: Column, title: Column) -> Column:
    """Blocks that begin with the title: later blocks equal to it go, and it is put first unless it is there."""
    key = T.norm_key(title)
    rest = F.filter(parts, lambda x, i: (i == 0) | (T.norm_key(x) != key))
    first = T.norm_key(F.coalesce(F.get(rest, F.lit(0)), F.lit("")))
    return F.when((key == "") | (first == key), rest).otherwise(F.concat(F.array(title), rest))


def subtitle_like(block: Column) -> Column:
    # fixed values: words that open a sentence rather than a title
    starters = ("a", "an", "as", "at", "by", "for", "from", "if", "in", "it", "its", "on", "once", "the", "these", "this", "to", "we", "when", "while", "with")
    b = T.compact(block)
    words = F.split(b, " ")
    alpha = F.filter(words, lambda w: w.rlike("[A-Za-z]"))
    capital = F.size(F.filter(alpha, lambda w: w.rlike(r"\A\p{Lu}")))
    opening = F.lower(T.sub(F.get(words, F.lit(0)), "[^A-Za-z]")).isin(*starters) & (F.size(words) > 8)
    return (b != "") & (F.size(words) <= 18) & (T.ends_sentence(b) | (~opening & (F.size(alpha) > 0) & (capital >= 0.45 * F.size(alpha))))


def punctuate(parts: Column, title: Column) -> Column:
    """Full stops behind the title and a subtitle that follows it."""
    start = lambda x: ((T.norm_key(title) != "") & (T.norm_key(x) == T.norm_key(title))) | x.rlike(r"(?i)\Achapter +[0-9]+(?:[^\p{L}\p{N}_]|\z)")
    return F.transform(parts, lambda x, i: F.when(((i == 0) & start(x)) | ((i == 1) & subtitle_like(x)), T.add_period(x)).otherwise(x))


def skip_histogram(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by key and reason with subtotals (rollup); elements: key, reason."""
    return elements.where(F.col("reason").isNotNull()).rollup(key, "reason").agg(F.count(F.lit(1)).alias("n"))
