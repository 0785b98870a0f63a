"""Classes of elements, front-matter labels and identity scores."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import compact, count, let, strip, sub, token_count

#: Element types that are never spoken.
SKIP = ("header", "header_candidate", "footer", "footer_candidate", "page_number", "url", "doi", "extraction_artifact", "duplicate_marker", "duplicate_heading_fragment")
FRONT = (("copyright", "copyright|isbn"), ("table_of_contents", "contents"), ("acknowledgements", "acknowledg"), ("preface", "preface"), ("foreword", "foreword"))


def publisher_footer(c: Column) -> Column:
    return c.startswith("©") | F.lower(c).rlike(P.PUBLISHER)


def text_class(c: Column) -> Column:
    """The branches of the classifier that need text alone, first match first."""

    def of(t):
        kind = F.when(t == "", "empty").when(t.rlike(P.PAGE_NUMBER), "page_number").when(t.rlike(P.ARTIFACT) & (count(t, P.LETTER) == 0), "extraction_artifact")
        return kind.when(t.rlike(P.URL), "url").when(t.rlike(P.DOI), "doi").when(publisher_footer(t), "footer").when(t.rlike(P.CAPTION), "figure_caption").otherwise("paragraph")

    return let(strip(c), of)


def heading(t: Column, x0: Column, x1: Column, width: Column) -> Column:
    words, upper = token_count(t), F.left(t, F.lit(1)).rlike(r"\p{Lu}")
    label = t.rlike(rf"(?i)\A(?:chapter|part){P.SPACE}+(?:[ivxlcdm]+|[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)(?:[^\p{{L}}\p{{N}}_]|\z)")
    centred = (words <= 12) & (F.abs((x0 + x1) / 2 - width / 2) < width * 0.16)
    short = (F.length(t) < 70) & (x1 - x0 < width * 0.62) & upper
    return (t != "") & (F.length(t) <= 120) & (label | (~t.rlike(r"\A[(\[]?[0-9]{4}") & ~t.endswith(".") & (centred | short)))


def element_class(c: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, table_rows: Column | None = None) -> Column:
    """The whole classifier; table_rows: lines that look like rows of a table, where the element has lines."""
    return let(strip(c), lambda t: _element_class(t, x0, y0, x1, y1, width, height, table_rows))


def _element_class(t: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, table_rows: Column | None) -> Column:
    note = (y0 > height * 0.68) & t.rlike(rf"\A[0-9]+(?:{P.SPACE}+|\.)")
    kind = F.when(t == "", "empty").when(t.rlike(P.PAGE_NUMBER), "page_number").when(t.rlike(P.ARTIFACT) & (count(t, P.LETTER) == 0), "extraction_artifact")
    kind = kind.when(t.rlike(P.URL), "url").when(t.rlike(P.DOI), "doi").when(publisher_footer(t), "footer").when(y0 < height * 0.075, "header_candidate")
    kind = kind.when((y1 > height * 0.88) & note, "footnote").when(y1 > height * 0.88, "footer_candidate").when(t.rlike(P.CAPTION), "figure_caption").when(note, "footnote")
    if table_rows is not None:
        kind = kind.when(table_rows >= 3, "table_candidate")
    return kind.when(heading(t, x0, x1, width), "heading").otherwise("paragraph")


def narrated(kind: Column) -> Column:
    return ~kind.isin("empty", *SKIP)


def front_matter(c: Column) -> Column:
    """Labels joined by commas, in fixed order."""
    t = F.lower(c)
    return F.concat_ws(",", *(F.when(t.rlike(p), name) for name, p in FRONT))


def noise(t: Column) -> Column:
    # plain words are looked up one by one, which a pattern of all of them does many times slower
    signs = [w.replace("\\", "") for w in P.NOISE.split("|")]
    return let(F.lower(t), lambda low: reduce(or_, (low.contains(w) for w in signs))) | t.rlike(P.NOISE_ONLY)


def _tidy(c: Column) -> Column:
    return sub(compact(c), r"\A[ |]+|[ |]+\z")


def person(c: Column) -> Column:
    return _named(_tidy(c))


def _named(tidy: Column) -> Column:
    def of(t):
        words = F.filter(F.transform(F.split(t, " "), lambda w: sub(w, "[^A-Za-zÀ-ÖØ-öø-ÿ'.-]")), lambda w: w != "")
        capital = lambda w: F.size(F.filter(w, lambda x: ~F.lower(x).isin(*P.PARTICLES) & x.rlike(r"\A\p{Lu}")))
        # long lines are no names, and are not taken apart
        return F.when((t == "") | (F.length(t) > 80), False).otherwise(let(words, lambda w: F.size(w).between(2, 5) & (capital(w) >= 2) & ~noise(t)))

    return let(sub(tidy, P.BY), of)


def subtitle_like(c: Column) -> Column:
    t = _tidy(c)
    return t.rlike("[:—–]") | (token_count(t).between(5, 14) & ~person(t))


def title_case(c: Column) -> Column:
    good = lambda words: F.size(F.filter(words, lambda w: w.rlike(r"\A\p{Lu}") | F.lower(w).isin(*P.SMALL)))
    return let(F.regexp_extract_all(c, F.lit(P.LATIN_WORD), F.lit(0)), lambda words: (F.size(words) > 0) & (good(words) >= 0.7 * F.size(words)))


def plausible(c: Column) -> Column:
    t = _tidy(c)
    return F.length(t).between(2, 120) & (count(t, P.LETTER) >= 2) & ~noise(t) & ~t.rlike(rf"(?i){P.B}(?:chapter|contents|preface|acknowledg|references|bibliography|index){P.B}")


def identity_features(t: Column) -> Column:
    """What the scores need of a text, each once: tokens, looks like a name, noise, title case, looks like a subtitle."""
    own = (token_count(t).alias("n"), noise(t).alias("noise"), title_case(t).alias("title_case"))
    return let(_tidy(t), lambda tidy: F.struct(*own, _named(tidy).alias("person"), tidy.rlike("[:—–]").alias("cut")))


def identity_scores(t: Column, page: Column, font: Column | None = None, y: Column | None = None, centre: Column | None = None) -> Column:
    """Title, subtitle and author scores in hundredths, which add exactly, as a struct. font: ratio to the largest; null features add nothing."""
    return let(identity_features(t), lambda f: F.struct(*(c.alias(n) for n, c in zip(("title", "subtitle", "author"), _scores(f, page, font, y, centre), strict=True))))


def _scores(f: Column, page: Column, font: Column | None, y: Column | None, centre: Column | None) -> tuple[Column, Column, Column]:
    n, named, noisy, cased = f["n"], f["person"], f["noise"], f["title_case"]
    sub_like = f["cut"] | (n.between(5, 14) & ~named)
    add = lambda *cases: sum((F.when(c, v).otherwise(0) for c, v in cases), F.lit(0))
    near = (page <= 3) & (page != 1)
    title = add((F.lit(True), 35), (page == 1, 15), (near, 5), (n.between(1, 7), 12), (n > 16, -25), (named, -15), (cased, 8), (noisy, -50))
    subtitle = add((F.lit(True), 20), (page == 1, 10), (near, 5), (n.between(4, 14), 12), (n > 16, -10), (named, -10), (sub_like, 25), (cased, 8), (noisy, -50))
    author = add((F.lit(True), 20), (page == 1, 5), (n > 16, -20), (named, 45), (noisy, -50))
    if font is not None:
        title, subtitle = title + add((font >= 0.92, 35), ((font < 0.92) & (font >= 0.72), 10)), subtitle + add(((font < 0.92) & (font >= 0.72), 25))
    if y is not None:
        title, subtitle, author = title + add((y.between(0.12, 0.58), 10)), subtitle + add((y.between(0.12, 0.58), 8)), author + add((y > 0.45, 8))
    if centre is not None:
        mid = F.abs(centre - 0.5) < 0.22
        title, subtitle, author = title + add((mid, 8)), subtitle + add((mid, 5)), author + add((mid, 3))
    return title, subtitle, author
