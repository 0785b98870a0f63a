"""Text functions, Column to Column. Each name gives the rule; null in is null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends; the pattern, which looks at every sign, is for texts that have some."""
    return let(c, lambda t: F.when(F.left(t, F.lit(1)).rlike(P.SPACE) | F.right(t, F.lit(1)).rlike(P.SPACE), sub(t, P.STRIP)).otherwise(t))


def compact(c: Column) -> Column:
    """White space (Unicode) as single spaces, none at both ends."""
    return F.trim(sub(F.translate(c, P.SPACES, " " * len(P.SPACES)), " {2,}", " "))


def clean_text(c: Column) -> Column:
    """No-break spaces become spaces, runs of blanks one space, three or more line ends two."""
    return strip(sub(sub(F.translate(c, "\u00a0", " "), "[ \t]+", " "), "\n{3,}", "\n\n"))


def normalize_text(c: Column) -> Column:
    """One line with straight quotes."""
    return compact(F.translate(c, "\u201c\u201d\u2018\u2019", "\"\"''"))


def normalize_block(c: Column) -> Column:
    """Joins words that a line end splits, then as normalize_text."""
    return normalize_text(sub(c, rf"([A-Za-z])-{P.SPACE}*\n{P.SPACE}*([a-z])", "$1$2"))


def norm_key(c: Column) -> Column:
    """Lower case, everything but a-z and digits is one space."""
    return F.trim(sub(F.lower(c), "[^a-z0-9]+", " "))


def folder_key(c: Column) -> Column:
    return sub(F.lower(c), "[^a-z0-9]+", "")


def normalize_paragraph(c: Column) -> Column:
    """One line; no space before closing or after opening signs."""
    one = sub(sub(F.translate(c, "\u00a0\r", " \n"), rf"{P.SPACE}*\n{P.SPACE}*", " "), "[ \t]+", " ")
    return strip(sub(sub(sub(one, rf"{P.SPACE}+([,.;:!?])", "$1"), rf"([(\[{{]){P.SPACE}+", "$1"), rf"{P.SPACE}+([)\]}}])", "$1"))


def repair_words(c: Column) -> Column:
    """Three words that soft wraps often split."""
    for broken, whole in (("com-{0}+puter", "computer"), ("comput-{0}+ers", "computers"), ("con-{0}+temporary", "contemporary")):
        c = sub(c, r"(?i)(?<![\p{L}\p{N}_])" + broken.format(P.SPACE), whole)
    return c


def narration_paragraph(c: Column) -> Column:
    return strip(repair_words(normalize_paragraph(sub(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "))))


def merge_lines(lines: Column) -> Column:
    """An array of lines as one text; a hyphen between letters at a line end goes."""
    return normalize_text(sub(sub(F.array_join(lines, "\n"), r"(?<=[A-Za-z])-\n(?=[a-z])", ""), "\n", " "))


def nonempty(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Sentences of a paragraph; a stop in a listed abbreviation does not end one, and one starts with A-Z, a digit or a quote."""
    for a in P.ABBREVIATIONS:
        c = F.replace(c, F.lit(a), F.lit(a.replace(".", P.STOP)))
    parts = F.split(sub(c, P.SENTENCE, f"$1{P.CUT}$2"), P.CUT)
    return nonempty(F.transform(parts, lambda x: F.translate(x, P.STOP, ".")))


def paragraphs(c: Column) -> Column:
    return nonempty(F.split(c, rf"\n{P.SPACE}*\n"))


def word_count(c: Column) -> Column:
    """Words as the chunker counts them."""
    return count(c, P.WORD)


def token_count(c: Column) -> Column:
    """Runs of other than white space: one more than the spaces between them, which are counted many times faster than matches."""
    return let(compact(c), lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1))


def ends_sentence(c: Column) -> Column:
    return strip(c).rlike(P.SENTENCE_END)


def add_period(c: Column) -> Column:
    return let(c, lambda t: F.when((t == "") | ends_sentence(t), t).otherwise(F.concat(t, F.lit("."))))


def preview(c: Column, most: int = 160) -> Column:
    return let(compact(c), lambda one: F.when(F.length(one) <= most, one).otherwise(F.concat(sub(F.left(one, F.lit(most)), rf"{P.SPACE}+\z"), F.lit("..."))))


def footnote(c: Column) -> Column:
    """`Footnote n. text`, or `Footnote. text` where no number leads."""
    p = rf"(?is)\A(?:footnote\.?{P.SPACE}*)?([0-9]{{1,3}})[.)]?{P.SPACE}+(.*)\z"
    own = lambda t: strip(F.when(t.rlike(p), F.concat(F.lit("Footnote "), F.regexp_extract(t, p, 1), F.lit(". "), F.regexp_extract(t, p, 2))).otherwise(F.concat(F.lit("Footnote. "), t)))
    return let(strip(sub(narration_paragraph(c), rf"(?i)\AFootnote\.{P.SPACE}*")), own)


def figure_caption(c: Column) -> Column:
    return let(narration_paragraph(c), lambda t: F.when(t.rlike(rf"(?i)\A(?:figure|fig\.){P.SPACE}+[0-9]"), t).otherwise(strip(F.concat(F.lit("Figure caption. "), t))))


def range_list(c: Column) -> Column:
    """`1-3,6,2` as sorted distinct numbers; parts that are no number or range are left out."""
    ends = lambda x: F.transform(F.split(x, "-"), lambda y: F.trim(y).try_cast("int"))
    part = lambda x: F.when(F.size(ends(x)) == 1, ends(x)).when((F.size(ends(x)) == 2) & (F.get(ends(x), F.lit(0)) <= F.get(ends(x), F.lit(1))), F.sequence(F.get(ends(x), F.lit(0)), F.get(ends(x), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(F.split(c, ","), part)))))


def seconds(words: Column, per_minute: int = 160) -> Column:
    """Estimated seconds of speech, 1 at least."""
    return F.greatest(F.lit(1), F.bround(words / F.lit(float(per_minute)) * F.lit(60.0)).cast("int"))


def half_even(c: Column, places: int) -> Column:
    """A double to so many places: the nearest whole number of the scaled double, ties to even. bround looks at its shortest decimals, where ties differ."""
    unit = F.lit(10.0**places)
    near = F.rint(c * unit) / unit
    return F.when(F.abs(near) < float("inf"), near).otherwise(c.cast("double"))


def minutes(words: Column, per_minute: int = 150) -> Column:
    return half_even(words / F.lit(float(per_minute)), 2)


def clock(c: Column) -> Column:
    """Seconds as HH:MM:SS, or MM:SS under an hour; less than none counts as none, null is `--:--`."""
    s = F.greatest(F.lit(0), F.bround(c).cast("int"))
    h, m = (s / 3600).cast("int"), (s % 3600 / 60).cast("int")
    text = F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))
    return F.when(c.isNull(), "--:--").otherwise(text)


def heading_unit(c: Column) -> Column:
    """A chapter label, or at most 12 words that do not end like a sentence."""
    return let(compact(c), lambda t: (t != "") & (t.rlike(P.CHAPTER_LABEL) | (~t.rlike(P.SENTENCE_END) & (token_count(t) <= 12))))


def clean_for_speech(c: Column) -> Column:
    """Plain prose: no reasoning, code, links, list and heading marks, emphasis or separator lines. NFKC is the caller's."""
    t = F.translate(sub(c, "\r\n?", "\n"), "\u00a0\u201c\u201d\u2018\u2019\u200b\u200c\u200d\ufeff", " \"\"''")
    t = F.replace(t, F.lit("…"), F.lit("..."))
    t = sub(sub(t, "(?is)<think>.*?</think>"), "(?s)```.*?```")
    t = sub(sub(t, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.array_join(F.transform(F.split(t, "\n"), _speech_line), "\n")
    out = sub(out, "[*#`_•]")
    out = sub(sub(out, "[-–—]{3,}", " "), "[ \t]+", " ")
    return strip(sub(sub(out, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def _speech_line(raw: Column) -> Column:
    return let(strip(raw), _spoken)


def _spoken(t: Column) -> Column:
    """A stripped line without marks; empty if it is a separator or a label."""
    mark = sub(sub(t, rf"\A#{{1,6}}{P.SPACE}*"), rf"\A>{P.SPACE}*")
    mark = strip(sub(sub(mark, rf"\A[-*+•]{P.SPACE}+"), rf"\A[0-9]+[.)]{P.SPACE}+"))
    for p in (r"\*\*([^*]+)\*\*", "__([^_]+)__", r"\*([^*]+)\*", "_([^_]+)_"):
        mark = sub(mark, p, "$1")
    mark = strip(sub(strip(F.translate(mark, "`", "")), rf"(?i)\A(?:executive summary|quick summary|detailed summary|book review|overview|summary){P.SPACE}*[:\-–—]{P.SPACE}*"))
    mark = sub(F.translate(mark, "*#", ""), rf"\A{P.SPACE}*[-–—]+{P.SPACE}*")
    mark = sub(sub(mark, rf"{P.SPACE}+[-–—]{{2,}}{P.SPACE}+", " "), "[-–—]{3,}", " ")
    mark = strip(sub(sub(strip(mark), rf"\A[:\-–—]+{P.SPACE}*"), rf"{P.SPACE}*[:\-–—]+\z"))
    # most lines hold no sign that a step looks for, and more letters than a label
    mark = F.when(t.rlike(r"[*_`#>•+:\-–—]|\A[0-9]"), mark).otherwise(t)
    label = lambda m: F.when(m.rlike(r"\A(?:[^A-Za-z0-9]*+[A-Za-z0-9]){17}"), m).when(compact(sub(F.lower(m), "[^a-z0-9 ]+")).isin(*P.HEADING_LABELS), "").otherwise(m)
    separator = t.rlike(r"\A[*#_=~\-.–—" + P.SPACE[1:-1] + r"]{3,}\z")
    return F.when((t == "") | separator, "").otherwise(let(mark, label))
