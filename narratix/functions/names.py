"""Names of files and folders, labels, tags and figures for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import compact, half_even, strip, sub


def _or(c: Column, other: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))


def safe_filename(c: Column, most: int = 80) -> Column:
    """Letters, digits, `_` and `-`; white space becomes `_`. `Untitled` where nothing is left."""
    kept = strip(sub(c, rf"[^\p{{L}}\p{{N}}_{P.SPACE[1:-1]}-]+"))
    return _or(F.left(sub(kept, f"{P.SPACE}+", "_"), F.lit(most)), "Untitled")


def folder_name(stem: Column) -> Column:
    """A book's folder: ASCII letters, digits, stops, `_`, `-` and single spaces; `Book` where nothing is left."""
    return _or(compact(sub(_or(strip(stem), "Book"), "[^A-Za-z0-9._ -]+")), "Book")


def slug_title(c: Column) -> Column:
    """A title from a file's name: `_` and `-` become spaces, years go."""
    return sub(compact(sub(F.translate(c, "_-", "  "), r"(?<![\p{L}\p{N}_])[0-9]{4}(?![\p{L}\p{N}_])")), r"\A[ |]+|[ |]+\z")


def chapter_label(chapters: Column) -> Column:
    """`full`, `chapter_007` or the first six numbers, `_plus` where there are more."""
    number = lambda k: F.format_string("%03d", k)
    some = F.concat(F.lit("chapters_"), F.array_join(F.transform(F.slice(chapters, 1, 6), number), "_"), F.when(F.size(chapters) > 6, "_plus").otherwise(""))
    return F.when(F.coalesce(F.size(chapters), F.lit(0)) <= 0, "full").when(F.size(chapters) == 1, F.concat(F.lit("chapter_"), number(F.get(chapters, F.lit(0))))).otherwise(some)


def size_label(c: Column) -> Column:
    """Bytes with a unit and two decimals; none or null is `0 B`."""
    label = F.lit("0 B")
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        least = 1024.0**k if k else 0.0
        label = F.when((c >= least) & (c != 0), F.format_string(f"%.2f {unit}", half_even(c / F.lit(1024.0**k), 2))).otherwise(label)
    return label


def progress_bar(done: Column, total: Column, width: int = 28) -> Column:
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total))
    n = F.when(total > 0, F.bround(share * F.lit(float(width))).cast("int")).otherwise(0)
    return F.concat(F.lit("["), F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n), F.lit("]"))


def tags(title: Column, subtitle: Column, author: Column, genre: Column, year: Column, comment: Column) -> Column:
    """Tags of an audio file as a map; blank ones are left out, an unknown author is named so."""
    clean = lambda c: compact(F.coalesce(c, F.lit("")))
    title, subtitle, author = clean(title), clean(subtitle), clean(author)
    full = F.when((title != "") & (subtitle != ""), F.concat(title, F.lit(": "), subtitle)).otherwise(title)
    artist = _or(author, "Unknown Author")
    said = F.coalesce(comment, F.when(subtitle != "", F.concat(title, F.lit(". "), subtitle, F.lit("."))).otherwise(title))
    pairs = {"title": full, "artist": artist, "album": full, "album_artist": artist, "genre": _or(clean(genre), "Audiobook"), "track": F.lit("1/1"), "comment": clean(said), "subtitle": subtitle, "author": author, "date": clean(year)}
    return F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda _, v: v != "")


def book_path(folder: Column, label: Column, suffix: str = ".wav") -> Column:
    """The book's file: folder and label; an MP3 of a whole book has no label."""
    stem = F.concat_ws("_", folder, label)
    return F.concat(F.lit("books/"), F.regexp_replace(stem, "_full$", "") if suffix == ".mp3" else stem, F.lit(suffix))


def mode_label(force: Column, stitch_only: Column, no_stitch: Column) -> Column:
    return F.when(force, "force regenerate").when(stitch_only, "stitch only").when(no_stitch, "render chunks only").otherwise("resume / reuse existing")
