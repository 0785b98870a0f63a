"""Summaries: prompts, a draft of each part of a book, cleaned model output, and rounds of refinement with a provider.

A provider is a function without arguments that gives a function from prompt to text; it is called once in each task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import patterns as P
from ..functions import text as T
from ..session import written
from ..sources.readers import natural_key
from .checks import validation_errors
from .export import draft

#: Openings of lines that a quick part must not hold.
BANNED_OPENINGS = (
    "book order",
    "source file",
    "chapter",
    "references",
    "bibliography",
    "works cited",
    "key themes",
    "core themes",
    "main themes",
    "conclusion",
    "summary",
    "analysis",
    "synthesis",
    "structure of the book",
    "key questions",
    "implications",
    "next steps",
    "recommendations",
)

#: Fixed value: the sentence before every summary.
INTRO = "This is a quick overview of {title} by {author}."
DRAFT_PROMPT = 'Part {number} of {total} of the audiobook "{title}" by {author} follows. In one short paragraph of plain prose, keep what a listener would remember of it. No headings, labels, lists, sources or page numbers.\n\n{text}'
RETELL_PROMPT = 'Retell "{title}" by {author} to a friend in two to four paragraphs of plain prose, from the notes below. No headings, labels, lists, references, questions or closing remarks.\n\n{text}'
REPAIR_PROMPT = 'Rewrite the retelling of "{title}" by {author} below as two to four paragraphs of plain prose. No headings, labels, lists, references, questions or closing remarks.'


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def clean(c: Column) -> Column:
    return T.clean_for_speech(nfkc(c))


def quick_part(c: Column) -> Column:
    """One paragraph of the lines that are no labels, list items or banned openings."""
    bad = rf"(?i)\A(?:{'|'.join(BANNED_OPENINGS)})|\A[0-9]+[.)]{P.SPACE}+|\A[a-zA-Z][\p{{L}}\p{{N}}_{P.SPACE[1:-1]}]{{0,60}}:\z"
    return T.compact(F.array_join(F.filter(T.nonempty(F.split(c, "\n")), lambda x: ~x.rlike(bad)), " "))


def with_intro(c: Column, intro: Column) -> Column:
    return F.when(T.strip(c).startswith(intro), T.strip(c)).otherwise(F.concat(intro, F.lit("\n\n"), T.strip(c)))


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its value, in which braces mean nothing."""
    return F.concat(*(values[x] if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\w+)\}", template))))


def book_names(title: Column, author: Column, folder: Column) -> dict[str, Column]:
    """title and author as prompts name them: the folder's name for want of a title."""
    known = lambda c: F.nullif(T.strip(c), F.lit(""))
    return {"title": F.coalesce(known(title), folder), "author": F.coalesce(known(author), F.lit("Unknown Author"))}


def draft_prompts(parts: DataFrame, books: DataFrame, *keys: str, template: str = DRAFT_PROMPT) -> DataFrame:
    """keys, ord and prompt of every part with text; parts: keys, name, text; books: keys, title, author, folder.

    Parts are numbered in natural order of their names; those without text count in the numbers.
    """
    book = Window.partitionBy(*keys)
    rows = parts.select(*keys, "name", F.coalesce(T.strip(F.col("text")), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.row_number().over(book.orderBy(natural_key(F.lower("name")), "name"))).withColumn("total", F.count(F.lit(1)).over(book))
    named = books.select(*keys, *(c.alias(n) for n, c in book_names(F.col("title"), F.col("author"), F.col("folder")).items()))
    prompt = filled(template, number=F.col("ord").cast("string"), total=F.col("total").cast("string"), title=F.col("title"), author=F.col("author"), text=F.col("text"))
    return rows.where("text <> ''").join(named, list(keys)).select(*keys, "ord", prompt.alias("prompt"))


def quick_draft(parts: DataFrame, books: DataFrame, provider: Callable[[], Callable[[str], str]], *keys: str, template: str = DRAFT_PROMPT) -> DataFrame:
    """keys and text: each book's parts as the provider tells them, cleaned and in order; a book of which nothing is left has no row.

    A book's parts are dealt over the tasks, and what the provider said is written: a lost executor does not ask again.
    """
    prompts = draft_prompts(parts, books, *keys, template=template).repartition(*keys, "ord")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema) + ", text string"
    told = written(prompts.mapInPandas(_generate(provider), kind).drop("prompt"), "drafts")
    return draft(told.withColumn("text", quick_part(clean(F.col("text")))), *keys)


def retell(drafts: DataFrame, books: DataFrame, provider: Callable[[], Callable[[str], str]], key: str, attempts: int = 3) -> DataFrame:
    """Drafts (key, text) to summaries as ``refine`` returns them; books: key, title, author, folder."""
    names = book_names(F.col("title"), F.col("author"), F.col("folder"))
    rows = drafts.join(books.select(key, *(c.alias(n) for n, c in names.items())), key)
    both = {n: F.col(n) for n in names}
    prompts = rows.select(F.col(key).alias("key"), filled(RETELL_PROMPT, text=F.col("text"), **both).alias("prompt"), filled(REPAIR_PROMPT, **both).alias("repair"), filled(INTRO, **both).alias("intro"))
    return refine(prompts, provider, attempts)


def _generate(provider: Callable[[], Callable[[str], str]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider()  # one model per task
        for f in frames:
            yield f.assign(text=[ask(p) for p in f["prompt"]])

    return run


def refine(prompts: DataFrame, provider: Callable[[], Callable[[str], str]], attempts: int = 3) -> DataFrame:
    """key, text, attempts and errors: rounds of generation for the rows that still have errors; prompts: key, prompt, repair, intro.

    Each round is written, so what a provider said is not asked again; after the last one a row keeps its errors.
    """
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema) + ", text string"
    open_, done = prompts, None
    for k in range(1, attempts + 1):
        got = open_.mapInPandas(_generate(provider), kind).withColumn("text", with_intro(clean(F.col("text")), F.col("intro")))
        got = written(got.withColumn("errors", validation_errors(F.col("text"))).withColumn("attempts", F.lit(k)), "summaries")
        rows = got.select("key", "text", "attempts", "errors").where(F.lit(k == attempts) | (F.size("errors") == 0))
        done = rows if done is None else done.unionByName(rows)
        open_ = got.where(F.size("errors") > 0).select(*(F.concat("repair", F.lit("\n\n"), "text").alias("prompt") if c == "prompt" else c for c in prompts.columns))
        if open_.isEmpty():
            break
    return done
