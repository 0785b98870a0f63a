"""Book identity: candidates from lines, metadata and artifacts; the best of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import patterns as P
from ..functions import text as T


def candidates(lines: DataFrame) -> DataFrame:
    """doc_id, field, value, confidence, page, reason; lines: doc_id, ord, text, page, font_size, y_ratio, center_x_ratio (nullable)."""
    rows = lines.where(classify.plausible(F.col("text"))).withColumn("font", F.col("font_size") / F.max("font_size").over(Window.partitionBy("doc_id")))
    rows = rows.withColumn("_s", classify.identity_scores(F.col("text"), F.col("page"), F.col("font"), F.col("y_ratio"), F.col("center_x_ratio")))
    scores = [F.col(f"_s.{f}") for f in ("title", "subtitle", "author")]
    own = T.compact(T.sub(F.col("text"), P.BY))
    fields = [("title", F.col("text"), 55, 98), ("subtitle", F.col("text"), 50, 95), ("author", own, 62, 98)]
    found = [F.when(s >= least, F.struct(F.lit(f).alias("field"), v.alias("value"), (F.least(s, F.lit(most)) / 100.0).alias("confidence"), F.lit(f"ranked {f} line").alias("reason"))) for (f, v, least, most), s in zip(fields, scores, strict=True)]
    by = F.when(F.col("text").rlike(P.BY) & classify.person(own), F.struct(F.lit("author").alias("field"), own.alias("value"), (F.lit(90) / 100.0).alias("confidence"), F.lit("explicit by-line").alias("reason")))
    return rows.select("doc_id", "ord", "page", F.explode(F.array_compact(F.array(by, *found))).alias("c")).select("doc_id", "ord", "page", "c.field", "c.value", "c.confidence", "c.reason")


def select(found: DataFrame, strict: bool = False) -> DataFrame:
    """The best value of each field and document; the subtitle differs from the title and, unless strict, from the author."""
    rows = found.withColumn("key", T.norm_key(F.col("value"))).where("key <> ''")
    order = [F.desc("confidence"), F.col("ord")]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "field", "key").orderBy(*order))).where("n = 1")
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "field").orderBy(*order)))
    taken = best.where((F.col("n") == 1) & F.col("field").isin("title", *([] if strict else ["author"]))).select("doc_id", "key").distinct()
    sub = rows.where("field = 'subtitle'").join(taken, ["doc_id", "key"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    cols = ["doc_id", "field", "value", "confidence", "page", "reason"]
    return best.where("n = 1 and field <> 'subtitle'").select(*cols).unionByName(sub.where("n = 1").select(*cols))


def priors(artifacts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Candidates that stand before any line: earlier artifacts (doc_id, title, subtitle, author) and the document's metadata (doc_id, title, author)."""
    # fixed values: confidences of the sources
    art = (("title", 0.42), ("author", 0.62), ("subtitle", 0.50))
    of = lambda field, value, c, reason: F.when(T.compact(value) != "", F.struct(F.lit(field).alias("field"), T.compact(value).alias("value"), F.lit(c).alias("confidence"), F.lit(reason).alias("reason")))
    a = artifacts.select("doc_id", F.explode(F.array_compact(F.array(*(of(f, F.col(f), c, f"existing artifact {f}") for f, c in art)))).alias("c"))
    title, author = T.compact(F.coalesce("title", F.lit(""))), T.compact(F.coalesce("author", F.lit("")))
    found = [F.when(classify.plausible(title), of("title", title, 0.60, "metadata title")), F.when(classify.person(author), of("author", author, 0.75, "metadata author"))]
    m = metadata.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("c"))
    return a.unionByName(m).select("doc_id", F.lit(-1).alias("ord"), F.lit(None).cast("int").alias("page"), "c.field", "c.value", "c.confidence", "c.reason")


def top(found: DataFrame, n: int = 80) -> DataFrame:
    """The candidates that a document's report lists, best first."""
    own = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "field", "value", "reason")
    return found.withColumn("place", F.row_number().over(own)).where(F.col("place") <= n)


def with_folder(chosen: DataFrame, folders: DataFrame) -> DataFrame:
    """The chosen values, and the folder's name as the title of documents without one; folders: doc_id, folder."""
    none = folders.join(chosen.where("field = 'title'").select("doc_id"), "doc_id", "left_anti")
    slug = T.compact(F.regexp_replace("folder", "[_-]+", " "))
    more = none.select("doc_id", F.lit("title").alias("field"), slug.alias("value"), F.lit(0.25).alias("confidence"), F.lit(None).cast("int").alias("page"), F.lit("folder name fallback").alias("reason"))
    return chosen.unionByName(more)


def resolved(lines: DataFrame, artifacts: DataFrame, metadata: DataFrame, folders: DataFrame, strict: bool = False) -> DataFrame:
    """The identity of every document from all four sources."""
    found = priors(artifacts, metadata).unionByName(candidates(lines))
    return with_folder(select(found, strict), folders)


def chain(books: DataFrame, *tables: DataFrame, columns: tuple[str, ...] = ("title", "subtitle", "author"), key: str = "doc_id") -> DataFrame:
    """For each book the first value that is not empty, over the tables in order of rank; a title falls back to the folder, others to nothing.

    books: key and folder; each table has the key once, and any of the columns.
    """
    out = books.select(key, "folder")
    for k, t in enumerate(tables):
        out = out.join(t.select(key, *(F.col(c).alias(f"_{k}_{c}") for c in columns if c in t.columns)), key, "left")
    every = lambda c: [F.col(f"_{k}_{c}") for k, t in enumerate(tables) if c in t.columns]
    return out.select(key, *(F.coalesce(first_of(*every(c)), F.col("folder") if c == "title" else F.lit("")).alias(c) for c in columns))


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(T.strip(v), F.lit("")) for v in values))


def front_text(title: Column, subtitle: Column, author: Column) -> Column:
    """Title, subtitle (if another) and author as spoken front matter."""
    other = F.when(T.norm_key(subtitle) != T.norm_key(title), T.add_period(subtitle))
    return F.array_join(F.array_compact(F.array(T.add_period(title), other, T.add_period(F.concat(F.lit("By "), author)))), "\n\n")
