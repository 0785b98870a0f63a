"""Chunking: blocks to units, units to word-bounded chunks by a sequential fold inside each row; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TARGET, MIN, MAX, SLACK = 85, 50, 110, 25


def units(blocks: Column) -> Column:
    """array<struct(text, kind, words)> of an array of blocks: a heading is one unit, other blocks give their sentences."""
    unit = lambda kind: lambda x: F.struct(x.alias("text"), F.lit(kind).alias("kind"), T.word_count(x).alias("words"))

    body = lambda block: T.let(T.sentences(block), lambda parts: F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array(block)), unit("body")))
    of = lambda block: F.when(T.heading_unit(block), F.transform(F.array(block), unit("heading"))).otherwise(body(block))
    return F.flatten(F.transform(F.filter(F.transform(blocks, T.compact), lambda x: x != ""), of))


BIN = "struct<words:int,units:int>"


def bins(words: Column, target: int = TARGET, least: int = MIN, most: int = MAX) -> Column:
    """array<struct(words, units)>: units fill a chunk in order until the next one would pass target (from least on) or most."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("units"), F.array().cast(f"array<{BIN}>").alias("done"))

    def step(a, w):
        full = (a["units"] > 0) & (((a["words"] >= least) & (a["words"] + w > target)) | (a["words"] + w > most))
        closed = F.struct(a["words"].alias("words"), a["units"].alias("units"))
        return F.when(full, F.struct(w.alias("words"), F.lit(1).alias("units"), F.concat(a["done"], F.array(closed)).alias("done"))).otherwise(
            F.struct((a["words"] + w).alias("words"), (a["units"] + 1).alias("units"), a["done"].alias("done"))
        )

    last = lambda a: F.when(a["units"] > 0, F.concat(a["done"], F.array(F.struct(a["words"].alias("words"), a["units"].alias("units"))))).otherwise(a["done"])
    return F.aggregate(words, start, step, last)


def merge_tail(c: Column, least: int = MIN, most: int = MAX) -> Column:
    """A last chunk under least joins the one before if both hold at most most + 25 words."""
    last, before = F.try_element_at(c, F.lit(-1)), F.try_element_at(c, F.lit(-2))
    both = F.struct((last["words"] + before["words"]).alias("words"), (last["units"] + before["units"]).alias("units"))
    merge = (F.size(c) >= 2) & (last["words"] < least) & (both["words"] <= most + SLACK)
    return F.when(merge, F.concat(F.slice(c, F.lit(1), F.size(c) - 2), F.array(both))).otherwise(c)


def joined(some: Column) -> Column:
    """Units as text: headings stand alone, body units between them are joined by spaces."""
    start = F.struct(F.lit("").alias("text"), F.lit("heading").alias("kind"))
    gap = lambda a, u: F.when(a["text"] == "", "").when((a["kind"] == "body") & (u["kind"] == "body"), " ").otherwise("\n\n")
    return F.aggregate(some, start, lambda a, u: F.struct(F.concat(a["text"], gap(a, u), u["text"]).alias("text"), u["kind"].alias("kind")), lambda a: a["text"])


def chunks(docs: DataFrame, blocks: Column, key: str = "doc_id", target: int = TARGET, least: int = MIN, most: int = MAX) -> DataFrame:
    """key, ord, words, n_units, estimated_seconds and text of every chunk; blocks: an array of text blocks of docs."""
    # each step's value is bound once: units, then chunks before and after the tail is merged
    packed = lambda u: T.let(bins(F.transform(u, lambda x: x["words"]), target, least, most), lambda raw: F.struct(u.alias("units"), raw.alias("raw"), merge_tail(raw, least, most).alias("bins")))
    rows = docs.select(key, F.explode(F.array(T.let(units(blocks), packed))).alias("x")).select(key, "x.*")
    rows = rows.select(key, "units", "raw", F.size("raw").alias("n_raw"), F.size("bins").alias("n_bins"), F.posexplode("bins").alias("pos", "bin"))
    first = F.aggregate(F.slice("raw", F.lit(1), F.col("pos")), F.lit(0), lambda a, b: a + b["units"])
    # a merged chunk keeps the blank line between the two it joins
    own = F.when((F.col("n_raw") > F.col("n_bins")) & (F.col("pos") == F.col("n_bins") - 1), F.element_at("raw", F.lit(-2))["units"]).otherwise(F.col("bin.units"))
    rows = rows.withColumn("first", first).withColumn("own", own)
    text = F.concat(joined(F.slice("units", F.col("first") + 1, F.col("own"))), F.when(F.col("own") < F.col("bin.units"), F.concat(F.lit("\n\n"), joined(F.slice("units", F.col("first") + F.col("own") + 1, F.col("bin.units") - F.col("own"))))).otherwise(""))
    return rows.select(key, (F.col("pos") + 1).alias("ord"), F.col("bin.words").alias("words"), F.col("bin.units").alias("n_units"), T.seconds(F.col("bin.words")).alias("estimated_seconds"), text.alias("text"))


def manifest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks, words, seconds and minutes of each key."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.sum("words").alias("words"), F.sum("estimated_seconds").alias("estimated_seconds"))
    return out.withColumn("estimated_minutes", T.half_even(F.col("estimated_seconds") / F.lit(60.0), 2))


def totals(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks, seconds and minutes of each key, and of all (a null key)."""
    out = rows.rollup(key).agg(F.count(F.lit(1)).alias("chunks"), F.sum("estimated_seconds").alias("seconds"))
    return out.withColumn("minutes", T.half_even(F.col("seconds") / F.lit(60.0), 2))
