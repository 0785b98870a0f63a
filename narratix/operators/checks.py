"""Regression checks of outputs, and validation of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def status(passed: Column, expected: Column) -> Column:
    known = F.coalesce(expected, F.lit("pass")) == "known_fail"
    return F.when(known, F.when(passed, "RESOLVED").otherwise("KNOWN_FAIL")).otherwise(F.when(passed, "PASS").otherwise("FAIL"))


def evaluate(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each case's status against the output of its file: four predicates, all must hold; a missing file fails.

    cases: id, file, must_contain, must_not_contain, must_match_line, must_not_match_line, expected; outputs: file, text.
    """
    rows = cases.join(outputs.select("file", T.compact(F.col("text")).alias("_all"), T.nonempty(F.split("text", "\n")).alias("_lines")), "file", "left")
    has = lambda c: F.col("_all").contains(T.compact(F.col(c)))
    line = lambda c: F.exists("_lines", lambda x: F.regexp_like(x, F.concat(F.lit(r"\A(?:"), F.col(c), F.lit(r")\z"))))
    ok = F.col("_all").isNotNull()
    for c, test in (("must_contain", has("must_contain")), ("must_not_contain", ~has("must_not_contain")), ("must_match_line", line("must_match_line")), ("must_not_match_line", ~line("must_not_match_line"))):
        ok = ok & (F.col(c).isNull() | F.coalesce(test, F.lit(False)))
    return rows.withColumn("status", status(ok, F.col("expected"))).drop("_all", "_lines")


def validation_errors(c: Column) -> Column:
    """Errors of a refined summary as an array: paragraphs, banned patterns, lines like headings."""
    t = T.strip(c)
    body = T.sub(t, rf"(?s)\AThis is a quick overview of .*? by .*?\.{P.SPACE}*")
    n = F.size(T.nonempty(F.split(body, "\n\n")))
    head = F.exists(T.nonempty(F.split(t, "\n")), lambda x: (F.length(x) <= 80) & ~x.endswith(".") & ~x.endswith("?") & ~x.startswith("This is a quick overview"))
    found = [F.when(~n.between(2, 4), "paragraphs"), *(F.when(t.rlike(p), f"banned {k}") for k, p in enumerate(P.BANNED, 1)), F.when(head, "heading-like lines")]
    return F.when(t == "", F.array(F.lit("empty output"))).otherwise(F.array_compact(F.array(*found)))


def summary(results: DataFrame) -> DataFrame:
    """Cases by status, and whether the run fails: it does if any case does."""
    rows = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(F.broadcast(results.agg(F.coalesce(F.bool_or(F.col("status") == "FAIL"), F.lit(False)).alias("failed"))))
