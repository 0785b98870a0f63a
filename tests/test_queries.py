"""Every query against its SQL on the smallest tables; the others give rows."""

from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from narratix.plans import extra, more, more_sql, registry

QUERIES = registry.QUERIES | more.QUERIES | extra.QUERIES
ORACLE_SQL = registry.ORACLE_SQL | more_sql.sql(registry.LITERALS) | extra.ORACLE_SQL


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def alike(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_similar_literals(spark, sf):
    got = {(r["a_idx"], r["b_idx"]): round(r["similarity"], 9) for r in registry.jn_similar(spark, sf).where("doc_id = -1").collect()}
    every = [(k + 1, x) for k, x in enumerate(registry.LITERALS)]
    assert got == {(a, b): round(alike(x, y), 9) for (a, x), (b, y) in combinations(every, 2) if alike(x, y) > 0.6} and got


def test_repeats_of_all_lines(spark, sf):
    lines = [r for r in more.placed(spark, sf).collect() if r["line"]]
    groups = {}
    for r in lines:
        groups.setdefault((r["doc_id"], r["line_no"] % 2), []).append((r["line_no"], r["line"]))
    want = Counter()
    for (_, odd), group in groups.items():
        of = Counter(x for _, x in group)
        pairs = {frozenset((x, y)) for (_, x), (_, y) in combinations(sorted(group), 2) if x != y and alike(x, y) > 0.82}
        for x, n in of.items():
            others = n - 1 + sum(of[y] for p in pairs if x in p for y in p - {x})
            kind = "footer" if odd else "header"
            want[kind if others >= 2 else f"{kind}_candidate"] += n
    assert {r["type"]: r["n"] for r in more.jn_repeats(spark, sf).collect()} == dict(want)


@pytest.mark.parametrize("name", ["snk_published", "win_eta"])
def test_decimal_ties(spark, name):
    """Quotients whose shortest decimals end in 5 first occur among these events."""
    import duckdb

    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{at}/events.parquet')")
    assert rows(QUERIES[name](spark, at).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_regression_of_short_passages(spark, tmp_path):
    import duckdb

    texts = ["one two three four five six sevenfold eight nine", "tiny text", "", None, "a b c d e f g h i j"]
    passages = ["one two three four five six seven", "two three", "ne two thr", "tiny text", "", None, "text tiny", "a b c d e f g h", "b c d e f g h i j k", "c d e f g h i", "six sevenfold"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = rows(registry.chk_regression(spark, str(tmp_path)).toPandas())
    assert got == rows(con.execute(ORACLE_SQL["chk_regression"]).df()) and sum("FAIL" in x for x in got) == 3
