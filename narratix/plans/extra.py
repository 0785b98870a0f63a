"""Queries of operators on listings, reports, manifests and exports, each beside the SQL that it must agree with.

The driver's tables hold no files, pages or fonts: names, times and places are made of the ids of events, lines and turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, names
from ..functions import text as T
from ..operators import checks, chunks, elements, export, identity, manifest, narration, summary
from ..sources import select
from ..streaming import status
from . import more, more_sql, oracle
from .more import events
from .oracle import DOC_LINES, compact, count, has, norm_key, q, strip, sub
from .registry import chk_chunks, documents, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
EVENTS = "ev AS (SELECT event_id AS e, user_id, event_type, value FROM events)"


def agrees(sql: str | None):
    """Registers a query with its SQL; none where only a test on made tables can hold it to account."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@agrees(f"""WITH lines AS ({DOC_LINES}), w AS (SELECT doc_id, line_no, {strip('line')} AS message FROM lines)
  SELECT message, count(*) AS n FROM w WHERE message <> '' GROUP BY 1 ORDER BY n DESC, min(doc_id * 1000000 + line_no) LIMIT 20""")
def agg_warnings(spark, d):
    """The most frequent lines, as of a decoder's log; ties go to the first met."""
    rows = elements.warnings(documents(spark, d).select(F.col("doc_id").alias("page"), F.col("text").alias("log")))
    return elements.frequent_warnings(rows)


KINDS = f"""lines AS ({DOC_LINES}), el AS (SELECT doc_id, line_no, line, {oracle.text_class('line')} AS kind, CASE line_no % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'orphan_words' WHEN 2 THEN 'ocr_recovery' END AS source FROM lines),
  typed AS (SELECT doc_id, line_no, line, source, CASE WHEN kind = 'paragraph' AND source = 'ocr_recovery' THEN 'recovered_ocr_paragraph' WHEN line_no % 9 = 5 THEN 'footnote' ELSE kind END AS type FROM el)"""
UNSPOKEN = ", ".join(map(q, ("empty", *classify.SKIP)))


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Lines as elements of three sources (or none)."""
    rows = narration.lines(documents(spark, d))
    source = F.when(F.col("line_no") % 4 == 0, "block").when(F.col("line_no") % 4 == 1, "orphan_words").when(F.col("line_no") % 4 == 2, "ocr_recovery")
    kind = classify.text_class(F.col("line"))
    rows = rows.withColumn("source", source).withColumn("kind", kind)
    own = F.when((F.col("kind") == "paragraph") & (F.col("source") == "ocr_recovery"), "recovered_ocr_paragraph").when(F.col("line_no") % 9 == 5, "footnote").otherwise(F.col("kind"))
    return rows.select("doc_id", "line_no", F.col("line").alias("text"), "source", own.alias("type"))


@agrees(f"""WITH {KINDS} SELECT doc_id, line_no, type, CASE WHEN source = 'block' THEN 82 WHEN source = 'orphan_words' THEN 70 WHEN source = 'ocr_recovery' AND type = 'recovered_ocr_paragraph' THEN 68 WHEN source = 'ocr_recovery' THEN 62 ELSE 75 END AS confidence,
  coalesce(source = 'ocr_recovery', false) AS ocr, type NOT IN ({UNSPOKEN}) AS narrate FROM typed""")
def prj_final_flags(spark, d):
    rows = typed(spark, d)
    parts = [rows.where(F.col("source") == s) for s in ("block", "orphan_words", "ocr_recovery")] + [rows.where("source is null")]
    out = elements.sources(*parts).withColumn("narrate", elements.final_narrate(F.col("type")))
    return out.select("doc_id", "line_no", "type", F.bround(F.col("confidence") * 100).cast("int").alias("confidence"), F.coalesce("source_info.ocr", F.lit(False)).alias("ocr"), "narrate")


@agrees(f"""WITH {KINDS} SELECT 'type' AS section, type AS key, count(*) AS n, count(*) FILTER (WHERE type NOT IN ({UNSPOKEN})) AS narrated FROM typed GROUP BY 2
  UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*), count(*) FILTER (WHERE type NOT IN ({UNSPOKEN})) FROM typed GROUP BY 2""")
def agg_report(spark, d):
    return elements.report(typed(spark, d).withColumn("narrate", elements.final_narrate(F.col("type"))))


@agrees(f"""WITH {KINDS}, s AS (SELECT doc_id, line_no, type, source, line FROM typed ORDER BY doc_id, line_no LIMIT 180)
  SELECT doc_id, line_no AS idx, 'p001 | ' || left(rpad(type, 18, ' '), 18) || ' | narrate=' || CASE WHEN type NOT IN ({UNSPOKEN}) THEN 'True' ELSE 'False' END || ' | ' || coalesce(source, '') || ' | ' || left(line, 220) AS sample FROM s""")
def srt_samples(spark, d):
    rows = typed(spark, d).withColumn("narrate", elements.final_narrate(F.col("type"))).withColumn("page", F.lit(1)).withColumnRenamed("line_no", "idx")
    return elements.samples(rows).select("doc_id", "idx", "sample")


@agrees("""SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN false WHEN conv_id % 7 = 0 THEN true ELSE (turn + 1 BETWEEN 1 AND conv_id % 4) OR turn + 1 = 5 END AS wanted FROM conversations""")
def flt_pages(spark, d):
    """Pages where recognition is on: a switch, and lists with bad parts."""
    c = F.col("conv_id")
    spec = F.when(c % 7 == 0, "").otherwise(F.concat(F.lit("1-"), (c % 4).cast("string"), F.lit(", x, 7-y,, 5")))
    return turns(spark, d).select("conv_id", "turn", select.wanted_pages(F.col("turn") + 1, F.when(c % 5 == 0, " OFF "), spec).alias("wanted"))


NAMES = f"""{EVENTS}, files AS (SELECT user_id AS run, e, CASE e % 4 WHEN 0 THEN (e % 1000) || '.txt' WHEN 1 THEN 'x' || e || '.txt' WHEN 2 THEN e || '.wav' ELSE 'chapter_' || lpad(CAST(e % 12 AS VARCHAR), 3, '0') || '_' || event_type || e || '.json' END AS name FROM ev)"""


def listed(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("e")
    text = e.cast("string")
    name = F.when(e % 4 == 0, F.concat((e % 1000).cast("string"), F.lit(".txt"))).when(e % 4 == 1, F.concat(F.lit("x"), text, F.lit(".txt"))).when(e % 4 == 2, F.concat(text, F.lit(".wav")))
    return events(spark, d).select(F.col("user_id").alias("run"), "e", name.otherwise(F.concat(F.lit("chapter_"), F.lpad((e % 12).cast("string"), 3, "0"), F.lit("_"), F.col("event_type"), text, F.lit(".json"))).alias("name"))


@agrees(rf"""WITH {NAMES} SELECT run, name, CAST(regexp_extract(name, '^([0-9]+)', 1) AS BIGINT) AS number, CAST(row_number() OVER (PARTITION BY run ORDER BY CAST(regexp_extract(name, '^([0-9]+)', 1) AS BIGINT), name) AS INTEGER) AS ord FROM files WHERE regexp_matches(name, '^[0-9]+\.txt$')""")
def srt_numbered(spark, d):
    return select.numbered(listed(spark, d).select("run", "name"), select.CHUNK, "run")


@agrees(f"""WITH {NAMES}, f AS (SELECT run, CAST(substr(name, 9, 3) AS BIGINT) AS chapter, min(name) AS file FROM files WHERE name LIKE 'chapter%' GROUP BY 1, 2), c AS (SELECT DISTINCT user_id AS run, e % 12 AS chapter FROM ev)
  SELECT run, chapter, file FROM c LEFT JOIN f USING (run, chapter)""")
def jn_chapter_file(spark, d):
    chapters = events(spark, d).select(F.col("user_id").alias("run"), (F.col("e") % 12).alias("chapter")).distinct()
    return select.chapter_files(chapters, listed(spark, d), "run")


def _roots() -> str:
    a, b, c = norm_key("name"), norm_key("stem"), norm_key("root")
    return f"""WITH e AS (SELECT r_name AS name, lower(r_name) || '_a' AS stem FROM region), r AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'The ' ELSE '' END || r_name || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ' ' || n_name END AS root, n_nationkey * 7 % 25 AS mtime, n_nationkey % 5 <> 0 AS ready FROM nation JOIN region ON n_regionkey = r_regionkey),
  m AS (SELECT name, root, mtime, CASE WHEN {c} IN ({a}, {b}) THEN 2 ELSE 1 END AS class FROM e JOIN r ON ready AND ({c} IN ({a}, {b}) OR contains({c}, {a}) OR contains({c}, {b}))),
  best AS (SELECT name, root FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY class DESC, mtime DESC, root DESC) AS n FROM m) WHERE n = 1)
  SELECT name, coalesce(root, name) AS root FROM e LEFT JOIN best USING (name)"""


@agrees(_roots())
def srt_book_root(spark, d):
    """Folders named by regions and nations stand in for books of nearly the name."""
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    expected = region.select(F.col("r_name").alias("name"), F.concat(F.lower("r_name"), F.lit("_a")).alias("stem"))
    n = F.col("n_nationkey")
    root = F.concat(F.when(n % 3 == 0, "The ").otherwise(""), "r_name", F.when(n % 2 == 0, "").otherwise(F.concat(F.lit(" "), "n_name")))
    roots = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(root.alias("root"), (n * 7 % 25).alias("mtime"), (n % 5 != 0).alias("ready"))
    return select.book_root(expected, roots)


PATHS = ["/output/Book/chunks/chapter_006", "/output/Book/layout.json", "/output/Book", "/tmp/x", "chunks/a", "/a/wav/chapter_1.wav", "/o/books/books/x", "book.json"]


@agrees("SELECT * FROM (VALUES " + ", ".join(f"({q(p)}, {q(r) if r else 'NULL'})" for p, r in zip(PATHS, ["/output/Book", "/output/Book", "/output/Book", None, None, "/a", "/o", "."], strict=True)) + ") v(path, root)")
def prj_output_root(spark, d):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", select.output_root(F.col("path")).alias("root"))


@agrees(f"""WITH {EVENTS}, p AS (SELECT e, e % 97 AS s, CASE WHEN e % 6 > 0 THEN e % 89 END AS o, e % 1000 AS a, e % 313 AS b FROM ev)
  SELECT e AS event_id, CASE WHEN o >= s THEN 'skipped_existing' ELSE 'convert' END AS status, round_even(a / nullif(b, 0)::DOUBLE, 2) AS compression_ratio FROM (SELECT e, s, o, nullif(a, 0) AS a, b FROM p)""")
def snk_published(spark, d):
    e = F.col("e")
    pairs = events(spark, d).select(e.alias("event_id"), (e % 97).alias("source_mtime"), F.when(e % 6 > 0, e % 89).alias("output_mtime"), (e % 1000).alias("source_size"), (e % 313).alias("output_size"))
    return manifest.published(pairs).select("event_id", "status", "compression_ratio")


@agrees(f"""WITH {EVENTS}, p AS (SELECT e, row_number() OVER (PARTITION BY user_id ORDER BY e) - 1 AS c, count(*) OVER (PARTITION BY user_id) AS t, e % 1000 AS s FROM ev)
  SELECT e AS event_id, round_even(c * 100 / t::DOUBLE, 2) AS percent, round_even(s::DOUBLE, 2) AS stage_elapsed_seconds, CASE WHEN c > 0 AND c < t THEN round_even(s / c::DOUBLE * (t - c), 2) END AS eta_seconds FROM p""")
def win_eta(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    rows = events(spark, d).select(F.col("e").alias("event_id"), (F.row_number().over(own.orderBy("e")) - 1).alias("current"), F.count(F.lit(1)).over(own).alias("total"), F.lit(1000.0).alias("began"), (F.col("e") % 1000 + 1000.0).alias("now"))
    return status.eta(rows).select("event_id", "percent", "stage_elapsed_seconds", "eta_seconds")


COUNTS = f"""{EVENTS}, made AS (SELECT user_id AS chapter, count(*) AS chunks, count(*) FILTER (WHERE e % 3 = 0) AS existing FROM ev GROUP BY 1)"""


@agrees(f"WITH {COUNTS} SELECT chapter, chunks, existing, chunks - existing AS to_render, existing AS skipped FROM made")
def agg_render(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("chapter"), F.col("e").alias("ord"))
    return manifest.render_counts(rows, rows.where("ord % 3 = 0"), ["chapter", "ord"], "chapter")


@agrees(f"""WITH {COUNTS} SELECT chapter % 10 AS run, count(*) AS chapters, CAST(sum(chunks) AS BIGINT) AS chunks_total, CAST(sum(chunks - existing) AS BIGINT) AS chunks_rendered, CAST(sum(existing) AS BIGINT) AS chunks_reused,
  round_even(CAST(sum(CASE WHEN chapter % 3 > 0 THEN chunks * 0.25 ELSE 0 END) AS DOUBLE), 2) AS audio_seconds FROM made GROUP BY 1""")
def agg_book_totals(spark, d):
    seconds = F.when(F.col("chapter") % 3 > 0, F.col("chunks") * F.lit(0.25))
    reports = agg_render(spark, d).select((F.col("chapter") % 10).alias("run"), "chunks", F.col("to_render").alias("rendered"), F.nullif("skipped", F.lit(0)).alias("skipped"), seconds.alias("seconds"))
    return manifest.book_totals(reports)


@agrees(f"WITH r AS ({more_sql.sql([])['chk_cases']}) SELECT status, count(*) AS n, (SELECT coalesce(bool_or(status = 'FAIL'), false) FROM r) AS failed FROM r GROUP BY 1")
def chk_summary(spark, d):
    return checks.summary(more.chk_cases(spark, d))


@agrees("""SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'T1 ' || lang WHEN doc_id % 7 = 0 THEN NULL END, CASE WHEN doc_id % 3 = 0 THEN 'T2' END, CASE WHEN doc_id % 11 = 0 THEN 'T3' END, CASE WHEN doc_id % 13 = 0 THEN 'T4' END, source) AS title,
  coalesce(CASE WHEN doc_id % 10 = 0 THEN 'S1' END, CASE WHEN doc_id % 22 = 0 THEN 'S3' END, '') AS subtitle, coalesce(CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'A2' END, '') AS author FROM documents""")
def jn_identity_chain(spark, d):
    """Names from identity, book, manifest and chunk manifest, then the folder."""
    k, rows = F.col("doc_id"), read(spark, d, "documents").select("doc_id", "lang", "source")
    when = lambda n, v: F.when(k % n == 0, v)
    first = rows.where("doc_id % 5 = 0 or doc_id % 7 = 0").select("doc_id", when(5, F.concat(F.lit("T1 "), "lang")).otherwise("  ").alias("title"), when(10, "S1").alias("subtitle"))
    book = rows.where("doc_id % 3 = 0").select("doc_id", F.lit("T2").alias("title"), F.when(k % 2 == 1, "A2").otherwise("").alias("author"))
    old = rows.where("doc_id % 11 = 0").select("doc_id", F.lit("T3").alias("title"), when(22, "S3").alias("subtitle"))
    chunk = rows.where("doc_id % 13 = 0").select("doc_id", F.lit("T4").alias("title"))
    return identity.chain(rows.select("doc_id", F.col("source").alias("folder")), first, book, old, chunk)


FILES = ["book.json", "books/a_{}.wav", "books/a_{}_full.wav", "books/a_{}.mp3", "chunks/chapter_1/{}.txt", "wav/chapter_1/{}.wav", "chapters_audio/chapter_{}.wav", "books/a_{}.m4b", "layout.json", "reports/pipeline_status.json", "books/a_{}.json", "books/a_{}.metadata.json"]
FILE_SQL = f"{EVENTS}, files AS (SELECT user_id AS run, CASE e % 13 " + " ".join(f"WHEN {k} THEN replace({q(p)}, '{{}}', lpad(CAST(e // 26 AS VARCHAR), 9, '0'))" for k, p in enumerate(FILES)) + " ELSE 'other' END AS path, value FROM ev)"


def book_files(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("e")
    path = F.lit("other")
    for k, p in enumerate(FILES):
        path = F.when(e % 13 == k, F.replace(F.lit(p), F.lit("{}"), F.lpad((e / 26).cast("long").cast("string"), 9, "0"))).otherwise(path)
    return events(spark, d).select(F.col("user_id").alias("run"), path.alias("path"), "value")


def _outputs() -> str:
    last = lambda p: f"max(CASE WHEN {has('path', p)} THEN path END)"
    number = lambda p: f"count(*) FILTER (WHERE {has('path', p)})"
    flags = ", ".join(f"bool_or(path = {q(p)}) AS has_{n}" for n, p in manifest.OUTPUTS.items())
    return rf"""WITH {FILE_SQL} SELECT run, {flags}, {number(r'^chapters_audio/chapter_')} AS chapters_audio_files, {number(r'^chunks/.*txt$')} AS chunk_text_files, {number(r'^wav/')} AS chunk_wav_files,
  coalesce({last(r'^books/.*_full\.wav$')}, {last(r'^books/.*\.wav$')}) AS book_wav, {last(r'\.mp3$')} AS book_mp3, {last(r'\.m4b$')} AS book_m4b FROM files GROUP BY 1"""


@agrees(_outputs())
def man_outputs(spark, d):
    return manifest.outputs(book_files(spark, d))


@agrees(rf"""WITH {FILE_SQL}, d AS (SELECT DISTINCT run, path FROM files), s AS (SELECT run, path, regexp_replace(path, '\.(mp3|metadata\.json|json)$', '') AS stem FROM d)
  SELECT m.run, m.path, a.path AS report_file, CASE WHEN a.path IS NULL THEN NULL ELSE 'converted' END AS status, b.path AS metadata_report_file FROM s m LEFT JOIN s a ON a.run = m.run AND a.path = m.stem || '.json' LEFT JOIN s b ON b.run = m.run AND b.path = m.stem || '.metadata.json' WHERE m.path LIKE '%.mp3'""")
def jn_deliverables(spark, d):
    files = book_files(spark, d).select("run", "path").distinct()
    reports = files.where(F.col("path").endswith(".json")).withColumn("status", F.lit("converted")).withColumn("compression_ratio", F.lit(1.0))
    return manifest.deliverables(files, reports).select("run", "path", "report_file", "status", "metadata_report_file")


@agrees(f"""WITH {EVENTS}, s AS (SELECT user_id AS run, arg_max(value, e) AS s FROM ev WHERE e % 7 = 0 GROUP BY 1), r AS (SELECT DISTINCT user_id AS run, 1.5 AS r FROM ev WHERE user_id % 2 = 0)
  SELECT run, coalesce(s, CAST(r AS DOUBLE)) AS audio_seconds FROM s FULL JOIN r USING (run)""")
def jn_audio_seconds(spark, d):
    rows = events(spark, d)
    stages = rows.select(F.col("user_id").alias("run"), F.col("e").alias("ord"), F.when(F.col("e") % 7 == 0, F.col("value")).alias("audio_seconds"))
    return manifest.audio_seconds(stages, rows.where("user_id % 2 = 0").select(F.col("user_id").alias("run"), F.lit(1.5).alias("audio_seconds")).distinct())


@agrees("SELECT conv_id, string_agg(chr(10) || chr(10) || '===== PAGE ' || (turn + 1) || ' =====' || chr(10) || chr(10) || text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def snk_transcript(spark, d):
    return export.transcript(turns(spark, d).select("conv_id", (F.col("turn") + 1).alias("page"), "text"), "conv_id")


def _page_speech() -> str:
    def left(c):
        one = f"list_transform([{oracle.clean_text(c)}], lambda t: CASE WHEN {compact('t')} = '' OR {oracle.speech_marker('t')} THEN '' ELSE t END)[1]"
        return one

    skip = ", ".join(map(q, classify.SKIP))
    return f"""WITH lines AS ({DOC_LINES}), el AS (SELECT doc_id, line_no, line, CASE line_no % 7 WHEN 0 THEN 'footnote' WHEN 1 THEN 'heading' WHEN 2 THEN 'url' ELSE 'paragraph' END AS type, CASE WHEN line_no % 11 > 0 THEN true WHEN line_no % 2 = 0 THEN false END AS narrate FROM lines),
  a AS (SELECT doc_id, line_no, type, {left('line')} AS s FROM el WHERE coalesce(narrate, true) AND type NOT IN ({skip})),
  b AS (SELECT doc_id, line_no, CASE WHEN type = 'footnote' AND NOT {has('s', chr(92) + 'A(?i)footnote' + chr(92) + '.')} THEN 'Footnote. ' || s ELSE s END AS s FROM a WHERE s <> ''), c AS (SELECT doc_id, line_no, {left('s')} AS s FROM b)
  SELECT doc_id, string_agg(s, chr(10) || chr(10) ORDER BY line_no) AS text FROM c WHERE s <> '' GROUP BY 1"""


@agrees(_page_speech())
def nar_page_speech(spark, d):
    n = F.col("line_no")
    kind = F.when(n % 7 == 0, "footnote").when(n % 7 == 1, "heading").when(n % 7 == 2, "url").otherwise("paragraph")
    rows = narration.lines(documents(spark, d)).select("doc_id", n.alias("idx"), kind.alias("type"), F.lit("").alias("normalized_text"), F.col("line").alias("text"), F.when(n % 11 > 0, True).when(n % 2 == 0, False).alias("narrate"))
    return export.page_speech(rows, "doc_id")


@agrees(rf"""SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: {strip('p')}), lambda p: p <> ''), lambda p: {oracle.normalize_paragraph('p')}), lambda p: NOT {oracle.cleaner_marker('p')}), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL""")
def nar_plain(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", export.plain_narration(F.col("text")).alias("text"))


@agrees(None)
def nar_export(spark, d):
    """Raw and final narration of documents as chapters whose elements are their lines."""
    rows = narration.lines(documents(spark, d)).select("doc_id", F.col("line_no").alias("idx"), classify.text_class(F.col("line")).alias("type"), F.col("line").alias("raw_text"), F.lit("").alias("normalized_text"), F.lit("").alias("text"), F.lit(True).alias("narrate"))
    rows = rows.withColumn("normalized_text", F.col("raw_text"))
    return export.narration_files(rows, documents(spark, d).select("doc_id", F.lit("A Title of Mine").alias("title")), "doc_id")


@agrees(None)
def lay_page(spark, d):
    """Pages of words made of events, some inside blocks."""
    w = more.words(spark, d).drop("line").withColumn("page", F.col("page").cast("int")).withColumn("ord", F.col("ord").cast("long"))
    blocks = more.boxes(spark, d).select("doc_id", F.col("page").cast("int").alias("page"), F.col("idx").alias("ord"), "text", "x0", "y0", "x1", "y1")
    pages = w.select("doc_id", "page").distinct().select("*", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    out = elements.page_layout(pages, blocks, w)
    return out.select("doc_id", "page", "id", "type", "text", F.bround(F.col("confidence") * 100).cast("int").alias("confidence"), "source", "narrate")


def _priors() -> str:
    t = "v"
    tidy = sub(t, r"\A[ |]+|[ |]+\z")
    plausible = rf"(length({tidy}) BETWEEN 2 AND 120 AND {count(tidy, oracle.P.LETTER)} >= 2 AND NOT {oracle.noise(tidy)} AND NOT {has(tidy, '(?i)' + oracle.P.B + '(?:chapter|contents|preface|acknowledg|references|bibliography|index)' + oracle.P.B)})"
    return f"""WITH lines AS ({DOC_LINES}), f AS (SELECT doc_id * 100000 + line_no AS doc_id, lang, {compact('line')} AS v FROM lines JOIN documents USING (doc_id)), c AS (
  SELECT doc_id, 'title' AS field, v AS value, 42 AS score FROM f WHERE v <> '' UNION ALL SELECT doc_id, 'subtitle', lang, 50 FROM f WHERE lang <> '' UNION ALL SELECT doc_id, 'author', 'Jane Doe', 62 FROM f WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'title', v, 60 FROM f WHERE {plausible} UNION ALL SELECT doc_id, 'author', v, 75 FROM f WHERE {oracle.person(tidy)} AND v <> '')
  SELECT doc_id, field, value, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, field, value) AS INTEGER) AS place FROM c"""


@agrees(_priors())
def idn_priors(spark, d):
    """Each line as the title of a book of its own."""
    rows = narration.lines(read(spark, d, "documents").select("doc_id", "text")).join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.select((F.col("doc_id") * 100000 + F.col("line_no")).alias("doc_id"), "lang", T.compact(F.col("line")).alias("v"))
    artifacts = rows.select("doc_id", F.col("v").alias("title"), F.col("lang").alias("subtitle"), F.when(F.col("doc_id") % 2 == 0, "Jane Doe").otherwise("").alias("author"))
    found = identity.top(identity.priors(artifacts, rows.select("doc_id", F.col("v").alias("title"), F.col("v").alias("author"))))
    return found.select("doc_id", "field", "value", F.bround(F.col("confidence") * 100).cast("int").alias("score"), "place")


@agrees(None)
def idn_resolved(spark, d):
    """Titles, subtitles and authors from all four sources."""
    rows = read(spark, d, "documents").select("doc_id", "lang", "source", "text")
    null = F.lit(None).cast("double")
    lines = narration.lines(rows.where("doc_id % 3 > 0")).select("doc_id", F.col("line_no").alias("ord"), T.compact(F.col("line")).alias("text"), F.lit(1).alias("page"), (F.col("line_no") % 9 + 4.0).alias("font_size"), null.alias("y_ratio"), null.alias("center_x_ratio"))
    artifacts = rows.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("lang")).alias("title"), F.lit("").alias("subtitle"), F.lit("").alias("author"))
    metadata = rows.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "A Fine Book").alias("title"), F.when(F.col("doc_id") % 2 == 0, "Jane Doe").alias("author"))
    return identity.resolved(lines, artifacts, metadata, rows.select("doc_id", F.col("source").alias("folder")))


@agrees(f"""WITH lines AS ({DOC_LINES}), s AS (SELECT doc_id, line_no, line FROM lines WHERE {count('line', oracle.P.TOKEN)} BETWEEN 1 AND 3)
  SELECT doc_id, count(*) AS n, array_to_string(list(line ORDER BY line_no)[1:8], ' | ') AS first FROM s GROUP BY 1""")
def agg_fragments(spark, d):
    out = elements.fragments(narration.lines(documents(spark, d)).select("doc_id", F.col("line_no").alias("idx"), F.col("line").alias("text")))
    return out.select("doc_id", "n", F.array_join("first", " | ").alias("first"))


@agrees(f"WITH {EVENTS} SELECT user_id AS run, -1 AS ord, 'front_matter.wav' AS path FROM (SELECT DISTINCT user_id FROM ev) UNION ALL SELECT user_id, e, 'chapter_' || e || '.wav' FROM ev WHERE e % 2 = 0")
def set_front_first(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("run"), F.col("e").alias("ord"))
    chapters = rows.where("ord % 2 = 0").withColumn("path", F.concat(F.lit("chapter_"), F.col("ord").cast("string"), F.lit(".wav")))
    return export.front_first(rows.select("run").distinct().withColumn("path", F.lit("front_matter.wav")), chapters)


@agrees("SELECT conv_id, turn FROM conversations WHERE turn IN (1, 3)")
def flt_chapters(spark, d):
    wanted = spark.createDataFrame([(1,), (3,), (3,)], "turn long")
    return export.wanted_chapters(turns(spark, d), wanted, "turn").select("conv_id", "turn")


@agrees(f"SELECT conv_id, string_agg({strip('text')}, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE role <> 'user' AND turn % 3 > 0 AND {strip('text')} <> '' GROUP BY 1")
def sum_draft(spark, d):
    text = F.when(F.col("turn") % 3 > 0, F.col("text"))
    return export.draft(turns(spark, d).where("role <> 'user'").select("conv_id", F.col("turn").alias("ord"), text.alias("text")), "conv_id")


#: Every third turn is a part without text, every fifth book has no title, every second no author.
PROMPT_SQL = f"""parts AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, count(*) OVER (PARTITION BY conv_id) AS total, CASE WHEN turn % 3 > 0 THEN {strip('text')} ELSE '' END AS t FROM conversations),
  prompts AS (SELECT conv_id, ord, ord || '/' || total || ' of ' || CASE WHEN conv_id % 5 = 0 THEN 'book ' || conv_id ELSE 'A {{title}} ' || conv_id END || ' by ' || CASE WHEN conv_id % 2 = 0 THEN 'Unknown Author' ELSE 'Jane Doe' END || ': ' || t AS prompt FROM parts WHERE t <> '')"""


def book_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, t = F.col("conv_id"), F.col("turn")
    parts = turns(spark, d).select("conv_id", F.concat(F.lit("narration_"), t.cast("string"), F.lit(".txt")).alias("name"), F.when(t % 3 > 0, F.col("text")).alias("text"))
    names = [F.when(c % 5 > 0, F.concat(F.lit("A {title} "), c.cast("string"))).alias("title"), F.when(c % 2 > 0, "Jane Doe").otherwise(" ").alias("author"), F.concat(F.lit("book "), c.cast("string")).alias("folder")]
    return parts, parts.select("conv_id").distinct().select("conv_id", *names)


@agrees(f"WITH {PROMPT_SQL} SELECT conv_id, ord, prompt FROM prompts")
def sum_prompts(spark, d):
    return summary.draft_prompts(*book_parts(spark, d), "conv_id", template="{number}/{total} of {title} by {author}: {text}")


@agrees(f"WITH {PROMPT_SQL} SELECT conv_id, string_agg('It has ' || length(prompt) || ' signs.', chr(10) || chr(10) ORDER BY ord) AS text FROM prompts GROUP BY 1")
def sum_quick_draft(spark, d):
    """Prompts to a provider that tells their lengths, and its answers to drafts."""
    return summary.quick_draft(*book_parts(spark, d), lambda: lambda p: f"# It has {len(p)} signs.\nSummary\n", "conv_id", template="{number}/{total} of {title} by {author}: {text}")


@agrees("""SELECT conv_id, turn, 'books/' || folder || '_' || label || '.wav' AS wav, 'books/' || folder || CASE WHEN label = 'full' THEN '' ELSE '_' || label END || '.mp3' AS mp3, CASE WHEN turn % 4 = 0 THEN 'force regenerate' WHEN turn % 4 = 1 THEN 'stitch only' WHEN turn % 4 = 2 THEN 'render chunks only' ELSE 'resume / reuse existing' END AS mode
  FROM (SELECT conv_id, turn, 'Book ' || conv_id AS folder, CASE conv_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'chapter_' || lpad(CAST(turn + 1 AS VARCHAR), 3, '0') ELSE 'chapters_' || list_aggregate(list_transform(range(turn + 1, turn + 7), lambda k: lpad(CAST(k AS VARCHAR), 3, '0')), 'string_agg', '_') || '_plus' END AS label FROM conversations)""")
def prj_paths(spark, d):
    c, t = F.col("conv_id"), F.col("turn").cast("int")
    wanted = F.when(c % 3 == 0, F.array().cast("array<int>")).when(c % 3 == 1, F.array(t + 1)).otherwise(F.sequence(t + 1, t + 8))
    folder, label = F.concat(F.lit("Book "), c.cast("string")), names.chapter_label(wanted)
    mode = names.mode_label(t % 4 == 0, t % 4 == 1, t % 4 == 2)
    return turns(spark, d).select("conv_id", "turn", names.book_path(folder, label).alias("wav"), names.book_path(folder, label, ".mp3").alias("mp3"), mode.alias("mode"))


@agrees(f"""WITH lines AS ({DOC_LINES}) SELECT doc_id, line_no AS idx, round_even(line_no / 7.0::DOUBLE, 2) AS x0, round_even(line_no / 3.0::DOUBLE + 1, 2) AS y1, left({strip('line')}, 300) AS preview FROM lines""")
def prj_debug(spark, d):
    n = F.col("line_no")
    rows = narration.lines(documents(spark, d)).select("doc_id", F.lit(1).alias("page"), n.alias("idx"), F.col("line").alias("text"), (n / F.lit(7.0)).alias("x0"), (n / F.lit(3.0)).alias("y0"), (n / F.lit(7.0) + 1).alias("x1"), (n / F.lit(3.0) + 1).alias("y1"))
    return elements.debug(rows).select("doc_id", "idx", "x0", "y1", "preview")


@agrees(f"WITH RECURSIVE c AS ({oracle.sql([''])['chk_chunks'].replace('WITH RECURSIVE ', 'WITH RECURSIVE ', 1)}) SELECT coalesce(c.doc_id, -1) AS doc_id, count(*) AS chunks, CAST(sum(estimated_seconds) AS BIGINT) AS seconds, round_even(sum(estimated_seconds) / 60.0::DOUBLE, 2) AS minutes FROM c GROUP BY ROLLUP (c.doc_id)")
def agg_chunk_totals(spark, d):
    """The total of all stands under -1."""
    return chunks.totals(chk_chunks(spark, d)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))


@agrees("SELECT a.conv_id AS doc_id, a.turn AS page, coalesce(b.text, '') AS raw_text FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.role = 'user'")
def jn_layout_text(spark, d):
    rows = turns(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", "text")
    return elements.with_text(rows.select("doc_id", "page"), rows.where("role = 'user'")).select("doc_id", "page", "raw_text")


@agrees(f"WITH {EVENTS} SELECT e AS event_id, CASE WHEN e % 5 > 0 THEN (e % 100 + 15) / 600.0::DOUBLE END AS center_x_ratio, CASE WHEN e % 7 > 0 THEN (e % 90) / 800.0::DOUBLE END AS y_ratio, CASE WHEN e % 5 > 0 THEN 30 / 600.0::DOUBLE END AS width_ratio FROM ev")
def prj_geometry(spark, d):
    e = F.col("e")
    x, y = (e % 100).cast("double"), (e % 90).cast("double")
    box = elements.geometry(x, y, x + 30, y + 10, F.when(e % 5 > 0, 600.0).otherwise(0.0), F.when(e % 7 > 0, 800.0).otherwise(0.0))
    return events(spark, d).select(e.alias("event_id"), box.alias("b")).select("event_id", "b.*")


@agrees(f"""WITH {FILE_SQL}, p AS (SELECT run, path FROM files UNION ALL SELECT DISTINCT run, 'manifest.json' FROM files UNION ALL SELECT DISTINCT run, 'chapters/chapter_001_a.json' FROM files UNION ALL SELECT DISTINCT run, 'narration/narration_001.txt' FROM files WHERE run % 2 = 0)
  SELECT run, run % 2 = 0 AND bool_or(path = 'book.json') AS ready FROM p GROUP BY 1""")
def src_ready(spark, d):
    files = book_files(spark, d).select("run", "path")
    runs = files.select("run").distinct()
    more_files = [runs.withColumn("path", F.lit(p)) for p in ("manifest.json", "chapters/chapter_001_a.json")] + [runs.where("run % 2 = 0").withColumn("path", F.lit("narration/narration_001.txt"))]
    for m in more_files:
        files = files.unionByName(m)
    return select.ready(files, "run")
