"""The rules on rows made to hit them."""

import re
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from narratix.functions import classify, markers
from narratix.functions import text as T
from narratix.operators import chapters, checks, chunks, identity, layout, manifest, narration, summary
from narratix.sources import readers
from pyspark.sql import functions as F


def one(spark, expr, *values):
    frame = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in enumerate(values)))
    return frame.select(expr(*(F.col(c) for c in frame.columns)).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "clean", "strict"), [("2", True, True), ("1982", True, True), ("1988 2008", True, True), ("1.1 1988 2008", True, True), ("( 1968 )", True, True), ("1 9 8 2", True, True), ("He had 3 apples.", False, True), ("In 1968, he left", False, True), ("In 1968, he left.", False, False), ("Fig. 1.1 Photograph of X", False, False), ("", True, True)])
def test_markers(spark, text, clean, strict):
    assert one(spark, markers.cleaner, text) is clean
    assert one(spark, lambda c: markers.narration(c, strict=True), text) is strict


@pytest.mark.parametrize(("text", "kind"), [("42", "page_number"), ("https://a.b", "url"), ("© 2020 X", "footer"), ("Fig. 2 A", "figure_caption"), ("12.5, 7", "extraction_artifact"), ("see doi 10.1234/x", "doi"), (" ", "empty"), ("Prose here.", "paragraph")])
def test_class(spark, text, kind):
    assert one(spark, classify.text_class, text) == kind


def test_sentences(spark):
    assert one(spark, T.sentences, 'See Fig. 2 now. Then e.g. This ends etc. Next? "Yes." Été.') == ["See Fig. 2 now.", "Then e.g. This ends etc. Next?", '"Yes." Été.']


def test_bins(spark):
    pack = lambda *w: [tuple(x) for x in spark.range(1).select(chunks.merge_tail(chunks.bins(F.array(*map(F.lit, w)))).alias("x")).first()["x"]]
    assert pack(60, 30, 30, 10) == [(60, 1), (70, 3)]
    assert pack(200) == [(200, 1)]
    assert pack(100, 30) == [(130, 2)]
    assert pack(110, 30) == [(110, 1), (30, 1)]


def fold(words):
    out = []
    for w in words:
        if out and not ((sum(out[-1]) >= 50 and sum(out[-1]) + w > 85) or sum(out[-1]) + w > 110):
            out[-1].append(w)
        else:
            out.append([w])
    if len(out) > 1 and sum(out[-1]) < 50 and sum(out[-1]) + sum(out[-2]) <= 135:
        out[-2:] = [out[-2] + out[-1]]
    return [(sum(x), len(x)) for x in out]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 130), max_size=30), min_size=1, max_size=30))
def test_bins_like_a_loop(spark, many):
    frame = spark.createDataFrame([(k, w) for k, w in enumerate(many)], "k int, w array<int>")
    got = frame.select("k", chunks.merge_tail(chunks.bins(F.col("w"))).alias("b")).collect()
    assert {r["k"]: [tuple(x) for x in r["b"]] for r in got} == {k: fold(w) for k, w in enumerate(many)}


def test_chunk_text(spark):
    docs = spark.createDataFrame([(1, ["A Title", "One two. " * 30, "Tail here now."]), (2, [])], "doc_id long, b array<string>")
    got = chunks.chunks(docs, F.col("b")).collect()
    assert {r["doc_id"] for r in got} == {1} and got[0]["text"].startswith("A Title\n\nOne two. One two.")
    assert " ".join(" ".join(r["text"].split()) for r in got) == "A Title " + " ".join(["One two."] * 30) + " Tail here now."


def test_small_functions(spark):
    assert [one(spark, lambda c: T.seconds(c), float(n)) for n in (0, 1, 160)] == [1, 1, 60]
    assert one(spark, T.range_list, "1-3,6,2,x,9-7") == [1, 2, 3, 6]
    assert one(spark, T.clock, 3725.0) == "01:02:05" and one(spark, T.clock, 65.0) == "01:05"
    assert one(spark, T.footnote, "12) Some note") == "Footnote 12. Some note"
    assert one(spark, T.clean_for_speech, "### **Summary:** A *b*\n<think>x</think>") == "A b"
    assert one(spark, lambda c: summary.clean(c), "ﬁne") == "fine"
    assert one(spark, lambda c: T.merge_lines(F.split(c, "\n")), "the galler-\nies are\nopen") == "the galleries are open"
    assert one(spark, summary.quick_part, "Summary: x\n1. y\nKeep this\nNotes:\nand this") == "Keep this and this"


def test_summary_errors(spark):
    assert len(one(spark, checks.validation_errors, "this paper says so.")) >= 2
    assert one(spark, checks.validation_errors, "") == ["empty output"]
    assert one(spark, checks.validation_errors, "One.\n\nTwo.") == []


def test_refine(spark):
    prompts = spark.createDataFrame([("a", "good", "fix", "This is a quick overview of X by Y."), ("b", "bad", "good", "This is a quick overview of X by Y.")], "key string, prompt string, repair string, intro string")
    provider = lambda: lambda p: "One.\n\nTwo." if p.startswith("good") else "this paper is bad"
    got = {r["key"]: r for r in summary.refine(prompts, provider).collect()}
    assert got["a"]["attempts"] == 1 and got["b"]["attempts"] == 2 and not got["b"]["errors"]


def test_retell(spark):
    parts = spark.createDataFrame([(1, "narration_10.txt", "ten"), (1, "narration_2.txt", " two {title} "), (1, "narration_1.txt", " "), (2, "narration_1.txt", None)], "book long, name string, text string")
    books = spark.createDataFrame([(1, " ", None, "folder"), (2, "T", "A", "f")], "book long, title string, author string, folder string")
    prompts = summary.draft_prompts(parts, books, "book", template="{number}/{total} {title}, {author}: {text}").orderBy("ord").collect()
    assert [r["prompt"] for r in prompts] == ["2/3 folder, Unknown Author: two {title}", "3/3 folder, Unknown Author: ten"]
    told = summary.quick_draft(parts, books, lambda: lambda p: f"Key themes\n{p.split()[-1]} is told.", "book")
    assert [tuple(r) for r in told.collect()] == [(1, "{title} is told.\n\nten is told.")]
    provider = lambda: lambda p: "One.\n\nTwo." if p.startswith("Rewrite") else "this paper is bad"
    assert [(r["key"], r["attempts"], r["errors"], r["text"].split("\n")[0]) for r in summary.retell(told, books, provider, "book").collect()] == [(1, 2, [], "This is a quick overview of folder by Unknown Author.")]
    assert summary.retell(told, books, lambda: lambda p: "", "book", attempts=2).first()["errors"]


def test_regression_statuses(spark):
    cases = spark.createDataFrame([("1", "f", "a b", None, None, None, None), ("2", "f", "zz", None, None, None, "known_fail"), ("3", "f", None, None, None, r"2", None), ("4", "f", None, "zz", "x+", None, "known_fail"), ("5", "g", "a", None, None, None, None)], "id string, file string, must_contain string, must_not_contain string, must_match_line string, must_not_match_line string, expected string")
    outputs = spark.createDataFrame([("f", "a\n b\nxx\n2")], "file string, text string")
    assert {r["id"]: r["status"] for r in checks.evaluate(cases, outputs).collect()} == {"1": "PASS", "2": "KNOWN_FAIL", "3": "FAIL", "4": "RESOLVED", "5": "FAIL"}


def test_chapters(spark):
    toc = spark.createDataFrame([(1, 0, 1, 3, "a"), (1, 1, 1, 10, "b"), (1, 2, 1, 10, "c"), (1, 3, 2, 11, "deep")], "book int, idx int, level int, page int, title string")
    totals = spark.createDataFrame([(1, 12), (2, 4)], "book int, total_pages int")
    got = chapters.ranges(toc, totals)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a", 3, 9), (1, 2, "b", 10, 9), (1, 3, "c", 10, 12), (2, 1, "Full Book", 1, 4)]
    pages = spark.createDataFrame([(1, p, 10, f"p{p}") for p in range(1, 13)], "book int, page int, words long, text string")
    assert {(r["book"], r["chapter"]): r["word_count"] for r in chapters.words(pages, got).collect()} == {(1, 1): 70, (1, 2): 0, (1, 3): 30, (2, 1): 0}
    assert {r["chapter"]: r["text"] for r in chapters.text(pages, got).where("book = 1").collect()}[3] == "p10\n\np11\n\np12"


def test_layout(spark):
    words = spark.createDataFrame([(1, 1, k, w, x, y, x + 20, y + 10) for k, (w, x, y) in enumerate([("b", 40.0, 10.5), ("a", 10.0, 10.0), ("c", 10.0, 24.0), ("d", 10.0, 80.0)])], "doc_id long, page long, ord long, text string, x0 double, y0 double, x1 double, y1 double")
    got = layout.lines(layout.cluster_lines(words))
    assert [r["text"] for r in got.orderBy("y0").collect()] == ["a b", "c", "d"]
    rows = got.withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0)).withColumn("text", F.concat("text", F.lit(".")))
    assert [r["text"] for r in layout.merged(layout.paragraphs(rows)).orderBy("y0").collect()] == ["a b. c.", "d."]
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 40.0)], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in layout.orphans(words, boxes).collect()] == ["d"]


def test_repeats_and_similarity(spark):
    rows = spark.createDataFrame([(1, f"p{k}", "header_candidate", t) for k, t in enumerate(["My Book 1", "My Book 2", "My Book 3", "Other"])], "doc_id long, id string, type string, text string")
    assert {r["text"]: r["type"] for r in layout.promote_repeats(rows).collect()} == {"My Book 1": "header", "My Book 2": "header", "My Book 3": "header", "Other": "header_candidate"}
    texts = [(1, k, "abcdefgh"[: 3 + k % 6] * (1 + k % 4) + str(k % 3)) for k in range(40)]
    for t in (0.6, 0.9):
        got = {(r["a_idx"], r["b_idx"]) for r in layout.similar_pairs(spark.createDataFrame(texts, "doc_id long, idx long, text string"), ["doc_id"], t).collect()}
        assert got == {(a, b) for _, a, x in texts for _, b, y in texts if a < b and SequenceMatcher(None, x, y).ratio() > t}
    assert layout.ratio("tide", "diet") == 0.25 and layout.ratio("diet", "tide") == 0.5


def test_headings(spark):
    rows = spark.createDataFrame([(1, 1, 0, "Computers as Creative Tools"), (1, 1, 1, "Creative Tools"), (1, 1, 2, "Computers as Creative Tools"), (1, 2, 3, "Creative Tools")], "doc_id long, page long, idx long, text string")
    assert [r["idx"] for r in layout.heading_fragments(rows).collect()] == [1]


def test_identity(spark):
    lines = spark.createDataFrame([(1, 0, "The Art of Machines", 1, 30.0, 0.3, 0.5), (1, 1, "How Computers Learned to Paint Well", 1, 24.0, 0.4, 0.5), (1, 2, "by Jane Doe", 1, 14.0, 0.6, 0.5), (1, 3, "Springer Press", 1, 10.0, 0.9, 0.5)], "doc_id long, ord long, text string, page int, font_size double, y_ratio double, center_x_ratio double")
    got = {r["field"]: r["value"] for r in identity.select(identity.candidates(lines)).collect()}
    assert got["title"] == "The Art of Machines" and got["author"] == "Jane Doe" and got["subtitle"] == "How Computers Learned to Paint Well"


def test_titles(spark):
    parts = spark.createDataFrame([(["My Title", "A Short Subtitle", "My title!", "Body text goes on."],)], "b array<string>")
    got = parts.select(narration.punctuate(narration.with_title(F.col("b"), F.lit("My Title")), F.lit("My Title")).alias("x")).first()["x"]
    assert got == ["My Title.", "A Short Subtitle.", "Body text goes on."]


def test_audio_plan(spark):
    wavs = spark.createDataFrame([(1, 1, 10, 10), (1, 2, 20, 10)], "chapter int, ord int, frames long, sample_rate int")
    plan = manifest.concat_plan(wavs)
    assert [r["offset"] for r in plan.orderBy("ord").collect()] == [0, 15]
    assert manifest.totals(plan).first()["frames"] == 35
    with pytest.raises(Exception, match="sample rate"):
        manifest.concat_plan(wavs.withColumn("sample_rate", F.col("ord") * 100)).collect()


def test_ocr(spark):
    line = "5\t1\t1\t1\t1\t{}\t30\t60\t90\t30\t{}\t{}"
    texts = [line.format(1, "90", "Hello"), line.format(2, "20", "low"), line.format(3, "x", "bad"), line.format(4, "90", "there").replace("\t30\t60", "\t?\t60"), "5\t1", line.format(5, "90", "ok").replace("5\t", "4\t", 1)]
    rows = spark.createDataFrame([(1, 1, 3.0, t) for t in texts], "doc_id long, page int, scale double, line string")
    assert [(r["text"], r["x0"], r["x1"]) for r in readers.ocr_words(rows).collect()] == [("Hello", 10.0, 40.0)]


def test_files(spark, tmp_path):
    from narratix.sources import sinks

    (tmp_path / "narration_002.txt").write_text("two")
    (tmp_path / "other.txt").write_text("no")
    assert [(r["chapter"], r["text"]) for r in readers.whole_texts(spark, str(tmp_path)).collect()] == [(2, "two")]
    for text in ("a", "b"):
        sinks.partitioned(spark.createDataFrame([(1, text)], "chapter int, text string"), str(tmp_path / "out"), "chapter")
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b"]
    assert one(spark, lambda c: readers.tolerant_json(c, "a int")["a"], "{bad") is None


def test_stream(spark, sf, tmp_path):
    from narratix.streaming import status

    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    q = status.per_window(status.events(spark, str(tmp_path / "in"), table.schema)).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    rounded = lambda frame: sorted((str(r["w"]), r["event_type"], r["n"], round(r["value"], 6)) for r in frame.collect())
    assert rounded(spark.table("w")) == rounded(status.per_window(table))


def test_patterns_are_portable():
    from narratix.functions import patterns

    texts = [v for k, v in vars(patterns).items() if k.isupper() and isinstance(v, str)]
    assert not [t for t in texts if re.search(r"\\[wbsdWBSD]|\(\?[=!<]", t)]


def test_speech(spark):
    from narratix.functions import speech

    assert one(spark, speech.tts_normalize, "Chapter 1: A Title\nIt cost US$1,000.50 then, all of it.") == "Chapter 1: A Title.\nIt cost 1,000.50 dollars then, all of it."
    assert one(spark, speech.tts_segments, "Chapter 1: X\n\nThe Second Title\n\nThird Title Too\n\nbody") == ["Chapter 1: X.", "The Second Title.", "Third Title Too.\n\nbody"]
    assert one(spark, speech.tts_segments, "") == [] and one(spark, speech.speech_normalize, "crea-\ntivity\ngoes\n\n\non") == "creativity goes\n\non"
    assert one(spark, speech.ocr_normalize, "con-temporary con-temporary solv- ing , x- y") == "contemporary contemporary solving, xy"
    assert [one(spark, speech.viable_ocr_line, x) for x in ("ab cd", "abc def", "12345 abc")] == [False, True, False]


def test_white_space_signs(spark):
    """Every sign that the pattern takes for white space, and a text without any."""
    import re

    from narratix.functions import patterns as P

    space = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1].zfill(4), P.SPACE))
    assert {chr(k) for k in range(0x10000) if space.fullmatch(chr(k))} == {" ", *P.SPACES}
    for x in P.SPACES:
        assert one(spark, T.compact, f"{x}a{x} b{x}") == "a b" and one(spark, T.strip, f"{x}a{x}b {x}") == f"a{x}b"
    assert [one(spark, f, x) for f in (T.compact, T.strip) for x in ("", " ", "ab")] == ["", "", "ab"] * 2


def test_recovered_lines(spark, sf):
    """Coverage from arrays as from the join, and likeness as the plain ratio has it."""
    from difflib import SequenceMatcher
    from itertools import product

    from narratix.operators import recovery
    from narratix.plans import more

    words, boxes = more.words(spark, sf), more.boxes(spark, sf)
    words = words.unionByName(words.where("ord % 9 = 0").withColumn("x0", F.col("x0") + 90))  # two rows of one word
    want = recovery.covered(words, boxes).collect()
    own = boxes.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "x0", "y0", "x1", "y1"))).alias("e"))
    w = F.col("w")
    rows = recovery.word_lines(words).join(own, ["doc_id", "page"]).select("doc_id", "page", "line", "e", F.transform(w, lambda x: x["ord"]).alias("o"), F.transform(w, lambda x: (x["x0"] + x["x1"]) / 2).alias("x"), F.transform(w, lambda x: (x["y0"] + x["y1"]) / 2).alias("y"))
    got = rows.select("doc_id", "page", "line", recovery._hits("e", "o", "x", "y").alias("h")).select("doc_id", "page", "line", "h.*").collect()
    paged = {(r["doc_id"], r["page"]) for r in own.collect()}
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in want if (r["doc_id"], r["page"]) in paged) and any(r["coverage"] > 0 for r in got)
    texts = ["", "a", "A quick brown fox jumps", "a quick brown fox jumped", "the quiet brown ox jumps", "ab" * 150, "ab" * 150 + "c", "jumps fox brown quick a", "İstanbul", "i̇stanbul"]
    for a, b, t in product(texts, texts, (0.72, 0.88, 0.9)):
        assert recovery.over(a, [b], t) == (SequenceMatcher(None, a.lower(), b.lower()).ratio() > t), (a, b, t)


def test_unlike_lines_are_not_matched(monkeypatch):
    """The slow matching is for pairs that a bound does not settle."""
    from narratix.operators import recovery

    monkeypatch.setattr(recovery, "SequenceMatcher", lambda *x: (_ for _ in ()).throw(AssertionError("matched")))
    assert not recovery.over("the cat sat on the mat and slept", ["on tables cats are not to be seen", "a dog"], 0.9)


def test_names(spark):
    from narratix.functions import names

    assert one(spark, names.safe_filename, " A: b/c ") == "A_bc" and one(spark, names.safe_filename, "?!") == "Untitled" and one(spark, names.folder_name, "é!") == "Book"
    assert one(spark, names.slug_title, "my_book-1999_2001") == "my book" and one(spark, names.size_label, 0.0) == "0 B" and one(spark, names.size_label, 1536.0) == "1.50 KB"
    label = lambda *x: one(spark, lambda _: names.chapter_label(F.array(*map(F.lit, x))), 0.0)
    assert [label(), label(7), label(*range(1, 8))] == ["full", "chapter_007", "chapters_001_002_003_004_005_006_plus"]
    assert one(spark, T.clock, -3.0) == "00:00"


def test_recovery(spark):
    """Of three recognised lines one repeats an element, one is a page number and one is new."""
    from narratix.operators import recovery

    said = ["The first line is known to the page", "Here are words nobody has extracted before", "17"]
    words = [(1, 1, k, j, w, 72.0 + 30 * j, 100.0 + 60 * k, 95.0 + 30 * j, 110.0 + 60 * k) for k, t in enumerate(said) for j, w in enumerate(t.split())]
    words = spark.createDataFrame(words, "doc_id long, page long, line long, ord long, text string, x0 double, y0 double, x1 double, y1 double")
    elements = spark.createDataFrame([(1, 1, 0, said[0], 70.0, 95.0, 400.0, 115.0)], "doc_id long, page long, idx long, text string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id long, page long, width double, height double")
    got = recovery.recover(words, elements, pages).collect()
    assert [(r["type"], r["text"], r["avg_coverage"]) for r in got] == [("heading", said[1], 0.0)]
    assert recovery.recover(words.limit(0), elements, pages).count() == 0
