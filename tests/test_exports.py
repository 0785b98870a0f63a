"""Layout, narration files, identity and listings end to end on made pages, chapters and folders."""

import wave

import pytest
from narratix.operators import checks, elements, export, identity, manifest
from narratix.sources import readers, select
from narratix.streaming import status
from pyspark.sql import functions as F

TITLE = "Chapter 1: Computers as Creative Tools"
ELEMENTS = "chapter int, idx int, type string, text string, raw_text string, normalized_text string, narrate boolean"


def chapter(spark):
    rows = [
        ("heading", "Chapter 1: Computers as Creative Tools", None),
        ("subtitle", "Digital Creativity and the Dawn of AI-Art", None),
        ("paragraph", "Creators and art collectives incorporating new tools\nhave changed the field .", True),
        ("footnote", "1 I will use the term artist and creator interchangeably", None),
        ("paragraph", "2", None),
        ("paragraph", "1982", None),
        ("header", "A Running Head", None),
        ("paragraph", "switched off here and now", False),
        ("figure_caption", "Fig. 1.1 Photograph of a video installation", None),
        ("paragraph", "", None),
        ("paragraph", "1968", None),
    ]
    return spark.createDataFrame([(1, k, kind, t, t, "" if k % 2 else t, n) for k, (kind, t, n) in enumerate(rows)], ELEMENTS)


def test_narration_files(spark):
    """The cases of a chapter pass on its final narration; the raw one keeps what that leaves out."""
    titles = spark.createDataFrame([(1, TITLE), (2, "Empty")], "chapter int, title string")
    got = {r["chapter"]: r for r in export.narration_files(chapter(spark), titles, "chapter").collect()}
    final, raw = got[1]["final"], got[1]["raw"]
    assert got[2]["final"].startswith("Empty") and final.split("\n\n")[0] == TITLE + "."
    cases = [("a", TITLE, None), ("b", "Digital Creativity and the Dawn of AI-Art", None), ("c", "Creators and art collectives incorporating new tools have changed the field.", None), ("d", "Footnote 1. I will use the term artist and creator interchangeably", None)]
    cases += [("e", None, "2"), ("f", None, "1982"), ("g", None, "1968"), ("h", "Fig. 1.1 Photograph of a video installation", None)]
    rows = spark.createDataFrame([(i, "n", has, None, None, no, "pass") for i, has, no in cases], "id string, file string, must_contain string, must_not_contain string, must_match_line string, must_not_match_line string, expected string")
    results = checks.evaluate(rows, spark.createDataFrame([("n", final)], "file string, text string"))
    assert {r["status"] for r in results.collect()} == {"PASS"}
    assert checks.summary(results).select("n", "failed").collect() == [(8, False)]
    assert final.count(TITLE) == 1 and "Running Head" not in final and "switched off" not in final
    assert "Running Head" in raw and "switched off" in raw and "1982" in raw


def test_page_speech(spark):
    got = export.page_speech(chapter(spark), "chapter").collect()
    parts = got[0]["text"].split("\n\n")
    assert "Footnote. 1 I will use the term artist and creator interchangeably" in parts and not {"2", "1982", "1968", "A Running Head"} & set(parts)


def test_page_layout(spark):
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in (1, 2, 3)], "doc_id int, page int, width double, height double")
    blocks = []
    for p in (1, 2, 3):
        blocks += [(1, p, 0, f"Journal of Made Things, volume {p}", 72.0, 20.0, 400.0, 32.0), (1, p, 1, "Computers as Creative Tools", 150.0, 120.0, 450.0, 140.0), (1, p, 2, "Creative Tools", 250.0, 160.0, 350.0, 175.0), (1, p, 3, "1982", 72.0, 300.0, 100.0, 310.0)]
    blocks = spark.createDataFrame(blocks, "doc_id int, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    words = [(1, 1, k, w, 72.0 + 40 * k, 400.0, 105.0 + 40 * k, 410.0) for k, w in enumerate("these words stand in no block of the page.".split())]
    words += [(1, 1, 50, "Creative", 260.0, 162.0, 300.0, 170.0)]
    words = spark.createDataFrame(words, "doc_id int, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    seen = [(1, 2, 0, k, w, 72.0 + 40 * k, 500.0, 105.0 + 40 * k, 510.0) for k, w in enumerate("a line that only recognition could see here.".split())]
    seen = spark.createDataFrame(seen, "doc_id int, page int, line int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    got = elements.page_layout(pages, blocks, words, seen).orderBy("page", "idx").collect()
    by = {(r["page"], r["text"]): r for r in got}
    assert [r["id"] for r in got if r["page"] == 1] == [f"p0001_e{k:04d}" for k in range(5)]
    assert all(by[p, f"Journal of Made Things, volume {p}"]["type"] == "header" for p in (1, 2, 3))
    assert by[1, "Computers as Creative Tools"]["type"] == "heading" and by[1, "Creative Tools"]["type"] == "duplicate_heading_fragment" and not by[1, "Creative Tools"]["narrate"]
    assert not by[2, "1982"]["narrate"] and by[1, "these words stand in no block of the page."]["source"] == "orphan_words"
    more = by[2, "a line that only recognition could see here."]
    assert more["type"] == "recovered_ocr_paragraph" and more["narrate"] and abs(more["confidence"] - 0.68) < 1e-9 and more["source_info"]["ocr"]


def test_identity_from_all_sources(spark):
    lines = spark.createDataFrame([(1, 1, "A Fine Book", 1, 20.0, None, None), (1, 2, "By Jane Doe", 1, 10.0, None, None)], "doc_id int, ord int, text string, page int, font_size double, y_ratio double, center_x_ratio double")
    none = spark.createDataFrame([(1, "Old Title", "", "John Roe"), (2, "Old Title", "", "")], "doc_id int, title string, subtitle string, author string")
    meta = spark.createDataFrame([(2, "A Metadata Title", "Ann Lee"), (3, "", "x")], "doc_id int, title string, author string")
    folders = spark.createDataFrame([(1, "f"), (2, "f"), (3, "my_book-two")], "doc_id int, folder string")
    got = {(r["doc_id"], r["field"]): (r["value"], round(r["confidence"], 2)) for r in identity.resolved(lines, none, meta, folders).collect()}
    assert got[1, "title"][0] == "A Fine Book" and got[1, "author"] == ("Jane Doe", 0.9)
    assert got[2, "title"] == ("A Metadata Title", 0.6) and got[2, "author"] == ("Ann Lee", 0.75) and got[3, "title"] == ("my book two", 0.25)


def test_listings(spark, tmp_path):
    for n in ("b.pdf", "a.pdf", "x.txt"):
        (tmp_path / n).write_bytes(b"x")
    files = select.listing(spark, str(tmp_path))
    assert {r["name"] for r in files.collect()} == {"a.pdf", "b.pdf", "x.txt"} and select.first_pdf(files).first()["name"] == "a.pdf"
    with pytest.raises(FileNotFoundError, match="a.pdf"):
        select.only_pdf(files)
    own = [r["path"] for r in files.orderBy("path").collect()]
    assert select.only_pdf(files, explicit=own[1]) == own[1] == select.only_pdf(files, configured=own[1]) and select.only_pdf(files.where("name <> 'a.pdf'")).endswith("b.pdf")
    with pytest.raises(FileNotFoundError):
        select.only_pdf(files, explicit="nowhere")
    row = spark.range(1).select(select.source_pdf(F.lit(None), F.lit("rel.pdf"), F.lit("beside.pdf"), F.lit("any.pdf")).alias("p")).first()
    assert row["p"] == "beside.pdf"


def test_wav_files(spark, tmp_path):
    for name, channels in (("a.wav", 1), ("b.wav", 2)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(24000)
            w.writeframes(b"\x00\x40" * 10 * channels)
    rows = select.wav_headers(spark, str(tmp_path)).withColumn("chapter", F.lit(1)).withColumn("ord", F.col("channels"))
    assert sorted((r["frames"], r["sample_rate"], r["channels"]) for r in rows.collect()) == [(10, 24000, 1), (10, 24000, 2)]
    waves = spark.read.format("binaryFile").load(str(tmp_path)).select(select.samples(F.col("content")).alias("x")).collect()
    assert sorted((len(r["x"]), len(r["x"][0])) for r in waves) == [(10, 1), (10, 2)] and abs(waves[0]["x"][0][0] - 0.5) < 1e-6
    assert [r["offset"] for r in manifest.concat_plan(rows).orderBy("ord").collect()] == [0, 12010]


def test_header_of_recognised_words(spark):
    line = "\t".join(["“hi”\u00a0 there", "5", "1", "1", "1", "1", "1", "10", "20", "30", "40", "90"])
    rows = spark.createDataFrame([(1, 1, 2.0, line)], "doc_id int, page int, scale double, line string")
    got = readers.ocr_words(rows, header=["text", *readers.TSV[:-1]]).first()
    assert got["text"] == '"hi" there' and (got["x0"], got["x1"]) == (5.0, 20.0)


def test_status_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 6)], "user_id int, event_id int, event_type string, ts int")
    status.append(rows, str(tmp_path / "s"))
    status.append(rows.withColumn("event_id", F.col("event_id") + 9).withColumn("event_type", F.lit("c")).withColumn("ts", F.lit(9)), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert status.latest(back).first()["status"] == "c" and back.where(~F.col("generated_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).count() == 0
