"""Sources: text files with their numbers, OCR tables, tolerant JSON, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def whole_texts(spark: SparkSession, path: str, pattern: str = r"narration_(\d+)\.txt$") -> DataFrame:
    """chapter, path and text of the files whose name the pattern takes a number from."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.regexp_extract("path", pattern, 1).try_cast("int").alias("chapter"), "path", "text").where("chapter is not null")


def natural_key(name: Column) -> Column:
    """Sorts names with runs of digits as numbers: each run is padded to 12."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 12, "0")).otherwise(x)), "")


#: The columns of an OCR table.
TSV = "level page_num block_num par_num line_num word_num left top width height conf text".split()


def ocr_words(tsv: DataFrame, least: float = 35, header: list[str] | None = None) -> DataFrame:
    """Words of OCR tables: level 5, whole numbers that parse, confidence at least `least`; places divided by scale, quotes and spaces normalized.

    tsv: doc_id, page, scale and a line of tab-separated fields, whose names the header gives (the usual order without one).
    """
    names, f = header or TSV, F.split("line", "\t")
    at = lambda n: F.get(f, F.lit(names.index(n)))
    whole = lambda n: at(n).try_cast("int")
    place = [(at(n).try_cast("double") / F.col("scale")).alias(n) for n in ("left", "top", "width", "height")]
    rows = tsv.where((F.size(f) >= len(names) - 1) & (at("level") == "5")).select(
        "doc_id", "page", whole("block_num").alias("block"), whole("par_num").alias("par"), whole("line_num").alias("line"), whole("word_num").alias("ord"),
        *place, F.coalesce(at("conf").try_cast("double"), F.lit(-1.0)).alias("conf"), T.normalize_text(F.coalesce(at("text"), F.lit(""))).alias("text"),
    )
    rows = rows.dropna(subset=["block", "par", "line", "ord", "left", "top", "width", "height"]).where((F.col("conf") >= least) & (F.col("text") != ""))
    return rows.select("doc_id", "page", "block", "par", "line", "ord", "text", F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), "conf")


def tolerant_json(c: Column, schema: str) -> Column:
    """The parsed object; missing or invalid JSON gives an object of nulls."""
    return F.coalesce(F.from_json(c, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), schema))


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")
