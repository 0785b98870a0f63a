"""Sinks: each replaces only the partitions it writes, so stale outputs of a rerun chapter go and others stay."""

from __future__ import annotations

from pyspark.sql import DataFrame


def partitioned(df: DataFrame, path: str, *keys: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(fmt).save(path)


def texts(df: DataFrame, path: str, key: str, column: str = "text") -> None:
    """One folder of text per key."""
    df.select(key, df[column].alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)
