"""Makes the package importable on the executors of whatever cluster the session runs on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package's source (a small zip) to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="narratix-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(f.name)
    _shipped.add(app)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder that spark.checkpoint.dir names: lineage ends there and survives lost executors.

    A local folder does where one machine runs all (tests).
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder where executors run elsewhere")
        top = _OWN.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='narratix-')}")
    path = f"{top.rstrip('/')}/narratix/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
