"""Helpers shared by the operators: lineage cuts, table reads, null-safe text."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.sources.tables import table

__all__ = ["cut", "ship", "table", "text_or_empty"]

_shipped: set[str] = set()


BATCH_ROWS = 1000       # rows in an Arrow batch: texts are long, and a worker holds a batch at a time
BATCH_BYTES = 8 << 20   # and its bytes, about: rows differ in length by orders of magnitude


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, and bound their Arrow batches.

    Spark's own file service carries a zip of the sources from the driver to each executor.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(most).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(most, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the written files.  The folder
    lies under ``spark.checkpoint.dir``; one is created only where that is unset, as in tests.
    Unlike a checkpoint the table has a known size, so joins after it are planned by it, and
    the size estimates of iterative plans do not pile up.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
