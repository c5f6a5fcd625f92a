"""Make this package importable in Python workers that don't have it installed."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the session's workers, once an application; the driver's file server hands it out."""
    sc = spark.sparkContext
    if sc.applicationId not in _DONE:
        root = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="galley-", suffix=".zip")
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        _DONE.add(sc.applicationId)
    return spark


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """The rows over as many tasks as a shuffle has: a table of short rows is a split or two, however much work each row is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each, so that what is made of one isn't held for thousands."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
