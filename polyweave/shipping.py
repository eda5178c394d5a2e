"""Gives executors this package where they don't have it on their path, and Python workers batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch that Python workers get at a time, where the session sets none; bounds their working set.
BATCH_BYTES = 8 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once, and bound the batches where the session sets no size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    where = os.path.join(tempfile.mkdtemp(prefix="polyweave-"), f"{top.name}.zip")
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    spark.sparkContext.addPyFile(where)
