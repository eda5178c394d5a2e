"""New episodes as they arrive: the batch job on each micro-batch of files, as all state is within an episode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, root: str, process: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Call ``process(transcripts, batch)`` on the transcripts of new files below ``root/<language>/<episode>/``; started query."""
    path = F.col("_metadata.file_path")
    part = lambda i: F.url_decode(F.regexp_extract(path, r"([^/]+)/([^/]+)/[^/]+\.txt$", i))
    rows = spark.readStream.option("wholetext", True).text(f"{root}/*/*").select(part(1).alias("language"), part(2).alias("episode"), F.col("value").alias("text"))
    sink = rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (sink.trigger(availableNow=True) if once else sink).start()
