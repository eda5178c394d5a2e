"""Tables that cut lineage, kept where every executor can read them.

An intermediate result that several jobs use, or that would be costly to
compute again after an executor is lost, is written as Parquet below the folder
that the session names in ``spark.checkpoint.dir``. Only on a local master that
names none (a test) a folder of this machine is used instead; a cluster without
a shared folder is an error, as each executor would write to a disk of its own.

The tables of an application are in one folder. They are read as long as a
result that was made of them is, so no operator deletes them: ``clear`` does,
once the results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what a writing task holds, and the least that reading tasks can share a file by.
ROW_GROUP = 32 << 20

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder for the intermediate tables of this application."""
    global _local
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        _local = _local or tempfile.mkdtemp(prefix="polyweave-")
        where = f"file://{_local}"
    return f"{where.rstrip('/')}/polyweave/{spark.sparkContext.applicationId}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application has landed; results that were not written out can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
