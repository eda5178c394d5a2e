"""What the operators share: batches of bounded size, keys of rows, columns set aside, and the tables of ``polyweave.tables``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweave import shipping
from polyweave.tables import clear, land, shared_dir  # noqa: F401

#: Rows of Parquet that a task reads at a time, where the session sets none: texts are long, and a batch is held as a whole.
READER_ROWS = 512

#: Stands for a null id inside an operator; such a row sorts after all others.
NO_ID = (1 << 63) - 1


def ship(spark: SparkSession) -> None:
    """Give executors the package, and batches and reads of bounded size where the session sets none."""
    shipping.ship(spark)
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize", None) is None:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def keyed(documents: DataFrame, *columns: str) -> DataFrame:
    """``documents`` with the key of each row: ``doc``, its id (NO_ID for null), and ``tag``, 63 bits of hash of its text.

    Rows that repeat an id, null ids among them, are documents of their own unless their texts are equal too.
    Keys are in the order of ids, null last, then of tags; those of null ids are not negative.
    """
    tag = F.xxhash64(F.col("text")).bitwiseAND(F.lit((1 << 63) - 1))
    tag = F.when(F.col("doc_id").isNull(), tag).otherwise(tag.bitwiseOR(F.lit(-(1 << 63))))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), tag.alias("tag"), "text", *columns)


def set_aside(rows: DataFrame, own: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> tuple[DataFrame, list[Column]]:
    """``rows`` with all columns but ``own`` under names that no operator adds, and the columns that bring the given names back."""
    names = {c: c if c in own else f"_given{i}" for i, c in enumerate(rows.columns)}
    return rows.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]
