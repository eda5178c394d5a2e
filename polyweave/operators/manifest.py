"""Training splits and manifest records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweave.functions import fixed as X
from polyweave.tables import land


def _turn(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def high_pool(rows: DataFrame, pair: str) -> DataFrame:
    """``rows`` with ``high``: similarity at or above the pair's high quantile; false for null."""
    cuts = rows.groupBy(pair).agg(F.percentile("similarity", F.lit(X.HIGH_QUANTILE)).alias("cut"), F.count("*").alias("n"))
    return rows.join(cuts, pair).withColumn("high", F.coalesce(F.col("similarity") >= F.col("cut"), F.lit(False)))


def _ranked(rows: DataFrame, pair: str, first: Column, turn: Column, key: str) -> DataFrame:
    """``rows`` with ``_rank``, their place in the pair by (first, turn, key).

    The turn is a hash in hexadecimal digits; rows are numbered within ranges of it and added to what the ranges before
    hold, so that no pair is sorted in one task.
    """
    rows = rows.withColumns({"_first": first.cast("int"), "_turn": turn, "_range": F.conv(F.substring(turn, 1, 3), 16, 10).cast("int")})
    group = [pair, "_first", "_range"]
    before = F.sum("count").over(Window.partitionBy(pair).orderBy("_first", "_range")) - F.col("count")  # at most 4096 rows for each value of first
    before = rows.groupBy(*group).count().withColumn("_before", before).drop("count")
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("_turn", key))
    return rows.withColumn("_inside", inside).join(before, group).withColumn("_rank", F.col("_before") + F.col("_inside")).drop("_first", "_turn", "_range", "_inside", "_before")


def split(rows: DataFrame, pair: str, key: str, min_rows: int = X.MIN_ROWS) -> DataFrame:
    """``rows`` with ``split`` for pairs of ``min_rows`` rows or more.

    The validation share comes from the high pool, topped up from the rest; the test rows from what is left.
    Draws are by hash of seed and key, so they do not hang on row order.
    """
    columns = rows.columns
    pool = high_pool(rows, pair).where(F.col("n") >= min_rows)
    seed = F.when(F.col("high"), _turn(X.SEED_VALID, key)).otherwise(_turn(X.SEED_TOP_UP, key))
    pool = land(_ranked(pool, pair, ~F.col("high"), seed, key).withColumn("_valid", F.col("_rank") <= F.floor(F.col("n") * X.VALID_SHARE)).drop("_rank"), "pool")
    ranked = _ranked(pool, pair, F.col("_valid"), _turn(X.SEED_TEST, key), key)
    label = F.when(F.col("_valid"), "valid").when(F.col("_rank") <= X.TEST_ROWS, "test").otherwise("train")
    return ranked.withColumn("split", label).select(*columns, "split")


def split_stats(rows: DataFrame, pair: str) -> DataFrame:
    return rows.groupBy(pair, "split").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def records(rows: DataFrame, pair: str, order: list[str]) -> DataFrame:
    """(pair, split, id, record): the nested JSON lines of the manifests, ids from 1 in each split; nulls are written.

    Rows are sorted by ranges and numbered within them; what stands before a range is added, so that no split is sorted
    in one task.
    """

    def side(p: str) -> Column:
        return F.struct(
            F.col("id"), F.col(f"{p}_lang").alias("lang"), F.col(f"{p}_text").alias("text"), F.col(f"{p}_path").alias("audio_local_path"),
            F.lit(None).cast("string").alias("waveform"), F.lit(16000).alias("sampling_rate"), F.col(f"{p}_units").alias("units"),
        )

    group = [pair, "split"]
    rows = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = land(rows, "sorted").withColumn("_range", F.shiftright("_at", 33))
    ranges = rows.groupBy(*group, "_range").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")  # a row per range
    ranges = ranges.select(*(F.col(c).alias(f"_{c}") for c in group), F.col("_range").alias("_r"), (before - F.col("_start") + 1).alias("_add"))
    same = (F.col("_range") == F.col("_r")) & F.col(pair).eqNullSafe(F.col(f"_{pair}")) & F.col("split").eqNullSafe(F.col("_split"))
    rows = rows.join(ranges, same).withColumn("id", (F.col("_at") + F.col("_add")).cast("int"))
    record = F.to_json(F.struct(side("source").alias("source"), side("target").alias("target")), {"ignoreNullFields": "false"})
    return rows.select(pair, "split", "id", record.alias("record"))
