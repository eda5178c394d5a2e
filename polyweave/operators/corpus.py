"""Wide multilingual tables, joins by id, deduplication and unions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_sets(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    return rows.where(F.col(text).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_set(text)).alias("texts"))


def wide(rows: DataFrame, key: str, language: str, text: str, languages: list[str]) -> DataFrame:
    """One row per key, per language its sorted distinct texts or null: a full outer join of all languages."""
    table = rows.where(F.col(text).isNotNull()).groupBy(key).pivot(language, languages).agg(F.array_sort(F.collect_set(text)))
    return table.select(key, *(F.when(F.size(c) > 0, F.col(f"`{c}`")).alias(c) for c in languages))


def enough_languages(table: DataFrame, languages: list[str], share: float) -> DataFrame:
    """Rows with a text in at least the share of languages, half rounded to even, one at least."""
    least = max(1, round(share * len(languages)))
    present = reduce(lambda a, b: a + b, (F.col(f"`{c}`").isNotNull().cast("int") for c in languages))
    return table.where(present >= least)


def explode_pairs(table: DataFrame, source: str, english: str) -> DataFrame:
    """Distinct (English, English_sentence_id, text, sentence_id) of a wide table's lists; ids only where the lists match."""
    ids, texts = F.col(f"{source}_sentence_ids"), F.col(source)
    paired = F.when(F.size(ids) == F.size(texts), ids).otherwise(F.transform(texts, lambda _: F.lit(None).cast("string")))
    rows = table.select(F.col(english).alias("English"), F.col(f"{english}_sentence_id").alias("English_sentence_id"), F.explode(F.arrays_zip(texts.alias("t"), paired.alias("i"))).alias("p"))
    return rows.select("English", "English_sentence_id", F.col("p.t").alias("text"), F.col("p.i").alias("sentence_id")).where("English is not null and text is not null").distinct()


def id_join(rows: DataFrame, manifest: DataFrame, key: str = "sentence_id", other: str = "id") -> DataFrame:
    """Left join on ids: unmatched rows stay, repeated manifest ids repeat the row."""
    return rows.join(manifest.withColumnRenamed(other, "_id"), F.col(key) == F.col("_id"), "left").drop("_id")


def attach_first(rows: DataFrame, values: DataFrame, key: str, order: Column) -> DataFrame:
    """Left join with the first row per key of ``values``."""
    first = values.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return rows.join(first, key, "left")


def positional_join(lines: DataFrame, sidecar: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the ids that stand at the same place of their sidecar; lines beyond its end have none."""
    return lines.join(sidecar.select(*keys, "line_index", "sentence_id"), [*keys, "line_index"], "left")


def right_language(rows: DataFrame, text: str, language: str, detect: Callable[[Column], Column], english: str = "English") -> DataFrame:
    """Rows whose text is detected as ``en`` exactly if their language is English; what can't be detected (null) stays."""
    found = detect(F.col(text))
    return rows.where(found.isNull() | ((F.col(language) == english) == (found == "en")))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def legacy_dedupe(rows: DataFrame, first: str, second: str, order: list[str]) -> DataFrame:
    """By the first text column, then by the second, for tables without ids; a third pass by both would find nothing more."""
    return keep_first(keep_first(rows, [first], order), [second], order)


def union_episodes(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
