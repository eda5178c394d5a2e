"""Readers of the corpus layout. Every reader takes a glob and is one distributed read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweave.functions import fixed as X
from polyweave.functions import text as T
from polyweave.log import log

AUDIO_MANIFEST = "id string, audio_filepath string, normalized_text string, duration double, audio_start_sec double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def transcripts(spark: SparkSession, root: str, languages: list[str] | None = None, low_resource_only: bool = False) -> DataFrame:
    """(language, episode, text) of ``root/<language>/<episode>/<episode>.txt``; English is always read, missing files are no rows."""
    low = [n for n, _, _, _, is_low in X.LANGUAGES if is_low]
    names = languages or (low if low_resource_only else None)
    where = f"{root}/{{{','.join(dict.fromkeys(['English', *names]))}}}/*/*.txt" if names else f"{root}/*/*/*.txt"
    empty = spark.createDataFrame([], "language string, episode string, text string")
    if not exists(spark, where):
        return empty
    path = F.col("_metadata.file_path")
    part = lambda i: F.url_decode(F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)\.txt$", i))
    rows = spark.read.text(where, wholetext=True).select(part(1).alias("language"), part(2).alias("episode"), part(3).alias("file"), F.col("value").alias("text"))
    rows = rows.where("file = episode").drop("file")
    return rows.withColumn("text", T.clean_underscores(F.col("text"), F.col("language")))


def episodes(rows: DataFrame, skip: int = 0) -> DataFrame:
    """Distinct episodes in descending order of number, without the ``skip`` last."""
    from pyspark.sql import Window

    found = rows.select("episode").distinct().withColumn("episode_no", T.episode_number(F.col("episode")))
    place = F.row_number().over(Window.orderBy("episode_no", F.desc("episode")))
    return found.withColumn("place", place).where(F.col("place") > skip).drop("place").orderBy(F.desc("episode_no"), "episode")


def id_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Two columns, no header, no quoting."""
    return spark.read.option("sep", "\t").option("quote", "").schema("sentence_id string, text string").csv(path)


def header_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").option("header", True).schema(schema).csv(path)


def safe(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame | None:
    """``read(spark, path)``; None, and a word in the log, where nothing is there, nothing is in it or it can't be read."""
    if not exists(spark, path):
        log.warning("%s: missing", path)
        return None
    try:
        rows = read(spark, path)
        if rows.head(1):
            return rows
        log.warning("%s: empty", path)
    except Exception as e:  # whatever a reader of a broken file raises
        log.warning("%s: can't be read: %s", path, str(e).split("\n")[0])
    return None


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that hold one JSON array each; a broken file is an error."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def numbered_lines(spark: SparkSession, path: str, pattern: str, keys: list[str]) -> DataFrame:
    """(keys, line_index, text) of text files, numbered from 0; the groups of ``pattern`` on the path are the keys. A file is one row while it is read."""
    part = [F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), pattern, i + 1)).alias(k) for i, k in enumerate(keys)]
    rows = spark.read.text(path, wholetext=True).select(*part, F.regexp_replace("value", r"\n$", "").alias("_v"))
    return rows.select(*keys, F.posexplode(F.split("_v", "\n")).alias("line_index", "text"))


def sidecar(spark: SparkSession, path: str, pattern: str, keys: list[str]) -> DataFrame:
    """(keys, line_index, sentence_id, text) of id sidecars; the groups of ``pattern`` on the path are the keys."""
    part = [F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), pattern, i + 1)).alias(k) for i, k in enumerate(keys)]
    rows = spark.read.option("sep", "\t").option("quote", "").schema("line_index int, sentence_id string, text string").csv(path)
    return rows.select(*part, "line_index", "sentence_id", "text")


def audio_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines that have an id."""
    return spark.read.schema(AUDIO_MANIFEST).json(path).where("id is not null")


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def sheets(files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """(episode, file, path) of the per-language sheets among listed files, top-level ones left out."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    rows = files.select("path", name.alias("file"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("episode"))
    like = "|".join(p.replace("*", ".*").replace(".xlsx", r"\.xlsx") for p in X.SHEET_PATTERNS)
    rows = rows.where(F.col("file").rlike(f"^({like})$") & ~F.col("file").isin(*X.TOP_SHEETS))
    return rows.where(~F.col("episode").isin(*exclude)) if exclude else rows


def merged_languages(files: DataFrame) -> DataFrame:
    """Languages that merged tables exist for, without English."""
    found = F.regexp_extract("path", r"/Merged_(.+)_en_aligned\.tsv", 1)
    return files.select(found.alias("language")).where("language <> '' and language <> 'English'").distinct()
