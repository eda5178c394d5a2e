"""Forced alignment of texts with audio by a program of another project.

``episodes`` finds what there is to align, ``run`` calls the program once per
row on the executors. The program gets the arguments ``ARGUMENTS`` and writes to
the folder it is told; it must see the same files as Spark, so paths have to be
on a file system that all executors mount.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweave.functions import fixed as X
from polyweave.functions import text as T
from polyweave.plans import build
from polyweave.shipping import ship

ARGUMENTS = ("--audio_filepath", "{audio}", "--text_filepath", "{text}", "--lang", "{code}", "--uroman_path", "{uroman}", "--outdir", "{outdir}")

_RESULT = "language string, episode string, status string, message string"


def start_from(episodes: DataFrame, first: str, language: str = "English") -> DataFrame:
    """One language's episodes from ``first`` on in descending order of number; an error if it has none of that name."""
    mine, number, start = F.col("language") == language, T.episode_number(F.col("episode")), T.episode_number(F.lit(first))
    if not episodes.where(mine & (F.col("episode") == first)).head(1):
        raise ValueError(f"{first} is not among the episodes of {language}")
    return episodes.where(~mine | (number < start) | ((number == start) & (F.col("episode") >= first)))


def episodes(spark: SparkSession, base: str, output: str, text_suffix: str = "_split_sentences.txt", audio_suffix: str = ".wav") -> DataFrame:
    """(language, episode, code, text, audio, outdir) of ``base/<language>/<episode>/``; text or audio is null where the file is missing."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(f"{base}/*/*/*").select(F.regexp_replace("path", "^file:(//)?", "").alias("path"))
    part = lambda i: F.url_decode(F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", i))
    listed = listed.select("path", part(1).alias("language"), part(2).alias("episode"), part(3).alias("file"))
    of = lambda suffix: F.max(F.when(F.col("file") == F.concat("episode", F.lit(suffix)), F.col("path")))
    found = listed.groupBy("language", "episode").agg(of(text_suffix).alias("text"), of(audio_suffix).alias("audio"))
    own = F.create_map(*(F.lit(x) for pair in X.ALIGNER_CODES.items() for x in pair))
    code = F.coalesce(own[F.col("language")], own[F.col("code")]).alias("code")
    dim = F.broadcast(build.languages(spark).select("language", code))  # as long as the list of languages
    return found.join(dim, "language").withColumn("outdir", F.concat(F.lit(f"{output}/"), "language", F.lit("/"), "episode", F.lit("/"), "episode"))


def run(rows: DataFrame, command: list[str], uroman: str, timeout: float | None = None) -> DataFrame:
    """(language, episode, status, message): status is done, skipped (a file is missing) or failed; a failure stops no other row."""
    ship(rows.sparkSession)

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                if not r.text or not r.audio:
                    out.append((r.language, r.episode, "skipped", "missing text or audio"))
                    continue
                os.makedirs(r.outdir, exist_ok=True)
                given = {"audio": r.audio, "text": r.text, "code": r.code, "uroman": uroman, "outdir": r.outdir}
                try:
                    subprocess.run([*command, *(a.format(**given) for a in ARGUMENTS)], check=True, capture_output=True, text=True, timeout=timeout)
                    out.append((r.language, r.episode, "done", None))
                except (subprocess.SubprocessError, OSError) as e:
                    out.append((r.language, r.episode, "failed", f"{e} {(getattr(e, 'stderr', '') or '')[-500:]}".strip()))
            yield pd.DataFrame(out, columns=["language", "episode", "status", "message"])

    # an episode is minutes of work: one row a task, whatever the size of the listing
    return rows.repartition("language", "episode").mapInPandas(call, _RESULT)
