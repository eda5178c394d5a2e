"""Command line: align, enrich, merge-tsv, merge-sheets, manifests, force-align.

``python -m polyweave.plans.cli <command> --help`` tells the options.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweave import log
from polyweave.functions import fixed as X
from polyweave.functions import text as T
from polyweave.operators import audio, corpus, manifest
from polyweave.operators.embed import embedder, hashing
from polyweave.plans import build, force_align
from polyweave.shipping import ship
from polyweave.sources import files, sinks
from polyweave.tables import clear, land

SUFFIXES = ("en_aligned", "all_aligned", "en_all_candidates", "all_all_candidates")


def run_align(
    spark: SparkSession, text_dir: str, output_dir: str, languages: list[str] | None = None, low_resource_only: bool = False,
    options: build.Options = build.Options(), save_all: bool = False, debug: bool = False, kinds: tuple[str, ...] = (),  # noqa: B008
) -> None:
    """Split, align and write sentences, segments, pairs, compared rows and wide tables; ``kinds`` adds sheets in tsv or xlsx."""
    ship(spark)
    rows = files.transcripts(spark, text_dir, languages, low_resource_only)
    first, second = (embedder(lambda o=o: hashing(128, o)) for o in ((2, 3), (3, 4)))
    made = build.align_all(rows, first, second, options)
    names = [r.language for r in rows.select("language").distinct().where("language <> 'English'").orderBy("language").collect()]  # of the list of languages
    key = ["language", "episode"]
    made["sentences"].write.parquet(f"{output_dir}/sentences")
    sinks.lines(made["sentences"], f"{output_dir}/split_sentences", key, "idx", "text")
    sinks.id_sidecar(made["sentences"], f"{output_dir}/split_sentences_ids", key, "idx")
    made["segments"].write.partitionBy(*key).parquet(f"{output_dir}/segments")
    sinks.split_segments(spark.read.parquet(f"{output_dir}/segments"), output_dir, key)
    views = {"aligned": made["pairs"], "all_pairs_before_threshold": made["complete"]}
    views |= {"sliding_aligned": made["sliding"], "aligned_topk_only": made["topk"]} if debug else {}
    views |= {"aligned_both_candidates": made["candidates"]} if save_all else {}
    for view, table in views.items():
        table.write.partitionBy("language").parquet(f"{output_dir}/{view}")
        written = spark.read.schema(table.schema).parquet(f"{output_dir}/{view}")
        log.tell(view, written, aligned=F.col("aligned"))
        more = ("is_selected_best",) if view == "aligned_both_candidates" else ()
        for n in names if kinds else []:
            sheet = written.where(F.col("language") == n).withColumnsRenamed({"text": n, "english": "English", "sentence_id": f"{n}_sentence_id"})
            for kind in kinds:
                sinks.alignment_sheet(sheet, f"{output_dir}/sheets/{n}_{view}.{kind}", n, kind, more)
    if not names:
        return
    pairs = spark.read.schema(made["pairs"].schema).parquet(f"{output_dir}/aligned")
    wides = {"all_aligned": (pairs, "en_aligned", "all_aligned")}
    if save_all:
        every = spark.read.schema(made["candidates"].schema).parquet(f"{output_dir}/aligned_both_candidates")
        wides["all_all_candidates"] = (every, "en_all_candidates", "all_all_candidates")
    for name, (table, long, short) in wides.items():
        for share, suffix in ((None, long), (options.min_language_share, short)):
            wide = land(build.wide_table(table, names, share), name)
            path = f"{output_dir}/{name}{'' if share is None else '_without_null'}"
            sinks.table(wide, path, "json")
            for kind in kinds:
                sinks.table(wide, f"{path}.{kind}", kind)
            for n in names:
                sinks.id_tsv(wide, f"{output_dir}/{suffix}/language={n}", f"{n}_sentence_ids", n, by=("episode",))
            sinks.id_tsv(wide, f"{output_dir}/{suffix}/language=English", "English_sentence_id", "English", by=("episode",))


def run_enrich(spark: SparkSession, tsv: str, audio_manifest: str, audio_files: str, output: str, language: str, seconds: float = 30, rate: int = 16000) -> DataFrame:
    """Id table joined with its manifest, with units of the audio; written anew."""
    ship(spark)
    found = files.audio_manifest(spark, audio_manifest).withColumnRenamed("audio_filepath", "path")
    rows = corpus.id_join(files.id_tsv(spark, tsv), found)
    log.tell(f"ids of {tsv}", rows, matched=F.col("path").isNotNull(), unmatched=F.col("path").isNull())
    rows = audio.add_units(rows, files.binary(spark, audio_files), target=rate, seconds=seconds)
    rows = rows.select("sentence_id", "text", "path", "normalized_text", "duration", "audio_start_sec", F.col("units").alias(f"{language}_Units"), F.col("sample_rate").cast("double").alias(f"{language}_Sample_rate"))
    sinks.enriched_tsv(rows, output)
    return rows


def run_merge_tsv(spark: SparkSession, path: str, output: str, schema: str, exclude: list[str] | None = None, kinds: tuple[str, ...] = ("parquet",)) -> None:
    """All episodes' tables of every language as one, by language: ``path`` matches root/language/episode/file."""
    rows = files.header_tsv(spark, path, schema).withColumn("_p", F.col("_metadata.file_path"))
    part = lambda i: F.url_decode(F.regexp_extract("_p", r"([^/]+)/([^/]+)/[^/]+$", i))
    rows = rows.withColumn("language", part(1)).withColumn("episode", part(2)).drop("_p")
    rows = rows.where(~F.col("episode").isin(*exclude)) if exclude else rows
    sinks.merged(rows, output, kinds=kinds)
    for r in log.counts(rows, ("language",)).orderBy("language").collect():  # a row per language
        log.log.info("merged %s: %d rows", r.language, r["rows"])


def run_merge_sheets(spark: SparkSession, path: str, output: str, schema: str, exclude: list[str] | None = None, kinds: tuple[str, ...] = ("parquet",)) -> None:
    """Per-episode sheets read, deduplicated within each file by sentence ids (by texts without any), and united.

    Of equal rows the first in its file stays. Texts are deduplicated by each column in turn; a third pass by both
    would find nothing more.
    """
    from polyweave.sources.xlsx import read_sheets

    ship(spark)
    listed = files.binary(spark, path)
    chosen = listed.join(files.sheets(listed, exclude).select("path"), "path", "left_semi")
    rows = read_sheets(chosen, schema, number="_n")
    ids = [c for c in rows.columns if c.endswith("_sentence_id")]
    texts = [c for c in rows.columns if c not in ("path", "_n")][:2]
    kept = corpus.keep_first(rows, ["path", *ids], ["_n"]) if ids else corpus.keep_first(corpus.keep_first(rows, ["path", texts[0]], ["_n"]), ["path", texts[1]], ["_n"])
    kept = land(kept.drop("_n").withColumn("file", F.regexp_extract("path", "([^/]+)$", 1)).drop("path"), "merged-sheets")
    sinks.merged(kept, output, "file", kinds)
    for r in log.counts(kept, ("file",)).orderBy("file").collect():  # a row per kind of sheet and language
        log.log.info("merged %s: %d rows", r.file, r["rows"])


def run_force_align(spark: SparkSession, base_dir: str, output_dir: str, uroman: str, command: list[str], english_from: str | None = None) -> DataFrame:
    """Call the aligner for every episode that has text and audio; (language, episode, status, message), also written below ``output_dir``."""
    rows = force_align.episodes(spark, base_dir, output_dir)
    rows = force_align.start_from(rows, english_from) if english_from else rows
    force_align.run(rows, command, uroman).write.mode("append").parquet(f"{output_dir}/status")
    done = spark.read.parquet(f"{output_dir}/status")
    log.tell("forced alignment", done, done=F.col("status") == "done", skipped=F.col("status") == "skipped", failed=F.col("status") == "failed")
    return done


def run_manifests(spark: SparkSession, wide: DataFrame, audio_rows: DataFrame, similarity: DataFrame | None, output: str, languages: list[str], kinds: tuple[str, ...] = ("parquet",)) -> None:
    """Pairs of each language with English: explode, look up audio, attach similarity, clean, split, write.

    ``audio_rows`` has (sentence_id, path, units), ``similarity`` (sentence_id, similarity).
    """
    for n in languages:
        rows = corpus.explode_pairs(wide, n, "English")
        side = lambda p: audio_rows.select(F.col("sentence_id").alias("id"), F.col("path").alias(f"{p}_path"), F.col("units").alias(f"{p}_units"))
        rows = corpus.id_join(corpus.id_join(rows, side("source")), side("target"), "English_sentence_id")
        log.tell(f"audio of {n}-English", rows, without_source=F.col("source_path").isNull(), without_target=F.col("target_path").isNull())
        rows = rows.na.drop(subset=["source_path", "target_path"])
        rows = corpus.attach_first(rows, similarity, "sentence_id", F.desc("similarity")) if similarity is not None else rows.withColumn("similarity", F.lit(0.0))
        rows = corpus.keep_first(rows, ["English", "text"], ["sentence_id", "English_sentence_id"])
        cleaned = T.keep_letters(T.drop_fragments(T.drop_weak_leading(F.col("text"))))
        code = {k: m for k, _, _, m, _ in X.LANGUAGES}
        rows = rows.withColumn("pair", F.lit(f"{n}-English")).withColumn("source_text", cleaned).withColumn("target_text", F.col("English"))
        rows = rows.withColumns({"source_lang": F.lit(code.get(n, "unk")), "target_lang": F.lit(code["English"]), "key": F.concat_ws("|", "sentence_id", "English_sentence_id", "text")})
        parts = land(manifest.split(rows, "pair", "key"), "splits")
        log.tell(f"{n}-English", parts, without_similarity=F.col("similarity").isNull())
        sinks.splits(parts, f"{output}/{n}-English", "pair", kinds)
        sinks.manifest(manifest.records(parts, "pair", ["key"]), f"{output}/{n}-English-manifest", "pair")


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="polyweave")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--log_file", default="", help="also log to this file of the driver's machine")
        return p

    def formats(p: argparse.ArgumentParser, default: str) -> None:
        p.add_argument("--formats", default=default, help="parquet, tsv, json, xlsx; comma-separated")
        p.add_argument("--also_save_excel", action="store_true", help="xlsx beside the formats")

    p = command("align")
    p.add_argument("--text_dir", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--languages", default="")
    p.add_argument("--low_resource_only", action="store_true")
    p.add_argument("--threshold", type=float, default=X.THRESHOLD)
    p.add_argument("--top_k", type=int, default=1)
    p.add_argument("--max_usage", type=int, default=1)
    p.add_argument("--allow_topk_override_weak_sliding", action="store_true")
    p.add_argument("--low_confidence_margin", type=float, default=X.OVERRIDE_MARGIN)
    p.add_argument("--save_all_candidates", action="store_true")
    p.add_argument("--manipuri_sliding_mode", choices=("sonar_only", "fused"), default="sonar_only")
    p.add_argument("--min_lang_frac_for_without_null", type=float, default=0.5)
    p.add_argument("--debug", action="store_true", help="also write the sliding leg and the top-k leg")
    for name in ("run_mode", "n_gpus", "workers_per_gpu", "maxtasksperchild"):
        p.add_argument(f"--{name}", help="accepted and ignored: Spark deals out the work")
    formats(p, "")
    p = command("enrich")
    for name in ("tsv", "audio_manifest", "audio_files", "output", "language"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--max_chunk_seconds", type=float, default=30)
    p.add_argument("--target_sample_rate", type=int, default=16000)
    for name in ("merge-tsv", "merge-sheets"):
        p = command(name)
        p.add_argument("--input", required=True)
        p.add_argument("--output_dir", required=True)
        p.add_argument("--schema", required=True)
        p.add_argument("--exclude_episodes", default="")
        formats(p, "parquet")
    p = command("manifests")
    for name in ("wide", "audio", "output_dir", "languages"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--similarity", default="")
    formats(p, "parquet")
    p = command("force-align")
    for name in ("base_dir", "uroman_path", "output_dir"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--program", required=True, help="the aligner and its first arguments, split at white space")
    p.add_argument("--english_from", default="", help="episode that English starts from")
    a = top.parse_args(argv)

    spark = SparkSession.builder.getOrCreate()
    log.to(a.log_file or None)
    listed = lambda s: [x for x in s.split(",") if x]
    kinds = tuple(dict.fromkeys(listed(getattr(a, "formats", "")) + ["xlsx"] * getattr(a, "also_save_excel", False)))
    if a.command == "align":
        single = ("Manipuri",) if a.manipuri_sliding_mode == "sonar_only" else ()
        options = build.Options(a.threshold, a.top_k, a.max_usage, a.allow_topk_override_weak_sliding, a.low_confidence_margin, a.min_lang_frac_for_without_null, single)
        run_align(spark, a.text_dir, a.output_dir, listed(a.languages) or None, a.low_resource_only, options, a.save_all_candidates, a.debug, kinds)
    elif a.command == "enrich":
        run_enrich(spark, a.tsv, a.audio_manifest, a.audio_files, a.output, a.language, a.max_chunk_seconds, a.target_sample_rate)
    elif a.command == "merge-tsv":
        run_merge_tsv(spark, a.input, a.output_dir, a.schema, listed(a.exclude_episodes), kinds)
    elif a.command == "merge-sheets":
        run_merge_sheets(spark, a.input, a.output_dir, a.schema, listed(a.exclude_episodes), kinds)
    elif a.command == "force-align":
        run_force_align(spark, a.base_dir, a.output_dir, a.uroman_path, a.program.split(), a.english_from or None)
    else:
        similarity = spark.read.parquet(a.similarity) if a.similarity else None
        run_manifests(spark, spark.read.parquet(a.wide), spark.read.parquet(a.audio), similarity, a.output_dir, listed(a.languages), kinds)
    clear(spark)


if __name__ == "__main__":
    main()
