"""From transcripts to a wide multilingual corpus: the whole alignment as one job keyed by episode and language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweave.functions import fixed as X
from polyweave.functions import text as T
from polyweave.functions import vectors as V
from polyweave.operators import align, corpus, segment, similarity
from polyweave.tables import land

EPISODE, BLOCK = ["episode"], ["episode", "language"]


@dataclass(frozen=True)
class Options:
    """What a run can be told; the defaults are those of the command line."""

    threshold: float = X.THRESHOLD
    top_k: int = 1
    max_usage: int = 1
    allow_override: bool = False
    margin: float = X.OVERRIDE_MARGIN
    min_language_share: float = 0.5
    single_score: tuple[str, ...] = ("Manipuri",)
    duplicate_spans: bool = False


def languages(spark: SparkSession) -> DataFrame:
    """The language dimension; as long as the list of fixed values."""
    rows = [(n, code, tag, manifest, None if tag.endswith("Latn") else tag.split("_")[-1], low) for n, code, tag, manifest, low in X.LANGUAGES]
    return spark.createDataFrame(rows, "language string, code string, tag string, manifest_code string, script string, low_resource boolean")


def sentence_table(transcripts: DataFrame, tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """(language, episode, idx, text, sentence_id, code, low_resource): strict splitting for low-resource languages, buffered for others."""
    dim = F.broadcast(languages(transcripts.sparkSession).select("language", "code", "low_resource"))
    rows = transcripts.join(dim, "language", "left").na.fill({"low_resource": False}).withColumn("code", F.coalesce("code", F.lit("unk")))
    strict, buffered = segment.split(F.col("text"), 0, 3, False, tokenize), segment.split(F.col("text"), 5, 3, True, tokenize)
    kept = F.when(F.col("low_resource") & (F.col("language") != "English"), strict).otherwise(buffered)
    whole = F.filter(F.array(F.trim("text")), lambda t: t != "")
    rows = rows.withColumn("_s", T.bound(kept, lambda s: F.when(F.size(s) > 0, s).otherwise(whole)))
    rows = segment.numbered(rows, ["language", "episode", "code", "low_resource"], "text")
    return rows.withColumn("sentence_id", T.sentence_id(F.col("language"), F.col("episode"), T.normalize(F.col("text"), F.col("code"))))


def _embedded(rows: DataFrame, text: str, tag: str, first: Callable[..., Column], second: Callable[..., Column]) -> DataFrame:
    """``rows`` with both vectors (v, w) of their text under its speech-model tag; every distinct one is encoded once."""
    known = rows.select(text, tag).where(F.col(text).isNotNull()).distinct()
    known = known.select(text, F.col(tag).alias("_tag"), first(F.col(text), F.col(tag)).alias("v"), second(F.col(text), F.col(tag)).alias("w"))
    return rows.join(known.withColumnRenamed(text, "_text"), (F.col(text) == F.col("_text")) & F.col(tag).eqNullSafe(F.col("_tag")), "left").drop("_text", "_tag", tag)


@dataclass(frozen=True)
class Sides:
    """What all legs of a run compare: English sentences of each block (i, english, v, w), other sentences (j, text, v, w), and the languages."""

    english: DataFrame
    others: DataFrame
    dim: DataFrame


def sides(sentences: DataFrame, first: Callable[[Column], Column], second: Callable[[Column], Column]) -> Sides:
    """Embeds every sentence once, and writes the outcome down for all legs."""
    dim = languages(sentences.sparkSession)
    tagged = sentences.join(F.broadcast(dim.select("language", "tag")), "language", "left")
    others = tagged.where("language <> 'English'").select(*BLOCK, F.col("idx").cast("long").alias("j"), "text", "tag")
    others = land(_embedded(others, "text", "tag", first, second), "sentence-vectors")
    english = tagged.where("language = 'English'").select("episode", F.col("idx").cast("long").alias("i"), F.col("text").alias("english"), "tag")
    english = land(_embedded(english, "english", "tag", first, second), "english-vectors")
    return Sides(english, others, dim)


def _least(options: Options) -> Column:
    """Acceptance threshold of the sliding leg."""
    return F.when(F.col("low_resource") | F.col("language").isin(*options.single_score), X.FUSED_MIN_LOW).otherwise(X.FUSED_MIN)


def sliding(given: Sides, transcripts: DataFrame, first: Callable[[Column], Column], second: Callable[[Column], Column], options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of each paragraph aligned to English sentences, the paragraph's segments, and one compared row per English sentence.

    A first score shortlists spans per sentence, the fused score decides; low-resource languages are walked in order.
    The compared row is the accepted span, else the best one whatever its score; only what is kept counts as aligned.
    """
    dim = F.broadcast(given.dim)  # as long as the list of languages
    text = transcripts.where("language <> 'English'").select("language", "episode", T.flatten_paragraph(F.col("text")).alias("text")).join(dim, "language")
    made = [segment.spans(text.where(~F.col("low_resource") | F.col("script").isNull()), "text", BLOCK, duplicates=options.duplicate_spans)]
    for script in sorted(set(X.SCRIPTS) - {"Latn"}):
        made.append(segment.spans(text.where(F.col("low_resource") & (F.col("script") == script)), "text", BLOCK, duplicates=options.duplicate_spans, script=script))
    spans = corpus.union_episodes(made).join(dim.select("language", "tag"), "language")
    spans = land(_embedded(spans, "span", "tag", first, second), "span-vectors")
    low = dim.select("language", "low_resource")
    single = F.col("language").isin(*options.single_score)
    lead = F.when(single, F.col("w")).otherwise(F.col("v")).alias("v")
    left = given.english.join(spans.select(*BLOCK).distinct(), EPISODE).select(*BLOCK, "i", lead, "w")
    right = spans.select(*BLOCK, (F.col("s").cast("long") * (1 << 31) + F.col("e")).alias("j"), lead, "w")
    k = F.when(single, X.SHORTLIST_SINGLE).when(F.col("low_resource"), X.SHORTLIST_LOW).otherwise(X.SHORTLIST)
    most = max(X.SHORTLIST_SINGLE, X.SHORTLIST_LOW, X.SHORTLIST)
    short = similarity.shortlist(left, right, BLOCK, most, digits=None).join(low, "language").where(F.col("r") <= k)
    fused = F.when(single, F.col("sim")).otherwise(V.fuse(F.col("sim"), F.col("second")))
    place = F.floor(F.col("j") / (1 << 31)).cast("long")
    found = land(short.select(*BLOCK, "i", place.alias("s"), F.pmod("j", F.lit(1 << 31)).alias("e"), fused.alias("sim"), "low_resource").distinct(), "shortlists")
    gate = F.col("low_resource") | single
    keys = [*BLOCK, "i", "s", "e", "sim"]
    walked = align.frontier(found.where(gate & ~single).select(*keys), BLOCK, X.FUSED_MIN_LOW, X.OVERRIDE_FUSED)
    alone = align.frontier(found.where(single).select(*keys), BLOCK, X.FUSED_MIN_LOW, X.OVERRIDE_SINGLE)
    free = align.frontier(found.where(~gate).select(*keys), BLOCK, X.FUSED_MIN, 1.0, gated=False)
    walked = land(walked.unionByName(alone).unionByName(free), "walked")
    kept = land(align.deoverlap(walked, BLOCK), "kept")

    texts = spans.select(*BLOCK, F.col("s").cast("long"), F.col("e").cast("long"), "span").distinct()
    english = given.english.select("episode", "i", "english")
    stage = F.when(single, "sliding_sonar").otherwise("sliding_fused").alias("stage")
    rows = kept.join(texts, [*BLOCK, "s", "e"]).join(low, "language").join(english, ["episode", "i"])
    accepted = rows.select(*BLOCK, "i", "english", F.col("span").alias("text"), F.col("sim").alias("similarity"), F.lit(True).alias("aligned"), stage, _least(options).alias("threshold"))

    compared = align.compared(found.select(*keys), walked, kept, BLOCK).join(texts, [*BLOCK, "s", "e"]).join(english, ["episode", "i"])
    compared = compared.select(*BLOCK, "i", "english", F.col("span").alias("text"), "similarity", "raw_similarity", "aligned")

    words = text.select(*BLOCK, "code", T.words(F.col("text")).alias("w"))
    cover = align.segments(kept.select(*BLOCK, "s", "e"), words.select(*BLOCK, F.size("w").cast("long").alias("n")).where("n > 0"), BLOCK)
    cover = cover.join(words, BLOCK).withColumn("text", F.expr("array_join(slice(w, int(s) + 1, int(e - s)), ' ')")).drop("w")
    cover = cover.join(kept.select(*BLOCK, "s", "i", F.round("sim", 4).alias("similarity")), [*BLOCK, "s"], "left")
    cover = cover.join(english, ["episode", "i"], "left").drop("i")
    return accepted, cover.withColumn("sentence_id", _id(F.col("language"), "text", F.col("code"))).drop("code"), compared


def _id(language: Column, text: str, code: Column) -> Column:
    return T.sentence_id(language, F.col("episode"), T.normalize(F.col(text), code))


def topk(given: Sides, options: Options, without: DataFrame | None = None) -> tuple[Callable[[float], DataFrame], Callable[[DataFrame], DataFrame]]:
    """Reciprocal top-k of each language's sentences with the English ones, the latter less those of ``without``.

    Ranks are computed once; the two functions give the matches for a threshold, and one compared row per English sentence.
    """
    left = given.english.join(given.others.select(*BLOCK).distinct(), EPISODE)
    if without is not None:
        left = left.join(without.select(*BLOCK, "i").distinct(), [*BLOCK, "i"], "left_anti")
    ranks = land(similarity.ranked(left.select(*BLOCK, "i", "v"), given.others.select(*BLOCK, "j", "v"), BLOCK, options.top_k), "ranks")
    low = F.broadcast(given.dim.select("language", "low_resource"))

    def texts(rows: DataFrame) -> DataFrame:
        return rows.join(given.english.select("episode", "i", "english"), ["episode", "i"]).join(given.others.select(*BLOCK, "j", "text"), [*BLOCK, "j"])

    def matches(threshold: float) -> DataFrame:
        least = F.when(F.col("low_resource"), X.THRESHOLD_LOW).otherwise(threshold)
        found = similarity.mutual(ranks, BLOCK, options.top_k, -2.0).join(low, "language", "left").na.fill({"low_resource": False})
        found = found.withColumn("threshold", least).where(F.col("sim") >= F.col("threshold"))
        if options.top_k > 1:
            found = similarity.usage_capped(found, BLOCK, options.max_usage)
        stage = F.lit("mutual_topk_cosine").alias("stage")
        return texts(found).select(*BLOCK, "i", "j", "english", "text", F.col("sim").alias("similarity"), F.lit(True).alias("aligned"), stage, "threshold")

    def compared(accepted: DataFrame) -> DataFrame:
        rows = similarity.all_compared(ranks, accepted.select(*BLOCK, "i", "j", F.col("similarity").alias("sim")), BLOCK, side="i")
        return texts(rows).select(*BLOCK, "i", "english", "text", "similarity", F.round("raw_similarity", 4).alias("raw_similarity"), "aligned")

    return matches, compared


def align_all(transcripts: DataFrame, first: Callable, second: Callable, options: Options = Options(), tokenize: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:  # noqa: B008
    """Tables of a run: sentences, segments, candidates (with is_selected_best), pairs, complete (a row per English sentence, whatever its score), sliding and topk (both legs)."""
    sentences = land(sentence_table(transcripts, tokenize), "sentences")
    given = sides(sentences, first, second)
    spans, segments, compared = sliding(given, transcripts, first, second, options)
    spans = land(spans, "accepted")
    rest_matches, rest_compared = topk(given, options, without=spans)
    full_matches, full_compared = topk(given, options)
    rest, full = land(rest_matches(options.threshold), "leftover"), land(full_matches(options.threshold), "full")
    leg = spans.unionByName(rest.drop("j")).withColumn("stage", F.lit("sliding"))
    found = leg.select(*BLOCK).union(full.select(*BLOCK)).distinct()
    again = land(full_matches(min(options.threshold, X.THRESHOLD_FALLBACK)).join(found, BLOCK, "left_anti"), "fallback")
    every = leg.withColumn("ordinal", F.lit(0)).unionByName(full.unionByName(again).drop("j").withColumn("ordinal", F.lit(1)))
    candidates = align.both_candidates(every, [*BLOCK, "i"], options.allow_override, options.margin)

    legs = [(compared, "sliding"), (rest_compared(rest), "sliding"), (full_compared(full), "mutual_topk_cosine"), (full_compared(again).join(found, BLOCK, "left_anti"), "mutual_topk_cosine")]
    complete = corpus.union_episodes([rows.withColumns({"stage": F.lit(stage), "ordinal": F.lit(n), "threshold": F.lit(None).cast("double")}) for n, (rows, stage) in enumerate(legs)])
    complete = align.collapse(complete, [*BLOCK, "i"]).drop("ordinal", "threshold")

    dim = F.broadcast(given.dim.select("language", "code"))

    def named(rows: DataFrame) -> DataFrame:
        """With both sentence ids."""
        rows = rows.join(dim, "language", "left").withColumn("code", F.coalesce("code", F.lit("unk")))
        return rows.withColumns({"sentence_id": _id(F.col("language"), "text", F.col("code")), "English_sentence_id": _id(F.lit("English"), "english", F.lit("eng"))}).drop("code")

    pairs = candidates.where("is_selected_best").drop("is_selected_best", "ordinal").join(dim, "language", "left")
    pairs = pairs.withColumn("text", T.normalize(F.col("text"), F.coalesce("code", F.lit("unk")))).drop("code")
    pairs = pairs.where("length(text) > 0 and length(english) > 0 and similarity is not null")
    legs = {"sliding": leg, "topk": full.unionByName(again).drop("j")}
    return {"sentences": sentences, "segments": segments, "candidates": named(candidates), "pairs": named(pairs), "complete": named(complete)} | {k: named(v) for k, v in legs.items()}


def wide_table(pairs: DataFrame, names: list[str], share: float | None = None) -> DataFrame:
    """One row per episode and English text, a list of texts and a list of ids per language."""
    both = pairs.groupBy("episode", F.col("english").alias("English"), "English_sentence_id").pivot("language", names).agg(F.array_sort(F.collect_set(F.struct("text", "sentence_id"))))
    columns = []
    for n in names:
        cell = F.when(F.size(n) > 0, F.col(n))
        columns += [F.transform(cell, lambda x: x["text"]).alias(n), F.transform(cell, lambda x: x["sentence_id"]).alias(f"{n}_sentence_ids")]
    table = both.select("episode", "English", *columns, "English_sentence_id")
    return table if share is None else corpus.enough_languages(table, names, share)
