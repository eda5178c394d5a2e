"""Order-constrained alignment, de-overlap, segments and the choice among candidates."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweave.functions import fixed as X
from polyweave.functions import text as T


def frontier(candidates: DataFrame, block: list[str], least: float, override: float, tolerance: int = X.TOLERANCE_WORDS, gated: bool = True) -> DataFrame:
    """Best span per sentence; with the gate, spans far behind the last accepted one need the override score.

    ``candidates`` has (block..., i, s, e, sim). The state is one number per block, folded over its sentences in order;
    a block is one paragraph.
    """
    if not gated:
        best = F.row_number().over(Window.partitionBy(*block, "i").orderBy(F.desc("sim"), "s", "e"))
        return candidates.where(F.col("sim") >= least).withColumn("r", best).where("r = 1").drop("r")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["e"], pdf["s"], -pdf["sim"], pdf["i"]))
        at, done, keep = 0, None, []
        for n, i, s, e, sim in zip(order.tolist(), *(pdf[c].to_numpy()[order].tolist() for c in ("i", "s", "e", "sim"))):
            if i != done and sim >= (least if s >= at - tolerance else override):
                keep.append(n)
                at, done = max(at, e), i
        return pdf.iloc[keep]

    return candidates.where(F.col("sim") >= min(least, override)).groupBy(*block).applyInPandas(walk, candidates.schema)


def deoverlap(accepted: DataFrame, block: list[str]) -> DataFrame:
    """Spans by descending score, each kept if it overlaps none kept before; half-open, touching is allowed.

    The kept spans of a block, one paragraph, stand sorted, so a span is compared with its two neighbours.
    """
    given = accepted.select(*block, F.col("i").cast("long"), F.col("s").cast("long"), F.col("e").cast("long"), F.col("sim").cast("double"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["e"], pdf["s"], pdf["i"], -pdf["sim"]))
        starts, ends, keep = [], [], []
        for n, s, e in zip(order.tolist(), *(pdf[c].to_numpy()[order].tolist() for c in ("s", "e"))):
            k = bisect.bisect_left(starts, s)
            if (k == 0 or ends[k - 1] <= s) and (k == len(starts) or e <= starts[k]):
                starts.insert(k, s)
                ends.insert(k, e)
                keep.append(n)
        return pdf.iloc[keep]

    return given.groupBy(*block).applyInPandas(pick, given.schema)


def compared(candidates: DataFrame, walked: DataFrame, kept: DataFrame, block: list[str]) -> DataFrame:
    """(block, i, s, e, raw_similarity, aligned, similarity): what each sentence's best candidate came to.

    That is the one the walk accepted, else the best whatever its score; aligned only if it was kept in the end.
    """
    key = [*block, "i"]
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("sim"), "s", "e"))
    best = candidates.withColumn("_r", best).where("_r = 1").select(*key, F.struct("s", "e", "sim").alias("_b"))
    mine = walked.select(*key, F.struct("s", "e", "sim").alias("_w"))
    held = kept.select(*key, "s", "e", F.lit(True).alias("_k"))
    rows = best.join(mine, key, "left").withColumn("_x", F.coalesce("_w", "_b")).select(*key, F.col("_x.s").alias("s"), F.col("_x.e").alias("e"), F.round("_x.sim", 4).alias("raw_similarity"))
    rows = rows.join(held, [*key, "s", "e"], "left").withColumn("aligned", F.coalesce("_k", F.lit(False))).drop("_k")
    return rows.withColumn("similarity", T.display_similarity(F.col("raw_similarity"), F.col("aligned")))


def segments(kept: DataFrame, lengths: DataFrame, block: list[str]) -> DataFrame:
    """(block, s, e, aligned): accepted spans and the gaps around them, covering ``lengths(block, n)`` once."""
    before = F.lag("e", 1, 0).over(Window.partitionBy(*block).orderBy("s"))
    gaps = kept.select(*block, before.alias("g"), F.col("s").alias("e")).where("g < e").select(*block, F.col("g").alias("s"), "e")
    ends = lengths.join(kept.groupBy(*block).agg(F.max("e").alias("z")), block, "left")
    tail = ends.select(*block, F.coalesce("z", F.lit(0)).alias("s"), F.col("n").alias("e")).where("s < e")
    every = kept.select(*block, "s", "e", F.lit(True).alias("aligned")).unionByName(gaps.unionByName(tail).withColumn("aligned", F.lit(False)))
    return every.withColumn("seg_idx", F.row_number().over(Window.partitionBy(*block).orderBy("s")) - 1)


def coverage(segs: DataFrame, lengths: DataFrame, block: list[str]) -> DataFrame:
    """Words covered against words there are, per block."""
    sums = segs.groupBy(*block).agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    return lengths.join(sums, block, "left").select(*block, "n", F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("covered", F.lit(0)) == F.col("n")).alias("ok"))


def _stage_rank(key: list[str], override: bool, least: float) -> Column:
    """0 and 1 for the sliding and the top-k stage; turned around for keys whose sliding row is weak, if asked."""
    stage = F.when(F.col("stage") == "mutual_topk_cosine", 1).otherwise(0)
    if override:
        sliding = (F.col("stage") != "mutual_topk_cosine") & F.col("aligned")
        best = F.max(F.when(sliding, F.struct("similarity", "threshold"))).over(Window.partitionBy(*key))
        weak = T.margin(best["similarity"], best["threshold"]) < least
        stage = F.when(F.coalesce(weak, F.lit(False)), -stage).otherwise(stage)
    return stage


def both_candidates(rows: DataFrame, key: list[str], override: bool = False, least: float = X.OVERRIDE_MARGIN) -> DataFrame:
    """All candidates with ``is_selected_best``; columns aligned, stage, similarity, threshold, ordinal."""
    staged = rows.withColumn("_stage", _stage_rank(key, override, least))
    order = Window.partitionBy(*key).orderBy(F.desc("aligned"), "_stage", F.desc_nulls_last("similarity"), "ordinal")
    return staged.withColumn("is_selected_best", F.row_number().over(order) == 1).drop("_stage")


def collapse(rows: DataFrame, key: list[str], override: bool = False, least: float = X.OVERRIDE_MARGIN) -> DataFrame:
    """The best candidate of each key."""
    return both_candidates(rows, key, override, least).where("is_selected_best").drop("is_selected_best")


def with_fallback(main: DataFrame, fallback: DataFrame, block: list[str]) -> DataFrame:
    """``main`` matches, and those of ``fallback`` for blocks without any."""
    return main.unionByName(fallback.join(main.select(*block).distinct(), block, "left_anti"))
