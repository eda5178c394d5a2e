"""Similarity joins within blocks: threshold joins, top-k either way, reciprocal matches.

``left`` has (block..., i, v) and ``right`` (block..., j, v); null vectors meet
nothing. All ties go to the smaller index. Blocks are equi-join keys, so pairs
across blocks never form. A block is dealt out over tiles of at most ``TILE``
rows a side; a tile is a matrix product, and only what its rows and columns may
need (the k best of each, or what reaches the threshold) leaves it, so that no
table of all pairs is ever made and a block of any size is many small tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from polyweave.functions import text as T
from polyweave.functions import vectors as V
from polyweave.shipping import ship
from polyweave.tables import land

#: Rows of a side in one tile.
TILE = 2048

#: Positions (row of the left, row of the right) and scores of the pairs that a tile gives out.
Picker = Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray, list[np.ndarray]]]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row; of equal ones the first."""
    if k >= rows.shape[1]:
        return np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    if k == 1:
        return rows.argmax(axis=1)[:, None]
    return np.argsort(-rows, axis=1, kind="stable")[:, :k]


def _tiles(left: DataFrame, right: DataFrame, block: list[str], pick: Picker, scores: list[str]) -> DataFrame:
    """(block, i, j, scores...) of the pairs that ``pick`` chooses in each tile; rows come to it by ascending index."""
    ship(left.sparkSession)
    left, right = left.where("v is not null"), right.where("v is not null")
    parts = lambda side, name: side.groupBy(*block).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    deal = parts(left, "_lp").join(parts(right, "_rp"), block)  # a row per block
    spread = lambda side, own, of, n, other, m: side.join(deal, block).withColumn(own, F.pmod(F.hash(of), n)).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_lp", "_rp")
    keys = [*block, "_l", "_r"]
    own = lambda side: side.select(*(F.col(c).alias(c) for c in side.columns)).groupBy(*keys)  # noqa: E731  columns of its own, if both sides come of one table
    a, b = own(spread(left, "_l", "i", "_lp", "_r", "_rp")), own(spread(right, "_r", "j", "_rp", "_l", "_lp"))
    fields = [left.schema[c] for c in block] + [left.schema["i"], right.schema["j"]]
    schema = StructType([*fields, *(StructField(s, DoubleType()) for s in scores)])

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        x, y = x.sort_values("i"), y.sort_values("j")
        r, c, values = pick(x, y)
        out = {n: x[n].to_numpy()[r] for n in block} | {"i": x["i"].to_numpy()[r], "j": y["j"].to_numpy()[c]}
        return pd.DataFrame(out | dict(zip(scores, values)))

    return a.cogroup(b).applyInPandas(run, schema)


def _scores(x: pd.DataFrame, y: pd.DataFrame, digits: int, v: str = "v") -> np.ndarray:
    return np.round(_matrix(x[v]) @ _matrix(y[v]).T, digits) + 0.0


def scores(left: DataFrame, right: DataFrame, block: list[str], least: float, digits: int = 6) -> DataFrame:
    """(block, i, j, sim) for the pairs of a block with a rounded score of ``least`` or more."""

    def pick(x: pd.DataFrame, y: pd.DataFrame):
        s = _scores(x, y, digits)
        r, c = np.nonzero(s >= least)
        return r, c, [s[r, c]]

    return _tiles(left, right, block, pick, ["sim"])


def _rank(block: list[str], side: str, other: str) -> Column:
    return F.row_number().over(Window.partitionBy(*block, side).orderBy(F.desc("sim"), other))


def ranked(left: DataFrame, right: DataFrame, block: list[str], k: int, digits: int = 6) -> DataFrame:
    """(block, i, j, sim, f, b) for pairs among the k best of i or of j; f and b are their ranks there.

    A rank beyond k may be too small, as pairs in between may be missing.
    """

    def pick(x: pd.DataFrame, y: pd.DataFrame):
        s = _scores(x, y, digits)
        keep = np.zeros(s.shape, bool)
        np.put_along_axis(keep, _best(s, k), True, axis=1)
        np.put_along_axis(keep, _best(s.T, k).T, True, axis=0)
        r, c = np.nonzero(keep)
        return r, c, [s[r, c]]

    pairs = _tiles(left, right, block, pick, ["sim"])
    return pairs.withColumns({"f": _rank(block, "i", "j"), "b": _rank(block, "j", "i")}).where((F.col("f") <= k) | (F.col("b") <= k))


def forward(ranks: DataFrame, block: list[str], k: int, least: float) -> DataFrame:
    """The k best of each i, ``ranks`` being ``ranked`` with that k or more."""
    return ranks.where((F.col("f") <= k) & (F.col("sim") >= least)).select(*block, "i", "j", "sim", F.col("f").alias("r"))


def backward(ranks: DataFrame, block: list[str], k: int, least: float) -> DataFrame:
    return ranks.where((F.col("b") <= k) & (F.col("sim") >= least)).select(*block, "i", "j", "sim", F.col("b").alias("r"))


def mutual(ranks: DataFrame, block: list[str], k: int, least: float) -> DataFrame:
    """Pairs in the top k both ways."""
    return ranks.where((F.col("f") <= k) & (F.col("b") <= k) & (F.col("sim") >= least)).select(*block, "i", "j", "sim")


def usage_capped(matches: DataFrame, block: list[str], most: int) -> DataFrame:
    """Matches by descending score while both ends are used less than ``most`` times; needed for k > 1 only.

    By rounds: a match that is among the best of both its ends, as many as they may still take, is one that a walk in
    order would take too; those of which an end is used up go. Each round is two windows over what is left.
    """
    now = land(matches.withColumn("_taken", F.lit(False)), "matches")
    sides = {"i": Window.partitionBy(*block, "i"), "j": Window.partitionBy(*block, "j")}
    while True:
        used = {s: F.count_if("_taken").over(w) for s, w in sides.items()}
        place = {s: F.row_number().over(w.orderBy(F.desc("_taken"), F.desc("sim"), "i", "j")) for s, w in sides.items()}
        now = now.withColumns({f"_u{s}": c for s, c in used.items()}).where(F.col("_taken") | ((F.col("_ui") < most) & (F.col("_uj") < most)))
        now = now.withColumns({f"_p{s}": c for s, c in place.items()})
        now = now.withColumn("_taken", F.col("_taken") | ((F.col("_pi") <= most) & (F.col("_pj") <= most))).select(*matches.columns, "_taken")
        now = land(now, "matches")
        if not now.where("not _taken").head(1):
            return now.drop("_taken")


def all_compared(ranks: DataFrame, accepted: DataFrame, block: list[str], side: str = "j", band: float = 0.5) -> DataFrame:
    """One row per j (or i): its accepted partner, else the best one with the score shown reduced."""
    other, place = ("i", "b") if side == "j" else ("j", "f")
    best = ranks.where(F.col(place) == 1).select(*block, "i", "j", "sim")
    one = accepted.groupBy(*block, side).agg(F.max_by(F.struct(other, "sim"), F.struct(F.col("sim"), -F.col(other))).alias("a"))
    rows = best.join(one, [*block, side], "left")
    aligned = F.col("a").isNotNull()
    raw = F.coalesce("a.sim", "sim")
    return rows.select(*block, side, F.coalesce(f"a.{other}", other).alias(other), raw.alias("raw_similarity"), T.display_similarity(raw, aligned, band).alias("similarity"), aligned.alias("aligned"))


def leftover(left: DataFrame, right: DataFrame, covered: DataFrame, block: list[str], k: int, least: float) -> DataFrame:
    """Reciprocal matches among the j that ``covered`` has not; they are ranked anew."""
    rest = right.join(covered.select(*block, "j").distinct(), [*block, "j"], "left_anti")
    return mutual(ranked(left, rest, block, k), block, k, least)


def shortlist(left: DataFrame, right: DataFrame, block: list[str], k: int, digits: int | None = 6) -> DataFrame:
    """(block, i, j, sim, second, r): the k best partners of each i by the first score, with the second one; vectors are (v, w)."""

    def pick(x: pd.DataFrame, y: pd.DataFrame):
        first = _matrix(x["v"]) @ _matrix(y["v"]).T
        second = _matrix(x["w"]) @ _matrix(y["w"]).T
        if digits is not None:
            first, second = np.round(first, digits) + 0.0, np.round(second, digits) + 0.0
        c = _best(first, k)
        r = np.repeat(np.arange(len(x)), c.shape[1])
        c = c.ravel()
        return r, c, [first[r, c], second[r, c]]

    return _tiles(left, right, block, pick, ["sim", "second"]).withColumn("r", _rank(block, "i", "j")).where(F.col("r") <= k)


def rerank(left: DataFrame, right: DataFrame, block: list[str], k: int, digits: int = 6) -> DataFrame:
    """Best partner per i by fused score over its k best by the first score; vectors are (v, w)."""
    fused = shortlist(left, right, block, k, digits).withColumn("sim", F.round(V.fuse(F.col("sim"), F.col("second")), digits + 2))
    return fused.withColumn("r", _rank(block, "i", "j")).where("r = 1").select(*block, "i", "j", "sim")
