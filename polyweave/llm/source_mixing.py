"""Mixing sources to target weights by weighted sampling without replacement.

Each source gets a target, a share of ``total`` times all words: sources in
code point order (null last) weigh 5, 2, 1, repeating; no target exceeds
``cap`` times its source's words, and what a cap cuts off is shared again among
the others by weight. A source whose target holds it k times over is taken k
times as a whole; the rest of the target is a fraction of one more epoch.

Method: Efraimidis-Spirakis sampling. A document's key is ``-ln(u) / weight``
with u from a hash of seed and id and the weight from the quality that a model
of operator 9 predicts (``learned``; without a model all weigh the same), and
documents enter the fraction in the order of their keys until the prefix sum of
their words reaches the rest of the target; the document at the cut gives only
its first words or, where texts are to stay ``entire``, comes whole or not at
all, whichever is nearer. The keys give each document the chance that its
quality sets; reruns agree.

Size and key are computed once and written with the columns to keep. What is
gathered of them are sums per source and key range, twice: by ``RANGES`` ranges,
then by as many within the one range of each source that holds the cut. The
prefix sum row by row is over what is left, a row in ``RANGES`` squared. Each
document then decides by comparing its key with its source's cut, so that a
source of any size is neither sorted nor moved. All but the model's score runs
as DataFrame expressions. One row per source is sorted in one task.

Defined results: a null or blank text has size 0 and nothing is taken of it; a
null id hashes as the empty text; rows that repeat an id and have one quality
share one key, and those at the cut share its words evenly (entire: come all or
none). Columns of the input that have one of the added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweave.llm import quality
from polyweave.llm.tables import land, set_aside

#: Ranges into which the keys of a source are summed before its cut is sought, and again each of them.
RANGES = 4096

WORDS = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0A\x0B\x0C\x0D"
ADDED = ("size", "source_size", "target", "taken")


def words_in(text: str) -> Column:
    """Number of words, 0 for null: the length of a copy with one sign for each, as ``regexp_count`` lists all words in memory."""
    marks = F.regexp_replace(F.ltrim(F.col(text), F.lit(SPACES)), WORDS + r"[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def uniform(seed: int, key: str) -> Column:
    """A number in (0, 1) that hangs on seed and id only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, total: float = 1.5, cap: float = 2.0, weights: tuple = (5, 2, 1)) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight under the caps."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    most = F.col("source_size") * F.lit(float(cap))
    table = sizes.withColumn("w", share).withColumn("most", most).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total))
    level = (everything - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    table = table.withColumn("level", level)
    # the first source, by ratio of cap to weight, that its cap does not bind sets the level of all after it
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every)
    return table.withColumn("level", level).select("source", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def learned(score: str) -> Column:
    """Quality weight of a score of operator 9: 4 for a good text, 1 where undecided, 0.25 for a poor one."""
    return F.pow(F.lit(4.0), 2 * F.col(score) - 1)


def mix(documents: DataFrame, model: quality.Model | None = None, keep: list[str] | None = None, seed: int = 8, total: float = 1.5, cap: float = 2.0, entire: bool = False) -> DataFrame:
    """``documents`` (or their columns ``keep``) with size, source_size, target and taken (words the mix takes, repeats counted).

    ``model`` predicts the quality that weighs the rows.
    """
    others = [c for c in (documents.columns if keep is None else keep) if c.lower() not in ADDED]
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)]  # out of the way of the plan's columns
    rows = documents.select(*kept, F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text").alias("text"))
    given = [f"_c{i}" for i in range(len(others))]
    weight = F.lit(1.0)
    if model is not None:
        rows, weight = quality.score(rows, model), learned("score")
    rows = rows.withColumns({"_size": words_in("text"), "_key": -F.log(uniform(seed, "_id")) / weight})
    part = lambda n: F.floor((1 - F.exp(-F.col("_key"))) * n).cast("long")
    rows = land(rows.select(*given, "_id", "_source", "_size", "_key"), "mix")

    of = lambda c: F.col("_source").eqNullSafe(F.col(c))
    narrow = rows.select("_id", "_source", "_size", "_key", part(RANGES).alias("_part"))
    sums = land(narrow.groupBy("_source", "_part").agg(F.sum("_size").alias("words")), "mix-sums")
    plan = targets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), total, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", whole)
    plan = land(plan.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-plan")

    # the range that holds the cut, and what the ranges before it hold
    def holding(sums: DataFrame, start: DataFrame) -> DataFrame:
        upto = F.sum("words").over(Window.partitionBy("_source").orderBy("_part"))
        met = sums.withColumn("upto", upto).join(start, of("s"))
        before = F.col("base") + F.col("upto") - F.col("words")
        return met.where((before + F.col("words") > F.col("rest")) & (before <= F.col("rest"))).select("s", F.col("_part").alias("range"), before.alias("base"), "rest")

    start = plan.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("base"), "rest")
    cut = land(holding(sums, start), "mix-ranges")
    near = narrow.join(cut, of("s") & (F.col("_part") == F.col("range"))).select("_id", "_source", "_size", "_key", part(RANGES**2).alias("_part"))
    cut = land(holding(near.groupBy("_source", "_part").agg(F.sum("_size").alias("words")), cut.drop("range")), "mix-ranges")
    near = near.join(cut, of("s") & (F.col("_part") == F.col("range")))
    near = near.groupBy("s", "base", "rest", "_key", "_id").agg(F.sum("_size").alias("words"), F.count("*").alias("n"))
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("s").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, 0))
    at = near.withColumn("upto", upto).where("upto > rest and upto - words <= rest and words > 0")
    left = F.floor((F.col("rest") - F.col("upto") + F.col("words")) / F.col("n")).cast("long")
    if entire:
        left = F.when(2 * (F.col("rest") - F.col("upto") + F.col("words")) >= F.col("words"), F.lit((1 << 63) - 1)).otherwise(F.lit(0)).cast("long")
    at = at.groupBy("s").agg(F.min(F.struct(F.col("_key").alias("key"), F.coalesce("_id", F.lit(-(1 << 63))).alias("id"), left.alias("left"))).alias("cut"))
    plan = plan.join(at, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "cut")
    plan = land(plan, "mix-cuts")

    mine = F.struct(F.col("_key").alias("key"), F.coalesce("_id", F.lit(-(1 << 63))).alias("id"))
    edge = F.struct(F.col("cut.key").alias("key"), F.col("cut.id").alias("id"))
    some = F.when(F.col("rest") <= 0, 0).when(F.col("cut").isNull() | (mine < edge), F.col("_size")).when(mine == edge, F.least("_size", F.col("cut.left"))).otherwise(0)
    out = rows.join(plan, of("s"), "left").withColumns({"size": F.col("_size"), "taken": (F.col("epochs") * F.col("_size") + some).cast("long")})
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(others)), *ADDED)


def taken_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken, the one at a source's cut with its first words only."""
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    rows = mixed.where("taken > 0").withColumns({"_whole": whole, "_rest": rest})
    rows = rows.withColumn("_turn", F.explode(F.expr("sequence(1, _whole + if(_rest > 0, 1, 0))")))
    some = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.greatest("_rest", F.lit(1))), " ")
    rows = rows.withColumn("text", F.when(F.col("_turn") <= F.col("_whole"), F.col("text")).otherwise(some))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(mixed.schema["n_chars"].dataType))
    return rows.select(*columns)


def mixture(documents: DataFrame, model: quality.Model | None = None, **options) -> DataFrame:
    """The rows of the mix of ``documents``, each text entire, with the columns given; sampled by what ``model`` predicts of the texts, if given."""
    rows, back = set_aside(documents)
    return taken_rows(mix(rows, model, **{"entire": True} | options), rows.columns).select(*back)


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: its words, its source's words and target, and the words the mix takes; sampled by the quality that operator 9 learns from the labels."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(documents, model, keep=["doc_id"])


#: The mix of a table ``scored``: documents with the score of operator 9, which SQL can't express.
ORACLE = r"""
with counted as (
    select doc_id, source, score, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from scored
), base as (
    select doc_id, source, size, -ln((('0x' || substr(md5('8:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
        / pow(4.0::double, 2 * score - 1) as k
    from counted
), sizes as (
    select source, sum(size)::bigint as source_size from base group by 1
), shares as (
    select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w,
        source_size * 2.0::double as most from sizes
), levels as (
    select *, most / w as ratio, (sum(source_size) over () * 1.5::double
        - coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
        / sum(w) over (order by most / w, source nulls last rows between current row and unbounded following) as level from shares
), plan as (
    select source, source_size, least(most, w * (select level from levels where level <= ratio order by ratio, source nulls last limit 1)) as target
    from levels
), budget as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from plan
), taken as (
    select b.doc_id, b.size, p.source_size, p.target, p.epochs, floor(p.target - p.epochs * p.source_size)::bigint as rest,
        sum(b.size) over (partition by b.source order by b.k, b.doc_id rows between unbounded preceding and current row) as upto
    from base b join budget p on b.source is not distinct from p.source
)
select doc_id, size, source_size, target,
    (epochs * size + greatest(0, least(size, rest - (upto - size))))::bigint as taken from taken
"""
