"""Near-duplicate vectors: an exact range join in a metric space, and its components.

Vectors of equal, non-null label link when their cosine, in double precision,
is at least ``threshold``. On unit vectors that is a distance of at most
``r = sqrt(2 - 2 threshold)``. Vectors are scaled by a power of two before their
length is taken, so that no finite one over- or underflows.

Method: pivot partitioning.

1. Equal vectors become one with a weight, known by the number of one of its
   rows; within a batch before anything is moved.
2. A label of more than ``CELL`` vectors gets pivots from a sample of it by hash:
   one per ``CELL`` vectors, and with millions of vectors as many as the square
   root of their number, which balances finding cells and joining them. Each vector is at home in the cell of its nearest
   pivot, and is copied to the cells that its neighbours may be at home in: by
   the triangle inequality, and the bisector of two pivots it implies, a vector
   of cell j is at least ``(d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j))`` away.
   Pivots are ``APART`` from each other at least, so that rounding (1e-14 at
   most in a squared distance) moves this bound by far less than its slack.
3. Cells join on their own: at home against all, in blocks of ``BLOCK`` rows, by
   matrix products. A cell larger than a block is dealt out over all pairs of
   its blocks, so no task holds more than two. A vector's links are all found in
   its home cell; of the links only counts and a spanning forest leave the task.
4. Alternating star contraction of the forests yields the components.

Labels are known by a 64-bit hash whose seed is changed until it tells all of
them apart. The pivots are the only broadcast; ``PIVOT_BYTES`` bounds it: with more labels
or vectors there are fewer pivots and larger cells, with equal results. In
many dimensions vectors that are all far from each other are nearly equally
far from every pivot; cells then overlap and the join nears a blocked product
of the label with itself.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component, has a null label or a null id links with nothing and is
its own component (null for a null id); vectors of different length do not
link; rows that repeat an id are vectors of their own, and each has the links
and the component of its own vector.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyweave.llm import arrowkit as A
from polyweave.llm.graph import components
from polyweave.llm.tables import land, ship

CELL = 2048
BLOCK = 8192
PIVOT_BYTES = 32 << 20
#: Least distance of two pivots of a label.
APART = 0.01

_UNITS = pa.schema([
    ("row", pa.int64()), ("vec", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("g", pa.int64()),
    ("k1", pa.int64()), ("k2", pa.int64()), ("w", pa.int64()), ("unit", pa.binary()),
])
_UNITS_SQL = "row long, vec long, label string, dim int, g long, k1 long, k2 long, w long, unit binary"
_CELLS = pa.schema([("g", pa.int64()), ("cell", pa.int32()), ("home", pa.bool_()), ("rep", pa.int64()), ("weight", pa.int64()), ("unit", pa.binary())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long binary rows of doubles as a matrix."""
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors with a digest; of equal ones in a batch only the first keeps the vector, with their number."""
    number = TaskContext.get().partitionId() << 33
    for b in batches:
        vec, group = b.column(0), A.ints(b.column(3))
        vectors = b.column(4)
        offsets, flat = A.ints(vectors.offsets), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        ok = np.asarray(vectors.is_valid()) & np.asarray(vec.is_valid()) & np.asarray(b.column(1).is_valid())
        k1, k2, w, units = ([None] * b.num_rows for _ in range(4))
        first: dict[tuple, int] = {}
        for i in np.flatnonzero(ok & (np.diff(offsets) > 0)).tolist():
            x = flat[offsets[i] : offsets[i + 1]]
            largest = np.abs(x).max()
            if not (np.isfinite(largest) and largest > 0):
                continue
            x = np.ldexp(x, -np.frexp(largest)[1])
            unit = (x / np.sqrt(x @ x)).tobytes()
            d = hashlib.blake2b(unit, digest_size=16).digest()
            k1[i], k2[i] = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
            at = first.setdefault((int(group[i]), d), i)
            w[at] = (w[at] or 0) + 1
            if at == i:
                units[i] = unit
        yield A.batch(_UNITS, np.arange(number, number + b.num_rows), vec, b.column(1), b.column(2), b.column(3), k1, k2, w, units)
        number += b.num_rows


def _apart(pivots: list[np.ndarray]) -> np.ndarray:
    """The pivots as a matrix, without those closer than APART to one before."""
    kept, n = np.empty((len(pivots), len(pivots[0]))), 0
    for p in pivots:
        if not n or (kept[:n] @ p).max() <= 1 - APART**2 / 2:
            kept[n] = p
            n += 1
    return kept[:n]


def _assign(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], radius: float) -> Iterator[pa.RecordBatch]:
    """Home cell of every vector, and the other cells that hold vectors within the radius of it, as far as pivots can tell."""
    for b in batches:
        g, rep, weight = (A.ints(b.column(i)) for i in (0, 1, 2))
        for label in np.unique(g):
            every = np.flatnonzero(g == label)
            p = pivots.get(int(label))
            if p is None or len(p) < 2:
                yield A.batch(_CELLS, g[every], np.zeros(len(every), np.int32), [True] * len(every), rep[every], weight[every], b.column(3).take(pa.array(every)))
                continue
            for rows in np.split(every, range(512, len(every), 512)):  # two matrices of 512 by all pivots at a time
                units = b.column(3).take(pa.array(rows))
                far = np.maximum(2 - 2 * (_matrix(units) @ p.T), 0)
                home = far.argmin(axis=1)
                apart = np.maximum(2 - 2 * (p[home] @ p.T), APART**2 / 2)  # squared distances of the pivots; of one and itself it is not used
                line = np.arange(len(rows))
                goes = (far - far[line, home][:, None]) / (2 * np.sqrt(apart)) <= radius
                goes[line, home] = True
                x, cell = np.nonzero(goes)
                yield A.batch(_CELLS, g[rows][x], cell.astype(np.int32), cell == home[x], rep[rows][x], weight[rows][x], units.take(pa.array(x)))


def _join(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of every vector at home in a block, and a spanning forest of them."""
    for t in A.groups(batches, ["g", "cell", "i", "j"]):
        t = t.combine_chunks()
        role = A.ints(t["role"].combine_chunks())
        ids, weights = A.ints(t["rep"].combine_chunks()), A.ints(t["weight"].combine_chunks())
        units = _matrix(t["unit"].combine_chunks())
        ours, theirs = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        if not len(ours) or not len(theirs):
            continue
        nodes, place = np.unique(ids, return_inverse=True)
        label = np.arange(len(nodes))
        links = np.zeros(len(ours), np.int64)
        for lo in range(0, len(ours), 512):
            mine = ours[lo : lo + 512]
            near = units[mine] @ units[theirs].T >= threshold
            near &= ids[mine][:, None] != ids[theirs][None, :]
            links[lo : lo + 512] = near @ weights[theirs]
            for k in np.flatnonzero(near.any(axis=1)):
                met = np.unique(label[place[theirs[near[k]]]])
                met = np.union1d(met, label[place[mine[k]]])
                if len(met) > 1:
                    to = np.arange(len(nodes))
                    to[met] = met[0]
                    label = to[label]
        joined = np.flatnonzero(label != np.arange(len(nodes)))
        zero = np.zeros(len(joined), np.int64)
        yield A.batch(_FOUND, nodes[joined], nodes[label[joined]], zero)
        yield A.batch(_FOUND, ids[ours], ids[ours], links)


def near_vectors(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings(vec_id, embedding, label)``."""
    spark = embeddings.sparkSession
    ship(spark)
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    label, dim = F.col("label").cast("string"), F.size("embedding")
    for seed in itertools.count():
        group = F.xxhash64(F.lit(seed), label, dim).alias("g")
        given = embeddings.select(F.col("vec_id").cast("long").alias("vec"), label.alias("label"), dim.alias("dim"), group, F.col("embedding").cast("array<double>"))
        vectors = land(given.mapInArrow(_units, _UNITS_SQL), "vectors")
        if not vectors.where("k1 is not null").select("g", "label", "dim").distinct().groupBy("g").count().where("count > 1").head(1):
            break
    key = ["g", "k1", "k2"]
    whole = vectors.where("unit is not null").groupBy(*key)
    reps = land(whole.agg(F.min("row").alias("rep"), F.sum("w").alias("weight"), F.first("unit").alias("unit")), "representatives")

    wanted = F.ceil(F.least(F.col("n") / CELL, F.sqrt("n"))).cast("double")
    sizes = reps.groupBy("g").agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("bytes")).where(F.col("n") > CELL)
    sizes = sizes.withColumn("k", wanted).withColumn("all", F.sum(F.col("k") * F.col("bytes")).over(Window.partitionBy()))
    sizes = land(sizes.withColumn("k", F.floor(F.col("k") * F.least(F.lit(1.0), PIVOT_BYTES / F.col("all")))).where("k >= 2"), "sizes")
    turn = F.xxhash64(F.lit(6), "rep")
    some = reps.join(sizes.select("g", "n", "k"), "g").withColumn("turn", turn)
    some = some.where(F.pmod("turn", F.lit(1 << 20)) < F.ceil(F.col("k") * 4 * (1 << 20) / F.col("n")))  # a few times as many as wanted
    first = F.row_number().over(Window.partitionBy("g").orderBy("turn", "rep"))
    some = some.select("g", "rep", "k", "turn", "unit").withColumn("at", first).where("at <= k").select("g", "at", "unit").collect()
    pivots: dict[int, list] = {}
    for r in sorted(some, key=lambda r: (r.g, r.at)):
        pivots.setdefault(r.g, []).append(np.frombuffer(bytes(r.unit), np.float64))
    shared = spark.sparkContext.broadcast({g: _apart(p) for g, p in pivots.items()})

    cells = reps.select("g", "rep", "weight", "unit").mapInArrow(
        lambda it: _assign(it, shared.value, radius), "g long, cell int, home boolean, rep long, weight long, unit binary"
    )
    cells = land(cells, "cells")
    deal = cells.groupBy("g", "cell").agg(F.count_if("home").alias("h"), F.count("*").alias("a")).where("a > 1")
    parts = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    deal = land(deal.select("g", "cell", parts("h").alias("hb"), parts("a").alias("ab")), "deal")
    dealt = cells.join(deal, ["g", "cell"]).withColumn("k", F.hash("rep"))
    columns = ["g", "cell", "i", "j", "role", "rep", "weight", "unit"]
    single = dealt.where("ab = 1").withColumns({"i": F.lit(0), "j": F.lit(0), "role": F.when(F.col("home"), 2).otherwise(1)})
    many = dealt.where("ab > 1")
    ours = many.where("home").withColumns({"i": F.pmod("k", "hb"), "role": F.lit(0)}).withColumn("j", F.explode(F.expr("sequence(0, ab - 1)")))
    theirs = many.withColumns({"j": F.pmod("k", "ab"), "role": F.lit(1)}).withColumn("i", F.explode(F.expr("sequence(0, hb - 1)")))
    tasks = single.select(*columns).union(ours.select(*columns)).union(theirs.select(*columns))
    order = ["g", "cell", "i", "j"]
    found = land(tasks.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _join(it, threshold), "a long, b long, links long"), "links")

    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    smallest = vectors.where("k1 is not null").groupBy(*key).agg(F.min("vec").alias("least"))
    known = reps.select(*key, "rep", "weight").join(smallest, key).join(links, "rep", "left").join(components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep"), "rep", "left")
    known = land(known.select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("of"), "least"), "known")
    names = known.groupBy("of").agg(F.min("least").alias("component"))
    out = vectors.select("vec", *key).join(known.join(names, "of").select(*key, "links", "component"), key, "left")
    component = F.coalesce("component", "vec")
    return out.select(
        F.col("vec").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec") == component).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The query's rows where ids are given and differ, and no square over- or underflows.
ORACLE = r"""
with recursive given as (
    select vec_id, label, embedding::double[] as v from embeddings where label is not null and vec_id is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), units as (
    select vec_id, label, len(v) as n, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from given
), links as (
    select a.vec_id as a, b.vec_id as b from units a join units b on a.label = b.label and a.n = b.n and a.vec_id <> b.vec_id where list_dot_product(a.u, b.u) >= 0.98
), reached(vec_id, other) as (
    select a, b from links union select r.vec_id, l.b from reached r join links l on r.other = l.a
), least as (
    select vec_id, least(vec_id, min(other)) as component from reached group by 1
), counts as (
    select a as vec_id, count(*) as n from links group by 1
)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, coalesce(l.component, e.vec_id)::bigint as component_id, coalesce(l.component, e.vec_id) = e.vec_id as kept
from embeddings e left join counts c on e.vec_id = c.vec_id left join least l on e.vec_id = l.vec_id
"""
