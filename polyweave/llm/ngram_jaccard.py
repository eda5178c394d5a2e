"""Exact Jaccard join of documents on word shingles, and its connected components.

A document's set holds its distinct shingles of ``size`` lower-cased words; with
fewer words, the whole sequence as one. Two documents link when their sets
overlap in at least ``percent`` per cent of their union. Words are maximal runs
of bytes outside 0x20 and 0x09-0x0D; A-Z are lower-cased.

Method: prefix filtering with set-relation skipping.

1. A sketch of all sets tells which shingles are certainly unique and which are
   very frequent. Sets order their shingles by (unique, repeated, frequent),
   then by hash. Linked sets share a shingle among the first
   ``n - ceil(t n) + 1`` of both; unique ones have no list and are skipped, so
   most documents drop out here without being shuffled.
2. Equal sets become one, known by the number of one of its rows.
3. Index lists: per shingle the sets by size, with the first position that any
   set of that size has it at. A set skips a whole size block when even this
   position leaves too few shingles; a set that skips every block leaves the
   list. Those that stay are compared with one set of the list, its hub.
4. The comparison with the hub yields the set as a difference from the hub
   (what it lacks, what it adds). Linked members are in the hub's component and
   need no comparison among each other. For the others the overlaps are derived
   from the hub's answer: the hub's size, less what either lacks, plus what both
   lack and what both add, looked up in lists of the differences only.
5. Links that join two components become edges; alternating star contraction
   yields the components.

Every linked pair shares a list of step 3 and so a hub, so no link between
different sets is missed. Rows grow with list entries, not with pairs: a hub's
members are dealt out in blocks, and only members outside the hub's component
meet all blocks. The sketch as broadcast has ``2**bits`` cells (28: 32 MB); more
are counted with more text, so that only shingles that do repeat fill it. Where
there are too many of these, fewer sets drop out in step 1.

Defined results: null, empty and blank texts have size 0 and stand alone; a
null id counts as the largest, so a component of null ids only is null; rows
that repeat an id, null included, are documents of their own and share a
component if their texts link. ``keep_first`` leaves all rows without words and
of every component one row: of the smallest id, of its rows that of the smallest
hash of the text, of equal rows one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyweave.llm import arrowkit as A
from polyweave.llm import sketch as S
from polyweave.llm import textkit as T
from polyweave.llm.graph import components
from polyweave.llm.tables import NO_ID, keyed, land, set_aside, ship

#: Members of a hub that one task compares with as many others.
BLOCK = 2048

#: Estimated count from which a shingle is ordered last.
FREQUENT = 64

_SETS = pa.schema([
    ("row", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("n", pa.int32()),
    ("u", pa.int32()), ("toks", pa.list_(pa.int64())), ("grams", pa.binary()),
])
_SETS_SQL = "row long, doc long, tag long, fp1 long, fp2 long, n int, u int, toks array<long>, grams binary"
_STAR = pa.schema([
    ("hub", pa.int64()), ("sid", pa.int64()), ("nh", pa.int32()), ("n", pa.int32()),
    ("core", pa.bool_()), ("lacks", pa.binary()), ("adds", pa.binary()),
])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts' sorted distinct shingle hashes end to end, and their offsets; slice by slice."""
    raw, offsets = T.text_buffer(texts)
    for lo, hi in T.slices(offsets):
        part = T.LOWER[raw[offsets[lo] : offsets[hi]]]
        starts, ends, at = T.word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        hashes = T.word_hashes(part, starts, ends)
        words = np.diff(at)
        grams = T.ngrams(hashes, size, T.BASES[0])
        row = T.row_of(at)
        keep = row[: len(grams)] == row[size - 1 : size - 1 + len(grams)]
        flat, count = grams[keep], np.maximum(words - size + 1, 0)
        offs = np.concatenate(([0], np.cumsum(count)))
        short = np.flatnonzero((words > 0) & (words < size))
        if len(short):  # the whole sequence as one shingle, told apart by its length
            own = np.empty(len(short), np.uint64)
            for k in range(1, size):
                mine = words[short] == k
                own[mine] = T.mix64(T.ngrams(hashes, k, T.BASES[1])[at[short[mine]]] + np.uint64(k))
            flat = np.insert(flat, offs[short], own)
            count[short] = 1
            offs = np.concatenate(([0], np.cumsum(count)))
        new = np.ones(len(flat), dtype=bool)
        for i in np.flatnonzero(count > 1):
            flat[offs[i] : offs[i + 1]].sort()
        new[1:] = flat[1:] != flat[:-1]
        new[offs[:-1][count > 0]] = True
        offs = np.concatenate(([0], np.cumsum(new)))[offs]
        yield flat[new], offs


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Wrapping sum of every row's values."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _profile(planes: S.Planes, rows: np.ndarray, b: pa.RecordBatch, flat: np.ndarray, offs: np.ndarray, percent: int) -> pa.RecordBatch:
    """Fingerprint and size of every set; prefix shingles and the set itself for those that may have links."""
    n = np.diff(offs)
    fp1 = _sums(T.mix64(flat), offs).view(np.int64)
    fp2 = _sums(T.mix64(flat ^ np.uint64(T.BASES[1])), offs).view(np.int64)
    repeated = planes.repeated(flat)
    unique = n - _sums(repeated.astype(np.int64), offs)
    prefix = n - (percent * n + 99) // 100 + 1
    may = (n > 0) & (unique < prefix)
    order = np.lexsort((fp2, fp1))  # of equal sets the first stands for this batch
    same = (fp1[order][1:] == fp1[order][:-1]) & (fp2[order][1:] == fp2[order][:-1])
    may[order[1:][same]] = False
    toks, grams = [None] * len(n), [None] * len(n)
    for i in np.flatnonzero(may):
        own = flat[offs[i] : offs[i + 1]]
        shared = own[repeated[offs[i] : offs[i + 1]]]
        most = planes.is_heavy(shared)
        toks[i] = np.concatenate((shared[~most], shared[most]))[: prefix[i] - unique[i]].view(np.int64)
        grams[i] = own.tobytes()
    return A.batch(_SETS, rows, b.column(0), b.column(1), fp1, fp2, n.astype(np.int32), unique.astype(np.int32), toks, grams)


def _differences(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Every member of a hub as what it lacks and adds."""
    for b in batches:
        nh, n, core, lacks, adds = [], [], [], [], []
        for own, hub in zip(b.column(2), b.column(3)):
            x, h = (np.frombuffer(s.as_buffer(), np.uint64) for s in (own, hub))
            both = np.concatenate((x, h))
            both.sort()
            shared = both[1:][both[1:] == both[:-1]]
            core.append((100 + percent) * len(shared) >= percent * (len(x) + len(h)))
            lacks.append(np.setdiff1d(h, shared, assume_unique=True).tobytes())
            adds.append(np.setdiff1d(x, shared, assume_unique=True).tobytes())
            nh.append(len(h))
            n.append(len(x))
        yield A.batch(_STAR, b.column(0), b.column(1), nh, n, core, lacks, adds)


class _Lists:
    """Index lists of difference shingles: which members have one."""

    def __init__(self, column: pa.Array):
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in column]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.keys, first = np.unique(flat[order], return_index=True)
        self.at = np.append(first, len(flat))

    def shared(self, tokens: np.ndarray, members: int) -> np.ndarray:
        """How many of ``tokens`` each member has."""
        if not len(self.keys) or not len(tokens):
            return np.zeros(members, np.int64)
        k = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        k = k[self.keys[k] == tokens]
        hit = [self.owner[self.at[i] : self.at[i + 1]] for i in k]
        return np.bincount(np.concatenate(hit), minlength=members) if hit else np.zeros(members, np.int64)


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges between members of one hub, at most one per pair of components met."""
    out_a, out_b = [], []
    for t in A.groups(batches, ["hub", "q", "t"]):
        t = t.combine_chunks()
        role = A.ints(t["role"].combine_chunks())
        queries, targets = (t.filter(pa.array(role == r)).combine_chunks() for r in (0, 1))
        if not queries.num_rows or not targets.num_rows:
            continue
        targets = targets.sort_by("n")
        m, nh = targets.num_rows, int(targets["nh"][0].as_py())
        n, sid = (A.ints(targets[c].combine_chunks()) for c in ("n", "sid"))
        core = A.ints(targets["core"].combine_chunks())
        lacking, adding = _Lists(targets["lacks"].combine_chunks()), _Lists(targets["adds"].combine_chunks())
        nodes, place = np.unique(np.concatenate((sid, A.ints(queries["sid"].combine_chunks()))), return_inverse=True)
        label = np.arange(1, len(nodes) + 1)
        label[place[:m][core]] = 0  # the hub's component
        for i, (qn, lacks, adds) in enumerate(zip(A.ints(queries["n"].combine_chunks()), queries["lacks"].combine_chunks(), queries["adds"].combine_chunks())):
            lo, hi = np.searchsorted(n, -(-percent * int(qn) // 100)), np.searchsorted(n, 100 * int(qn) // percent, side="right")
            if lo >= hi:
                continue
            lacks, adds = (np.frombuffer(s.as_buffer(), np.uint64) for s in (lacks, adds))
            need = percent * (int(qn) + n[lo:hi])
            most = nh - np.maximum(lacking.sizes[lo:hi], len(lacks)) + np.minimum(adding.sizes[lo:hi], len(adds))
            me = place[m + i]
            may = ((100 + percent) * most >= need) & (label[place[lo:hi]] != label[me])
            if not may.any():
                continue
            overlap = nh - len(lacks) - lacking.sizes + lacking.shared(lacks, m) + adding.shared(adds, m)
            linked = np.flatnonzero(may & ((100 + percent) * overlap[lo:hi] >= need)) + lo
            for other in np.unique(label[place[linked]]):
                if other == label[me]:
                    continue
                y = linked[label[place[linked]] == other][0]
                out_a.append(int(nodes[me]))
                out_b.append(int(sid[y]))
                label[label == max(other, label[me])] = min(other, label[me])
        if len(out_a) >= 10_000:
            yield A.batch(_EDGES, out_a, out_b)
            out_a, out_b = [], []
    yield A.batch(_EDGES, out_a, out_b)


def _components(documents: DataFrame, size: int, percent: int, bits: int | None) -> DataFrame:
    """(doc, tag, n, label, component) for each row of ``documents(doc_id, text)``: the component's number and smallest id."""
    spark = documents.sparkSession
    ship(spark)
    docs = keyed(documents, F.col("doc_id").cast("long").alias("id")).select("id", "tag", "text")
    bits = bits or S.bits_for(documents, 1, 28)
    fine = S.fine_for(documents, 1, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = S.Counter(bits, 1, fine=fine)
        for b in batches:
            for flat, _ in shingle_sets(b.column(0), size):
                yield from counter.add(flat)
        yield from counter.rows()

    planes = spark.sparkContext.broadcast(S.merge(docs.select("text").mapInArrow(count, S.PARTIAL), bits, 1, heavy=FREQUENT, fine=fine))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            flat, offs = (list(x) for x in zip(*shingle_sets(b.column(2), size)))
            ends = np.cumsum([0, *(o[-1] for o in offs)])
            offs = np.concatenate([o[:-1] + e for o, e in zip(offs, ends)] + [ends[-1:]])
            yield _profile(planes.value, np.arange(at, at + b.num_rows), b, np.concatenate(flat), offs, percent)
            at += b.num_rows

    sets = land(docs.mapInArrow(profile, _SETS_SQL), "sets")
    planes.destroy()
    fp = ["fp1", "fp2"]
    stands = F.min(F.when(F.col("toks").isNotNull(), F.col("row"))).alias("sid")
    classes = land(sets.where("n > 0").groupBy(*fp).agg(F.min("row").alias("row"), stands, F.min("doc").alias("doc")), "classes")
    own = sets.where("toks is not null").join(classes.select("sid").where("sid is not null"), F.col("row") == F.col("sid"))
    own = land(own.select("sid", "n", "u", "toks", "grams"), "representatives")

    entries = own.select("sid", "n", "u", F.posexplode("toks").alias("k", "tok")).withColumn("pos", F.col("u") + F.col("k"))
    blocks = entries.groupBy("tok", "n").agg(F.min("pos").alias("p"), F.count("*").alias("c"), F.min("sid").alias("s"))
    lists = land(
        blocks.groupBy("tok").agg(F.min("s").alias("hub"), F.sum("c").alias("m"), F.collect_list(F.struct("n", "p", "c")).alias("blocks"))
        .where("m > 1").drop("m"), "lists",
    )
    stays = F.expr(
        f"exists(blocks, b -> (b.n <> n or b.c > 1) and 100L * least(b.n, n) >= {percent}L * greatest(b.n, n)"
        f" and {100 + percent}L * least(n - pos, b.n - b.p) >= {percent}L * (n + b.n))"
    )
    members = entries.join(lists, "tok").where(stays & (F.col("hub") != F.col("sid"))).select("hub", "sid").distinct()
    pairs = (
        members.join(own.select("sid", F.col("grams").alias("x")), "sid")
        .join(own.select(F.col("sid").alias("hub"), F.col("grams").alias("h")), "hub").select("hub", "sid", "x", "h")
    )
    star_schema = "hub long, sid long, nh int, n int, core boolean, lacks binary, adds binary"
    star = land(pairs.mapInArrow(lambda it: _differences(it, percent), star_schema), "star")

    deal = land(
        star.groupBy("hub").agg(F.count("*").alias("m"), F.count_if(~F.col("core")).alias("o")).where("o > 0 and m > 1")
        .select("hub", F.ceil(F.col("m") / BLOCK).cast("int").alias("tb"), F.ceil(F.col("o") / BLOCK).cast("int").alias("qb")), "deal",
    )
    dealt = star.join(deal, "hub").withColumn("k", F.hash("sid"))
    columns = ["hub", "q", "t", "role", "sid", "nh", "n", "core", "lacks", "adds"]
    queries = dealt.where(~F.col("core")).withColumns({"q": F.pmod("k", "qb"), "role": F.lit(0)}).withColumn("t", F.explode(F.expr("sequence(0, tb - 1)")))
    targets = dealt.withColumns({"t": F.pmod("k", "tb"), "role": F.lit(1)}).withColumn("q", F.explode(F.expr("sequence(0, qb - 1)")))
    rest = queries.select(*columns).union(targets.select(*columns)).repartition("hub", "q", "t").sortWithinPartitions("hub", "q", "t")
    edges = star.where("core").select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    edges = edges.union(rest.mapInArrow(lambda it: _links(it, percent), "a long, b long"))

    linked = land(components(edges).join(classes.select("sid", "doc"), F.col("node") == F.col("sid")).select("sid", "component", "doc"), "linked")
    least = linked.groupBy("component").agg(F.min("doc").alias("least"))
    linked = linked.select("sid", "component").join(least, "component")
    found = classes.join(linked, "sid", "left")
    least = F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("least"))
    found = land(found.select(*fp, F.coalesce("component", "row").alias("label"), least.alias("component")), "components")
    return sets.select("doc", "tag", *fp, "n").join(found, fp, "left").select("doc", "tag", "n", "label", "component")


def jaccard_components(documents: DataFrame, size: int = 5, percent: int = 80, bits: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``documents(doc_id, text)``."""
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id")
    return _components(documents, size, percent, bits).select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component)


def keep_first(documents: DataFrame, size: int = 5, percent: int = 80, bits: int | None = None) -> DataFrame:
    """``documents`` without words, and one row of every component of the others."""
    rows, back = set_aside(documents)
    found = _components(rows, size, percent, bits).where(F.col("doc").eqNullSafe(F.col("component")) & (F.col("n") > 0))
    first = found.groupBy("label").agg(F.coalesce(F.min("doc"), F.lit(NO_ID)).alias("doc"), F.min("tag").alias("tag")).select("doc", "tag")
    word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    whole = keyed(rows, F.struct(*(F.col(c) for c in rows.columns)).alias("_row"), word.alias("_word"))
    one = whole.where("_word").groupBy("doc", "tag").agg(F.first("_row").alias("_row")).join(first, ["doc", "tag"]).select("_row.*")
    return rows.where(~word).union(one).select(*back)


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: the size of its set and its component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The query's rows where ids are given and differ.
ORACLE = r"""
with recursive split as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
    select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from split where len(w) > 0)
), sizes as (
    select doc_id, count(*) as n from shingles group by 1
), classes as (
    select doc_id, n, min(doc_id) over (partition by n, digest) as rep from (select doc_id, count(*) as n, list(s order by s) as digest from shingles group by 1)
), pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
    where a.doc_id in (select rep from classes) and b.doc_id in (select rep from classes) group by 1, 2
), links as (
    select a, b from pairs join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * shared >= 80 * (x.n + y.n - shared)
), ways as (
    select a, b from links union select b, a from links
), reached(doc_id, other) as (
    select a, b from ways union select r.doc_id, w.b from reached r join ways w on r.other = w.a
), least as (
    select doc_id, least(doc_id, min(other)) as component from reached group by 1
)
select d.doc_id, coalesce(c.n, 0)::bigint as n_shingles, coalesce(l.component, c.rep, d.doc_id)::bigint as component_id
from documents d left join classes c on d.doc_id = c.doc_id left join least l on c.rep = l.doc_id
"""
