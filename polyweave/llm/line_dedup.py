"""Removal of lines that repeat an earlier line of the corpus, up to one edited word.

A line is a piece of the text between newlines; its words are lower-cased (A-Z)
runs of bytes outside 0x20 and 0x09-0x0D. A line of ``min_words`` words or more
(1: any that is not blank) goes if an equal line starts earlier in the corpus:
in a document with a smaller id, or in the same document above it. A line of
``near_words`` words or more also goes if an earlier line of as many words as
that turns into it by inserting, deleting or replacing one word. By default
that is 3, as any two lines of one word are an edit apart, and any two of two
words that share one; 1 compares all lines so. Lines are judged on the input,
not on what is left, and no others are removed.

Method: deletion-neighbourhood join.

1. An edit of one word leaves the first or the second half of a line intact.
   Each line enters its halves (in the lengths that an equally long, shorter
   or longer partner would use) into a sketch that counts distinct lines per
   cell, so that exact copies do not count, and itself into another row of it.
   This loses no pair. Lines that certainly have neither a copy nor a half that
   another line may share are done.
2. Equal lines are settled first: the smallest place of each group, by partial
   aggregation, joined back to the group's rows, one per batch. All but the
   earliest line of a group go; only the earliest takes part in what follows, as
   any other copy goes anyway and the earliest can witness for it.
3. The variants of a line are its words less one (key: the words left and the
   place of the gap) and, for a partner with a word more, its words with a gap
   (key: all words and the place), for the places in the half opposite a shared
   one. Two lines with an equal variant are an edit apart. A second sketch counts
   the variants' keys, and keys that are certainly unique are not emitted;
   within a batch only the earliest line of an equal key goes on.
4. Equal keys meet: the smallest place per key, joined back; every later line
   gets an earlier one as its witness. The pair is then verified on the words.
5. The marks of a document meet its text in one join.

Both joins are of a group's rows with one row per group, so adaptive execution
can split the rows of a hot line or variant. ``bits`` sets the cells of the
sketches as broadcast; by default they follow the size of the input up to 2^27.
The cells that are counted follow it beyond that.

Defined results: a null or empty text has one empty line and is kept; a null id
counts as the largest; rows that repeat an id, null included, are documents of
their own, in the order of a 63-bit hash of their texts, and the same document
only if their texts are equal too. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polyweave.llm import arrowkit as A
from polyweave.llm import sketch as S
from polyweave.llm import textkit as T
from polyweave.llm.tables import keyed, land, set_aside, ship

_MASK = (1 << 64) - 1
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in T.BASES)

#: A line's place in the corpus.
AT = ["doc", "tag", "line"]
_AT = [("doc", pa.int64()), ("tag", pa.int64()), ("line", pa.int32())]
_BY = [("wdoc", pa.int64()), ("wtag", pa.int64()), ("wline", pa.int32())]

_LINES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), *_AT, ("repeat", pa.bool_()), ("alone", pa.bool_()), ("sides", pa.int32()), ("words", pa.string())])
_LINES_SQL = "k1 long, k2 long, doc long, tag long, line int, repeat boolean, alone boolean, sides int, words string"
_KEYS = pa.schema([("v1", pa.int64()), ("v2", pa.int64()), *_AT, *_BY])
_KEYS_SQL = "v1 long, v2 long, doc long, tag long, line int, wdoc long, wtag long, wline int"

#: Halves of a line whose words may be left out (in front, at the end), and those that may have a gap; bits of ``sides``.
_CUT_LOW, _CUT_HIGH, _GAP_LOW, _GAP_HIGH = 1, 2, 4, 8

#: Rows of the first sketch: two for halves, one for entire lines.
_HALF, _WHOLE = (0, 1), (2,)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Lines:
    """The lines of some rows with prefix sums of their word hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.low = low = T.LOWER[raw]
        self.starts, self.ends, _ = T.word_spans(low, offsets)
        breaks = np.flatnonzero(raw == 0x0A)
        per_row = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
        self.row = np.repeat(np.arange(len(per_row)), per_row)
        self.number = np.arange(len(self.row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
        at = np.append(np.searchsorted(self.starts, begin), len(self.starts))
        self.first, self.last = at[:-1], at[1:]
        self.n = self.last - self.first
        hashes = T.word_hashes(low, self.starts, self.ends)
        self.place = np.arange(len(hashes)) - np.repeat(self.first, self.n)
        longest = int(self.n.max(initial=0)) + 1
        self.inverse = [_powers(i, longest) for i in _INVERSE]
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(b, longest)[self.place], dtype=np.uint64))) for b in T.BASES]

    def part(self, lines: np.ndarray, a: np.ndarray, b: np.ndarray, h: int) -> np.ndarray:
        """Key of the words a to b of each line, wherever in a line they stand."""
        s = self.sums[h]
        f = self.first[lines]
        return T.mix64((s[f + b] - s[f + a]) * self.inverse[h][a] + (b - a).astype(np.uint64) * np.uint64(T.BASES[1 - h]))

    def halves(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of two beginnings and of two ends of each line: half a word less and half a word more than half, rounded."""
        n = self.n[lines]
        zero = np.zeros(len(n), np.int64)
        heads = [self.part(lines, zero, (n + d) // 2, 0) for d in (-1, 1)]
        tails = [self.part(lines, n - (n + d + 1) // 2, n, 0) ^ np.uint64(_MASK) for d in (-1, 1)]
        return np.stack(heads), np.stack(tails)

    def without(self, lines: np.ndarray, cut: np.ndarray, h: int) -> np.ndarray:
        """Key of each line less one word, equal to the key of a line of the other words."""
        s, f, z = self.sums[h], self.first[lines], self.last[lines]
        rest = (s[f + cut] - s[f]) + (s[z] - s[f + cut + 1]) * self.inverse[h][1]
        return T.mix64(rest + (z - f - 1).astype(np.uint64) * np.uint64(T.BASES[1 - h]))

    def words(self, line: int) -> bytes:
        return self.low[self.starts[self.first[line]] : self.ends[self.last[line] - 1]].tobytes()


def _within_one(x: list[bytes], y: list[bytes]) -> bool:
    """Whether one inserted, deleted or replaced word at most turns x into y."""
    if abs(len(x) - len(y)) > 1:
        return False
    i, short = 0, min(len(x), len(y))
    while i < short and x[i] == y[i]:
        i += 1
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [_within_one(x.encode().split(), y.encode().split()) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
        yield b.select([0, 1, 2]).filter(pa.array(ok, pa.bool_()))


def _slices(b: pa.RecordBatch, text: int) -> Iterator[tuple[int, _Lines]]:
    """First row and lines of every slice."""
    raw, offsets = T.text_buffer(b.column(text))
    for lo, hi in T.slices(offsets):
        yield lo, _Lines(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _earliest(doc: np.ndarray, tag: np.ndarray, line: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by keys and place, where in it a key begins, and the number of each row's earliest row of equal keys, both in that order."""
    order = np.lexsort((line, tag, doc, *reversed(keys)))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new, order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order


def _profile(planes: S.Planes, b: pa.RecordBatch, min_words: int, near_words: int) -> Iterator[pa.RecordBatch]:
    """The lines of a batch that may have a copy or a near line, the latter with their words."""
    docs, tags = A.ints(b.column(0)), A.ints(b.column(1))
    found, words = [], []
    for lo, lines in _slices(b, 2):
        own = np.flatnonzero(lines.n >= min_words)
        if not len(own):
            continue
        n = lines.n[own]
        k1, k2 = (lines.part(own, np.zeros(len(own), np.int64), n, h) for h in (0, 1))
        copied = planes.repeated(k1, _WHOLE)
        heads, tails = (np.stack([planes.repeated(k, _HALF) for k in keys]) for keys in lines.halves(own))
        even = n % 2 == 0  # which of the two keys is the line's own half; the longer ones are those of a partner with a word more
        sides = np.where(even, tails[0], tails[1]) * _CUT_LOW + np.where(even, heads[1], heads[0]) * _CUT_HIGH + tails[1] * _GAP_LOW + heads[1] * _GAP_HIGH
        sides[n < near_words] = 0
        use = np.flatnonzero(copied | (sides > 0))
        row = lo + lines.row[own[use]]
        found.append((docs[row], tags[row], lines.number[own[use]].astype(np.int32), k1[use].view(np.int64), k2[use].view(np.int64), ~copied[use], sides[use].astype(np.int32)))
        words += [lines.words(own[i]) if sides[i] else None for i in use.tolist()]
    if not found:
        return
    doc, tag, line, k1, k2, alone, sides = (np.concatenate(x) for x in zip(*found))
    order, new, head = _earliest(doc, tag, line, k1, k2, alone)
    same = ~new & ((doc[order] != doc[head]) | (tag[order] != tag[head]) | (line[order] != line[head]))
    keep, repeat = order[new | same], same[new | same]  # a repeated row of the table is one document
    back = np.argsort(keep)  # lines of a document stay together, so that what they share shrinks in the shuffle
    keep, repeat = keep[back], repeat[back]
    given = [None if r else words[i] for i, r in zip(keep.tolist(), repeat.tolist())]
    yield A.batch(_LINES, k1[keep], k2[keep], doc[keep], tag[keep], line[keep], repeat, alone[keep], sides[keep], given)


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of each number from ``start`` up to ``stop``."""
    count = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _variant_keys(lines: _Lines, sides: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of each variant: words less one, then words with a gap."""
    n, has = lines.n, lambda side: (sides & side) != 0
    owner, cut = _spread(np.where(has(_CUT_LOW), 0, n // 2), np.where(has(_CUT_HIGH), n, n // 2))
    holder, gap = _spread(np.where(has(_GAP_LOW), 0, (n + 1) // 2), np.where(has(_GAP_HIGH), n + 1, (n + 1) // 2))
    whole = lines.part(np.arange(len(n)), np.zeros(len(n), np.int64), n, h)
    keys = np.concatenate((lines.without(owner, cut, h), whole[holder]))
    return np.concatenate((owner, holder)), T.mix64(keys ^ T.mix64(np.concatenate((cut, gap)).astype(np.uint64) + np.uint64(1)))


def _variants(b: pa.RecordBatch, planes: S.Planes) -> Iterator[pa.RecordBatch]:
    """Keys of the variants that another line may have; lines that met in the batch go as a pair with their witness."""
    found = []
    for lo, lines in _slices(b, 4):
        rows = slice(lo, lo + len(lines.n))
        owner, v1 = _variant_keys(lines, A.ints(b.column(3))[rows], 0)
        met = np.flatnonzero(planes.repeated(v1))
        found.append((owner[met] + lo, v1[met].view(np.int64), _variant_keys(lines, A.ints(b.column(3))[rows], 1)[1][met].view(np.int64)))
    if not found:
        return
    owner, v1, v2 = (np.concatenate(x) for x in zip(*found))
    doc, tag, line = (A.ints(b.column(i)) for i in range(3))
    order, new, head = _earliest(doc[owner], tag[owner], line[owner], v1, v2)
    goes = np.sort(order[new])
    none = [None] * len(goes)
    yield A.batch(_KEYS, v1[goes], v2[goes], doc[owner[goes]], tag[owner[goes]], line[owner[goes]], none, none, none)
    later, witness = owner[order[~new]], owner[head[~new]]
    other = (doc[later] != doc[witness]) | (tag[later] != tag[witness]) | (line[later] != line[witness])
    later, witness = np.unique(np.stack((later, witness))[:, other], axis=1)
    none = [None] * len(later)
    yield A.batch(_KEYS, none, none, doc[later], tag[later], line[later], doc[witness], tag[witness], line[witness])


def dedup_lines(documents: DataFrame, min_words: int = 1, near_words: int = 3, bits: int | None = None) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_removed) for each row of ``documents(doc_id, text)``."""
    rows = keyed(documents, F.col("doc_id").alias("_id"))
    return _dedup(rows, min_words, near_words, bits or _bits(documents)).select(F.col("_id").alias("doc_id"), "kept_text", "n_lines", "n_removed")


def rewrite(documents: DataFrame, min_words: int = 1, near_words: int = 3, bits: int | None = None) -> DataFrame:
    """``documents`` with the repeated lines gone from ``text``, ``n_chars`` to match, and documents that lost all words dropped."""
    rows, back = set_aside(documents)
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    done = _dedup(keyed(rows, F.col("doc_id").alias("_id"), *others), min_words, near_words, bits or _bits(documents))
    left = done.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    made = {"doc_id": F.col("_id"), "text": F.col("kept_text")}
    if "n_chars" in others:
        made["n_chars"] = F.length("kept_text").cast(documents.schema["n_chars"].dataType)
    return left.select(*(made.get(c, F.col(c)).alias(c) for c in rows.columns)).select(*back)


def _bits(documents: DataFrame) -> int:
    return S.bits_for(documents, 4, 27)


def _dedup(docs: DataFrame, min_words: int, near_words: int, bits: int) -> DataFrame:
    """As dedup_lines, over (doc, tag, text) and any columns to carry along."""
    fine = S.fine_for(docs, 4, bits)
    if not 1 <= min_words <= near_words:
        raise ValueError("lines within an edit have to be among those that are compared at all")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc", "tag", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves, wholes = S.TagCounter(bits, fine), S.Counter(bits, 3, first=2, fine=fine)
        for b in batches:
            for _, lines in _slices(b, 0):
                own = np.flatnonzero(lines.n >= min_words)
                yield from wholes.add(lines.part(own, np.zeros(len(own), np.int64), lines.n[own], 0))
                near = np.flatnonzero(lines.n >= near_words)
                tags = lines.part(near, np.zeros(len(near), np.int64), lines.n[near], 1) | np.uint64(1)
                for keys in np.concatenate(lines.halves(near)):
                    yield from halves.add(keys, tags)
        yield from halves.rows()
        yield from wholes.rows()

    first = spark.sparkContext.broadcast(S.merge(docs.select("text").mapInArrow(count, S.PARTIAL), bits, 3, fine=fine))
    table = land(texts.mapInArrow(lambda it: (x for b in it for x in _profile(first.value, b, min_words, near_words)), _LINES_SQL), "lines")
    first.destroy()

    # equal lines: a row per line and batch at most
    place = F.struct(*AT)
    copied = table.where("not repeat and not alone").select("k1", "k2", *AT, "sides", "words")
    earliest = copied.groupBy("k1", "k2").agg(F.min(place).alias("first"))
    settled = copied.join(earliest, ["k1", "k2"]).withColumn("later", place > F.col("first"))
    settled = land(settled.where("later or words is not null").select(*AT, "sides", F.when(~F.col("later"), F.col("words")).alias("words"), "later"), "settled")
    gone = settled.where("later").select(*AT).union(table.where("repeat").select(*AT))

    # lines within an edit: a row per variant, line and batch at most
    columns = [*AT, "sides", "words"]
    near = table.where("alone and not repeat and words is not null").select(*columns).union(settled.where("words is not null").select(*columns))

    def count_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = S.Counter(bits - 1, 2, fine=fine - 1)
        for b in batches:
            for lo, lines in _slices(b, 4):
                yield from counter.add(_variant_keys(lines, A.ints(b.column(3))[lo : lo + len(lines.n)], 0)[1])
        yield from counter.rows()

    second = spark.sparkContext.broadcast(S.merge(near.mapInArrow(count_variants, S.PARTIAL), bits - 1, 2, fine=fine - 1))
    keys = land(near.mapInArrow(lambda it: (x for b in it for x in _variants(b, second.value)), _KEYS_SQL), "variants")
    second.destroy()
    best = keys.where("wdoc is null").groupBy("v1", "v2").agg(F.min(place).alias("by"))
    met = keys.where("wdoc is null").join(best, ["v1", "v2"]).where(F.col("by") < place).select(*AT, "by")
    known = keys.where("wdoc is not null").select(*AT, F.struct(F.col("wdoc").alias("doc"), F.col("wtag").alias("tag"), F.col("wline").alias("line")).alias("by"))
    pairs = met.union(known).groupBy(*AT).agg(F.min("by").alias("by"))
    pairs = pairs.select(*AT, F.col("by.doc").alias("wdoc"), F.col("by.tag").alias("wtag"), F.col("by.line").alias("wline"))
    words = near.select(*AT, "words")
    other = words.select(F.col("doc").alias("wdoc"), F.col("tag").alias("wtag"), F.col("line").alias("wline"), F.col("words").alias("earlier"))
    pairs = pairs.join(words, AT).join(other, ["wdoc", "wtag", "wline"]).select(*AT, "words", "earlier")
    gone = gone.union(pairs.mapInArrow(_verify, "doc long, tag long, line int"))

    marks = gone.groupBy("doc", "tag").agg(F.collect_set("line").alias("gone"))
    columns = [c for c in docs.columns if c not in ("doc", "tag", "text")]
    fields = [f for f in docs.schema if f.name in columns]
    schema = StructType([*StructType.fromDDL("kept_text string, n_lines long, n_removed long"), *fields])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, removed = [], [], []
            for text, gone in zip(b.column(0), b.column(1)):
                own = (text.as_py() or "").split("\n")
                n.append(len(own))
                drop = set(gone.as_py()) if gone.is_valid else ()
                removed.append(len(drop))
                kept.append("\n".join(s for i, s in enumerate(own) if i not in drop) if drop else text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), *b.columns[2:]], names=[f.name for f in schema])

    out = docs.join(marks, ["doc", "tag"], "left").select("text", "gone", *columns)
    return out.mapInArrow(keep, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines and the SHA-256 of the text kept."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    return dedup_lines(documents).select("doc_id", "n_lines", "n_removed", kept)


#: The query's rows where ids are given and differ.
ORACLE = r"""
with lines as (
    select doc_id, generate_subscripts(l, 1) as line, unnest(l) as text from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), split as (
    select doc_id, line, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from lines
), places as (
    select *, len(w) as n, row_number() over (order by doc_id, line) as place from split
), variants as (
    select place, list_concat(w[1:c - 1], w[c + 1:]) as w, c from (select place, w, unnest(range(1, n + 1)) as c from places where n >= 3)
), firsts as (
    select w, min(place) as first from places where n >= 3 group by w
), cuts as (
    select w, c, min(place) as first from variants group by w, c
), shorter as (
    select w, min(first) as first from cuts group by w
), gone as (
    select place from (select place, min(place) over (partition by w) as first from places where n >= 1) where first < place
    union select v.place from variants v join cuts c on v.w = c.w and v.c = c.c where c.first < v.place
    union select v.place from variants v join firsts f on v.w = f.w where f.first < v.place
    union select p.place from places p join shorter s on p.w = s.w where p.n >= 3 and s.first < p.place
), kept as (
    select l.doc_id, l.line, l.text, g.place is not null as gone from lines l join places p on l.doc_id = p.doc_id and l.line = p.line left join gone g on p.place = g.place
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed,
    sha256(coalesce(string_agg(text, chr(10) order by line) filter (not gone), '')) as kept_sha256
from kept group by 1
"""
