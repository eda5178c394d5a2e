"""Removal of passages that occur earlier in the corpus, at word level.

A window is ``window`` consecutive words of one document. A word is removed if
a window that covers it also starts earlier in the corpus, in a document with a
smaller id or earlier in the same document. Windows are judged on the input,
not on what is left.

Method: a count-min prefilter, then exact grouping.

1. Every window has an anchor: the leftmost smallest hash among the
   ``anchor``-word runs inside it. Equal windows have equal anchors at
   different places, so a window's count is at most its anchor's count, and
   about one place in six is an anchor. Each task counts its anchors into a
   partition sketch; the merged sketch overestimates the count of every window.
2. The second pass hashes the windows whose anchor is estimated to be repeated
   to 128 bits. Within an Arrow batch only the earliest of equal windows goes
   on; the others are known to be repeats. The shuffle by window hash so gets a
   row per window and batch at most, however many documents share the window,
   and a scan over the sorted rows marks all but the earliest.
3. The marks of a document meet its text in one join.

The sketch has ``2 * 2**bits`` cells; by default ``bits`` follows the size of
the input up to 27, which suits some ten GB of text. With more text for its
size it passes on more windows, up to all; results do not change. Shuffled are the windows passed on (about 31 bytes each), the marks and
the text once.

Defined results: a null or empty text has no words and keeps the empty string;
a document of fewer than ``window`` words keeps all; a null id counts as the
largest; rows that repeat an id, null included, are documents of their own, in
the order of a 63-bit hash of their texts, and the same document only if their
texts are equal too. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyweave.llm import arrowkit as A
from polyweave.llm import sketch as S
from polyweave.llm import textkit as T
from polyweave.llm.tables import keyed, ship

_ROWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
_MARKS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("span", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.large_string())])


def _anchors(hashes: np.ndarray, row: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, the place of each window's anchor, and the run hashes by place."""
    runs = T.ngrams(hashes, anchor, T.BASES[0])
    places = np.arange(len(runs), dtype=np.int64)
    width, need = 1, window - anchor + 1
    low, at = runs, places
    while width < need:  # leftmost minimum over `need` consecutive runs, by doubling
        step = min(width, need - width)
        left, right = low[:-step], low[step:]
        take = right < left
        low, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        width += step
    n = max(len(hashes) - window + 1, 0)
    starts = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n])
    return starts, at[:n][starts], runs


def _slices(texts: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word hashes, row of each word and word offsets of the rows, slice by slice; rows count from the batch's first."""
    raw, offsets = T.text_buffer(texts)
    for lo, hi in T.slices(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, at = T.word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        if len(starts) >= window:
            row = T.row_of(at)
            yield T.word_hashes(part, starts, ends), row + lo, np.arange(len(row)) - at[row]


def _merged(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word spans of equal length joined where they touch, by document."""
    order = np.lexsort((starts, tags, docs))
    docs, tags, starts, stops = docs[order], tags[order], starts[order], stops[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]) | (starts[1:] > stops[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1 if len(first) else first
    return docs[first], tags[first], starts[first], stops[last]


def _repeats(h1: np.ndarray, h2: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows sorted by hash and place: the first of each hash, and which of them stand later than that."""
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)
    head = first[np.cumsum(new) - 1] if len(first) else first
    return first, np.logical_or.reduce([p != p[head] for p in place])


def dedup_substrings(documents: DataFrame, window: int = 20, anchor: int = 10, bits: int | None = None) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed) for each row of ``documents(doc_id, text)``."""
    spark = documents.sparkSession
    ship(spark)
    docs = keyed(documents, F.col("doc_id").cast("long"))
    bits = bits or S.bits_for(documents, 2, 27)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = S.Counter(bits, 2)
        for b in batches:
            for hashes, row, _ in _slices(b.column(0), window):
                _, at, runs = _anchors(hashes, row, window, anchor)
                yield from counter.add(runs[np.unique(at)])
        yield from counter.rows()

    planes = S.merge(docs.select("text").mapInArrow(count, S.PARTIAL), bits, 2)
    shared = spark.sparkContext.broadcast(planes)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = shared.value.repeated
        for b in batches:
            docs, tags = A.ints(b.column(0)), A.ints(b.column(1))
            found = []
            for hashes, row, number in _slices(b.column(2), window):
                starts, at, runs = _anchors(hashes, row, window, anchor)
                places, back = np.unique(at, return_inverse=True)
                starts = starts[repeated(runs[places])[back]]
                h1, h2 = (T.ngrams(hashes, window, base)[starts].view(np.int64) for base in T.BASES)
                found.append((h1, h2, docs[row[starts]], tags[row[starts]], number[starts].astype(np.int32)))
            if not found:
                continue
            rows = [np.concatenate(x) for x in zip(*found)]
            order = np.lexsort((rows[4], rows[3], rows[2], rows[1], rows[0]))
            first, later = _repeats(*(c[order] for c in rows))
            goes = np.sort(order[first])  # windows of a document stay together, so that what they share shrinks in the shuffle
            yield A.batch(_ROWS, *(c[goes] for c in rows), np.full(len(goes), -1, np.int32))
            doc, tag, start = (c[order[later]] for c in rows[2:])
            d, g, a, z = _merged(doc, tag, start, start + window)
            spread = T.mix64(d.view(np.uint64) ^ a.astype(np.uint64)).view(np.int64)
            yield A.batch(_ROWS, spread, np.zeros(len(d), np.int64), d, g, a, z)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = [A.ints(c) for c in b.columns]
            known = rows[5] >= 0
            if known.any():
                yield A.batch(_MARKS, rows[2][known], rows[3][known], rows[4][known].astype(np.int64) << 32 | rows[5][known])
                rows = [c[~known] for c in rows]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(([x], y)) for x, y in zip(held, rows)]
            h1, h2, doc, tag, start, _ = rows
            first, later = _repeats(h1, h2, doc, tag, start)
            held = [c[first[-1]] for c in rows]
            d, g, a, z = _merged(doc[later], tag[later], start[later], start[later] + window)
            yield A.batch(_MARKS, d, g, a.astype(np.int64) << 32 | z)

    rows = docs.select("doc", "tag", "text").mapInArrow(windows, "h1 long, h2 long, doc long, tag long, start int, stop int")
    marks = rows.repartition("h1").sortWithinPartitions("h1", "h2", "doc", "tag", "start").mapInArrow(mark, "doc long, tag long, span long")
    spans = marks.groupBy("doc", "tag").agg(F.collect_list("span").alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, cut in zip(b.column(1).cast(pa.large_binary()), b.column(2)):
                words = text.as_py().split() if text.is_valid else []
                n.append(len(words))
                if cut.is_valid and len(words):
                    span = cut.values.to_numpy(zero_copy_only=False)
                    depth = np.zeros(len(words) + 1, np.int32)
                    np.add.at(depth, np.minimum(span >> 32, len(words)), 1)
                    np.add.at(depth, np.minimum(span & 0xFFFFFFFF, len(words)), -1)
                    left = np.cumsum(depth[:-1]) == 0
                    words = list(itertools.compress(words, left.tolist()))
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield A.batch(_OUT, b.column(0), n, gone, pa.array(kept, pa.large_binary()).cast(pa.large_string()))

    whole = docs.join(spans, ["doc", "tag"], "left").select("doc_id", "text", "spans")
    out = whole.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.select("doc_id", "kept_text", "n_words", "n_removed")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: words, removed words and the SHA-256 of the words kept."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The query's rows where ids are given and differ.
ORACLE = r"""
with words as (
    select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents)
), windows as (
    select doc_id, i, string_agg(word, ' ') over run as span, count(*) over run as n from words
    window run as (partition by doc_id order by i rows between current row and 19 following)
), judged as (
    select doc_id, i, n = 20 and row_number() over (partition by span, n order by doc_id, i) > 1 as repeats from windows
), marked as (
    select w.doc_id, w.i, w.word, bool_or(j.repeats) over (partition by w.doc_id order by w.i rows between 19 preceding and current row) as gone
    from words w join judged j on w.doc_id = j.doc_id and w.i = j.i
), sums as (
    select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from marked group by 1
)
select d.doc_id, coalesce(s.n_words, 0)::bigint as n_words, coalesce(s.n_removed, 0)::bigint as n_removed, sha256(coalesce(s.kept, '')) as kept_sha256
from documents d left join sums s on d.doc_id = s.doc_id
"""
