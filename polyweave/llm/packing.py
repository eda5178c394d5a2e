"""Packing token sequences so that every window holds the sources' target proportions.

A document's ids are those of the tokenizer, then ``end``. The ids of a source
form a queue in reading order; a window takes from every queue its quantum, the
target share of the window's length. Targets are ``weights`` by source (sources
that it doesn't name share one queue of weight ``rest``) or, by default, each
source's share of all ids; then the ``queues`` largest sources have a queue each
and the others share one. What a quantum leaves over as a fraction is the
queue's deficit; it is carried to the next window, and the places that the whole
parts leave free go to the queues whose next id is due first. When a queue runs
dry, the others share its quantum by their weights. So every window but the last
is full and has the proportions of the queues that are left, to within an id per
queue; by default all run dry together at the end.

Method: deficit round-robin. What all windows up to w have taken from a queue
hangs on the queues' totals and weights alone, so no window needs the one before
it: deficits carry over windows and partitions by this count (``Quotas``), and
each document finds its places from its position in its queue, at a cost that
follows its own ids, not the windows that it spans. Positions are sums: within
the partition that tokenizes, and over the partitions before it, per queue.

The ids are written once as a table (two bytes an id) and read once. They are
not shuffled as long as a row per source and partition can be broadcast; beyond,
the join with these rows shuffles them. Words are tokenized once per worker and
kept (``KEEP`` of them, or those of one slice of text if more, then anew): the
tokenizer splits at white space and at each change between letters, digits and
other signs, so a text's ids are those of its parts.

Defined results: a null or empty text has the id ``end`` alone; a null id or
source is kept as null (null is a source of its own); repeated rows are packed
each. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyweave.llm import arrowkit as A
from polyweave.llm import textkit as T
from polyweave.llm.tables import land, ship

#: Distinct word parts that one worker keeps with their ids.
KEEP = 1 << 19

#: Bytes of text that are tokenized at a time; each slice merges its new words into those kept.
SLICE = 4 << 20

#: Ids whose pieces are worked out at a time; a longer document by itself.
PIECE_IDS = 1 << 18

_TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_TOKENS_SQL = "doc_id long, source string, part int, before long, n long, ids binary"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
_PIECES_SQL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

# byte classes: 0 space, 1 letter, 2 digit, 3 other sign, 4 bytes that are settled by the tokenizer on the whole word
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[[0x27, 0x3C]] = 4  # contractions and special tokens
_CLASS[T.SPACE] = 0
_TAIL = np.zeros(256, bool)  # second bytes of the letters U+00C0-U+00FF
_TAIL[0x80:0xC0] = True
_TAIL[[0x97, 0xB7]] = False


def parts_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every part that is tokenized by itself, and the rows' offsets into them."""
    starts, ends, _ = T.word_spans(raw, offsets)
    kind = _CLASS[raw]
    two = np.flatnonzero((raw[:-1] == 0xC3) & _TAIL[raw[1:]])
    kind[two] = kind[two + 1] = 1
    odd = np.concatenate(([0], np.cumsum(kind == 4)))
    whole = odd[ends] != odd[starts]
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    inside = np.zeros(len(raw) + 1, np.int32)  # no cut within the words left whole
    np.add.at(inside, starts[whole] + 1, 1)
    np.add.at(inside, ends[whole], -1)
    cut &= np.cumsum(inside) == 0
    cut[starts] = True
    cut[:-1] &= kind != 0
    begin = np.flatnonzero(cut[:-1])
    nearest = np.append(begin[1:], len(raw))
    stop = np.minimum(nearest, ends[np.searchsorted(starts, begin, side="right") - 1]) if len(begin) else begin
    return begin, stop, np.searchsorted(begin, offsets)


class Words:
    """Ids of the word parts met so far, by hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, k, -1)

    def learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        n = np.array([len(x) for x in found], np.int64)
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate((self.ids, np.array([i for x in found for i in x], self.dtype)))
        order = np.argsort(allkeys := np.concatenate((self.keys, keys)))
        self.keys, self.at, self.n = allkeys[order], np.concatenate((self.at, at))[order], np.concatenate((self.n, n))[order]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the rows' offsets."""
        begin, stop, rows = parts_of(raw, offsets)
        hashes = T.word_hashes(T.LOWER[raw], begin, stop)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if (new := np.flatnonzero(self.find(keys) < 0)).size:
            if len(self.keys) + len(new) > KEEP:  # anew, with all parts of this slice, however many
                self.clear()
                new = np.arange(len(keys))
            data = raw.tobytes()
            self.learn(keys[new], [data[begin[i] : stop[i]] for i in first[new]])
        place = self.find(keys)[back]
        assert (place >= 0).all(), "a word part has no ids"
        n, at = self.n[place], self.at[place]
        ends = np.concatenate(([0], np.cumsum(n)))
        return self.ids[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])], ends[rows]


_words: dict[str, Words] = {}


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    if path not in _words:
        _words[path] = Words(path)
    words = _words[path]
    part, before = TaskContext.get().partitionId(), {}
    for b in batches:
        raw, offsets = T.text_buffer(b.column(2))
        for lo, hi in T.slices(offsets, SLICE):
            flat, at = words.encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            flat = np.insert(flat, at[1:], end)
            at = at + np.arange(len(at))
            n = np.diff(at)
            sources = b.column(1).slice(lo, hi - lo)
            start = []
            for s, k in zip(sources.to_pylist(), n.tolist()):
                start.append(before.get(s, 0))
                before[s] = start[-1] + k
            yield A.batch(_TOKENS, b.column(0).slice(lo, hi - lo), sources, np.full(len(n), part, np.int32), start, n, A.ragged(flat, at, pa.binary()))


class Quotas:
    """What the windows take from queues of given totals by given whole weights."""

    def __init__(self, totals: list[int], weights: list[int], length: int):
        self.totals, self.weights, self.length = np.array(totals, np.int64), weights, length
        dries = sorted((i for i, n in enumerate(totals) if n), key=lambda i: (totals[i] / weights[i], i))
        self.stages: list[tuple[int, int, list[int]]] = []  # until its end: ids of queues gone dry before it, weight and queues of those left
        self.ends: list[int] = []
        times, upto = [0.0], [0.0]
        gone, left = 0, dries
        for i in dries:
            weight = sum(weights[j] for j in left)
            self.stages.append((gone, weight, left))
            self.ends.append(gone + weight * totals[i] // weights[i])
            times.append(totals[i] / weights[i])
            upto.append(gone + weight * (totals[i] / weights[i]))
            gone, left = gone + totals[i], left[1:]
        self.everything, self._times, self._upto = gone, times, upto

    def upto(self, windows: np.ndarray) -> np.ndarray:
        """What the first w windows hold of every queue, for each w of ``windows``: whole quanta, then the ids due first."""
        at = np.minimum(windows * self.length, self.everything)
        served = np.zeros((len(windows), len(self.totals)), np.int64)
        stage = np.minimum(np.searchsorted(np.array(self.ends, np.int64), at), len(self.stages) - 1)
        for k in np.unique(stage).tolist() if self.stages else []:
            rows = np.flatnonzero(stage == k)
            gone, weight, left = self.stages[k]
            exact = np.int64 if self.everything * max(self.weights) < 1 << 62 else object
            over = (at[rows] - gone).astype(exact)
            served[rows] = self.totals
            served[np.ix_(rows, left)] = np.stack([(over * exact(self.weights[j]) if exact is np.int64 else over * self.weights[j]) // weight for j in left], axis=1)
        served = np.minimum(served, self.totals)
        free = at - served.sum(axis=1)
        each = np.array(self.weights, np.float64)
        while (rows := np.flatnonzero(free > 0)).size:
            due = np.where(served[rows] < self.totals, (served[rows] + 1) / each, np.inf)
            served[rows, np.argmin(due, axis=1)] += 1
            free[rows] -= 1
        return served

    def near(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The window of each place of a queue, to within one."""
        at = np.interp((place + 1) / np.array(self.weights, np.float64)[queue], self._times, self._upto)
        return (at / self.length).astype(np.int64)

    def around(self, queue: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Windows that may hold the places of some runs, and the one after each: all that a run spans, or those near its places if these are fewer."""
        first, last = self.near(queue, start), self.near(queue, stop)
        wide = last - first > 5 * (stop - start)
        _, spanned = _spread(np.maximum(first - 2, 0)[~wide], last[~wide] + 4)
        owner, place = _spread(start[wide], stop[wide])
        near = self.near(queue[wide][owner], place)[:, None] + np.arange(-2, 4)
        return np.unique(np.concatenate((spanned, np.maximum(near, 0).ravel())))


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of each number from ``start`` up to ``stop``."""
    count = stop - start
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _places(quotas: Quotas, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces of some documents: document, place in its queue, length, window, offset."""
    windows = quotas.around(queue, start, start + n)
    upto = quotas.upto(windows)
    before = np.cumsum(np.diff(upto, axis=0), axis=1)  # of windows that stand next to each other
    found = []
    for q in np.unique(queue).tolist():
        docs = np.flatnonzero(queue == q)
        of, at, stop = upto[:, q], start[docs], (start + n)[docs]
        owner, w = _spread(np.searchsorted(of, at, side="right") - 1, np.searchsorted(of, stop - 1, side="right"))
        lo, hi = np.maximum(of[w], at[owner]), np.minimum(of[w + 1], stop[owner])
        use = hi > lo
        owner, w, lo, hi = owner[use], w[use], lo[use], hi[use]
        found.append((docs[owner], lo, hi - lo, windows[w], (before[w, q - 1] if q else 0) + lo - of[w]))
    doc, lo, length, window, offset = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((lo, doc))
    return doc[order], lo[order], length[order], window[order], offset[order]


def _pieces(batches: Iterator[pa.RecordBatch], quotas: Quotas, dtype: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        queue, start, n = (A.ints(b.column(i)).astype(np.int64) for i in (1, 2, 3))
        for lo, hi in T.slices(np.concatenate(([0], np.cumsum(n))), PIECE_IDS):
            doc, at, length, window, offset = _places(quotas, queue[lo:hi], start[lo:hi], n[lo:hi])
            ids = b.column(4).slice(lo, hi - lo)
            edges = np.frombuffer(ids.buffers()[1], np.int32, count=hi - lo + 1, offset=ids.offset * 4).astype(np.int64)
            flat = np.frombuffer(ids.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(dtype)
            begin = at - start[lo:hi][doc]
            _, take = _spread(first := (edges[:-1] - edges[0])[doc] // flat.itemsize + begin, first + length)
            cut = A.ragged(flat[take].astype("<u4"), np.concatenate(([0], np.cumsum(length))), pa.binary())
            yield A.batch(_PIECES, b.column(0).slice(lo, hi - lo).take(pa.array(doc)), begin, length, n[lo:hi][doc], window, offset, cut)


def pack(documents: DataFrame, tokenizer: str, length: int = 4096, end: int = 2, weights: dict[str | None, float] | None = None, rest: float = 1.0, queues: int = 64) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) per piece of ``documents(doc_id, source, text)``.

    ``tokenizer`` is the path of a tokenizer file that every executor has; ``ids`` holds little-endian unsigned 32-bit ids.
    """
    if weights is not None and min([rest, *weights.values()]) <= 0:
        raise ValueError("weights have to be positive")
    spark = documents.sparkSession
    ship(spark)
    given = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    tokens = land(given.mapInArrow(lambda it: _tokens(it, tokenizer, end), _TOKENS_SQL), "tokens")

    sums = land(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "sums")
    if weights is None:
        sizes = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(queues)
        own = sorted((r.source for r in sizes.collect()), key=lambda s: (s is None, s))  # ``queues`` rows
    else:
        own = sorted(weights, key=lambda s: (s is None, s))
    queue = reduce(lambda rest, k: F.when(F.col("source").eqNullSafe(F.lit(own[k])), k).otherwise(rest), range(len(own)), F.lit(len(own)))
    sums = sums.withColumn("queue", queue)
    totals = [0] * (len(own) + 1)
    for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # a row per queue
        totals[r.queue] = r.n
    whole = totals if weights is None else [max(1, round(w * (1 << 20))) for w in [*(weights[s] for s in own), rest]]
    quotas = Quotas(totals, [max(w, 1) for w in whole], length)

    # place of a part in its queue: the parts before it, and in the same part the sources before it
    parts = sums.groupBy("queue", "part").agg(F.sum("n").alias("all"))
    parts = parts.select("queue", "part", (F.sum("all").over(Window.partitionBy("queue").orderBy("part")) - F.col("all")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("queue", "part").orderBy(F.col("source").asc_nulls_last())) - F.col("n")
    places = sums.withColumn("inside", inside).join(parts, ["queue", "part"])
    places = land(places.select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", (F.col("base") + F.col("inside")).alias("base")), "queues")
    placed = tokens.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("start"), "n", "ids")
    dtype = _dtype(tokenizer)
    return placed.mapInArrow(lambda it: _pieces(it, quotas, dtype), _PIECES_SQL)


def _dtype(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def pack_query(documents: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids."""
    import public_tokenizers

    pieces = pack(documents, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    return pack_query(spark.read.parquet(f"{sf_dir}/documents.parquet"))
