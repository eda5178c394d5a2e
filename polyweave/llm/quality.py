"""Quality classifier on supervised subword embeddings.

A document is the average of the learned vectors of its features: each word,
each pair of words that follow each other, and each byte trigram and four-gram
within a word (its borders included), hashed to a bucket each. A pair's hash is
that of the difference of its words' hashes, so that what words a text repeats
does not matter, but that it does is seen. A softmax over the two labels
follows. Whole texts count.

Method: the vectors and the output layer are trained by plain stochastic
gradient descent in numpy, one document at a time, on a bounded sample of
labelled documents (``per_label`` each, by hash of the id). The sample's feature
counts (eight bytes a distinct feature, ``3 * BUCKETS`` a document at most)
are gathered on the driver. As the output layer is linear in the average, every
feature's contribution to the two outputs is one number; a document's score is
the average of these, which needs no vector per word.

Defined results: null and empty texts score by the bias alone; a document
without a label trains nothing; labels that contradict each other count as the
smaller one; without a labelled row, or with one label only, every score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyweave.llm import arrowkit as A
from polyweave.llm import textkit as T
from polyweave.llm.language_id import fold, sample
from polyweave.llm.tables import set_aside, ship

#: Hash buckets of words, as many of byte n-grams and as many of pairs of words.
BUCKETS = 1 << 15
FEATURES = 3 * BUCKETS

#: Score from which a document is predicted good.
THRESHOLD = 0.7


def features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and the row of each, kind by kind."""
    starts, ends, at = T.word_spans(raw, offsets)
    row, hashes = T.row_of(at), T.word_hashes(raw, starts, ends)
    yield (hashes >> np.uint64(49)).astype(np.int32), row
    pair = row[1:] == row[:-1]
    yield (T.mix64(hashes[1:] - hashes[:-1])[pair] >> np.uint64(49)).astype(np.int32) + 2 * BUCKETS, row[1:][pair]
    space = T.SPACE[raw]
    low = np.where(space, np.uint8(0x20), raw).astype(np.uint32)
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for k in (3, 4):
        if len(raw) < k:
            continue
        m = len(raw) - k + 1
        code, inside = low[:m], of[:m] == of[k - 1 :]
        for i in range(1, k):
            code = (code << np.uint32(8)) | low[i : i + m]
            if i < k - 1:
                inside &= ~space[i : i + m]
        code, where = code[inside], of[:m][inside]
        hashed = ((code ^ (code >> np.uint32(13))) * np.uint32(0x9E3779B1 + 2 * k)) ^ (code >> np.uint32(7))
        yield ((hashed * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int32) + BUCKETS, where


class Model:
    """What every feature adds to the log-odds of label 1, before averaging."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 16, epochs: int = 8, rate: float = 0.5):
        self.single = len(set(labels.tolist())) < 2
        rng = np.random.default_rng(9)
        vectors = rng.uniform(-1 / dim, 1 / dim, (FEATURES, dim)).astype(np.float32)
        out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
        steps, step = epochs * max(len(docs), 1), 0
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                ids, share = docs[i]
                now = rate * (1 - step / steps)
                step += 1
                hidden = share @ vectors[ids]
                value = out @ hidden + bias
                p = np.exp(value - value.max())
                error = p / p.sum()
                error[labels[i]] -= 1
                back = error @ out
                out -= now * np.outer(error, hidden)
                bias -= now * error * 0.1
                vectors[ids] -= (now * len(ids) ** 0.5) * share[:, None] * back
        self.table = (vectors @ (out[1] - out[0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every text."""
        n = len(offsets) - 1
        if self.single:
            return np.ones(n)
        total, count = np.zeros(n), np.zeros(n)
        for number, row in features(raw, offsets):
            total += np.bincount(row, weights=self.table[number], minlength=n)
            count += np.bincount(row, minlength=n)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def fit(documents: DataFrame, labels: DataFrame, per_label: int = 600, held_out: int = 2, folds: int = 4) -> Model:
    """Model from labelled documents outside the held-out fold, ``per_label`` of each label at most."""
    ship(documents.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(folds) != held_out))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = sample(known, "quality", per_label, 9, 2, 2 * per_label)
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # 2 * per_label rows
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = T.text_buffer(b.column(2))
            ids, counts = [], []
            for i in range(b.num_rows):
                part = raw[offsets[i] : offsets[i + 1]]
                number = np.concatenate([x for x, _ in features(part, np.array([0, len(part)]))])
                number, count = np.unique(number, return_counts=True)
                ids.append(number.astype("<u4").tobytes())
                counts.append(count.astype("<u4").tobytes())
            yield A.batch(schema, b.column(0), b.column(1), ids, counts)

    given = texts.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text")
    rows = given.mapInArrow(run, "doc_id long, quality int, ids binary, counts binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.ids), bytes(r.counts)))
    docs, y = [], []
    for r in rows:
        counts = np.frombuffer(bytes(r.counts), "<u4").astype(np.float32)
        if len(counts):
            docs.append((np.frombuffer(bytes(r.ids), "<u4").astype(np.int64), counts / counts.sum()))
            y.append(r.quality)
    return Model(docs, np.array(y, np.int64))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with score and predicted added; columns of these names are replaced."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    given = documents.drop("score", "predicted")
    at = given.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = T.text_buffer(b.column(at))
            parts = [shared.value.score(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in T.slices(offsets)]
            value = np.concatenate(parts) if parts else np.zeros(0)
            columns = [*b.columns, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "score", "predicted"])

    return given.mapInArrow(run, given.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema)


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` predicted good, with the columns given."""
    rows, back = set_aside(documents)
    return score(rows, model).where("predicted = 1").select(*back)


def query(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of three folds in four."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")
