"""Language identification with a blended-spectrum string kernel.

Two texts are as similar as the share of byte n-grams (n = 1 to 4, A-Z
lower-cased, everything but letters one space) that both contain; presence
counts, not frequency. The n-grams are hashed to ``buckets`` features, so that
those which collide count as one; 16384 hold the some thousand of a document apart
well enough (the README has the held-out accuracy).

Method: kernel ridge regression, one language against the rest, on a Nyström
approximation: a bounded sample of labelled documents (``per_language`` each,
``sampled`` at most, by hash of the id, of the ``languages`` most frequent
languages) is mapped to its kernels with some landmark documents (``landmarks``,
two for each language at least, dealt out over them), whitened by the landmarks' own
kernel, and fitted by ridge regression. A text is scored by two matrix
products, presence by landmarks and landmarks by languages, for a block of
texts at a time. Whole texts are scored.

The sample's features (two kB a document, whatever its length) are gathered on
the driver; the model, 64 kB a landmark, is broadcast.

Defined results: null texts and texts without a letter are ``und`` with score
0; a null id hashes as the empty text; without a labelled row all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyweave.llm import arrowkit as A
from polyweave.llm import textkit as T
from polyweave.llm.tables import land, ship

ORDERS = (1, 2, 3, 4)

#: Texts whose kernels are computed by one matrix product.
BLOCK = 128

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def fold(modulus: int) -> Column:
    """Remainder of the CRC-32 of the id as text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def sample(rows: DataFrame, group: str, most: int, seed: int, groups: int, total: int) -> DataFrame:
    """(doc_id, group) of ``most`` rows of each of the ``groups`` largest groups at most, ``total`` in all, by hash of the id.

    Rows whose hash is far beyond the ``most`` smallest of their group, as its size tells, are not ranked.
    """
    sizes = rows.groupBy(group).count().orderBy(F.desc("count"), group).limit(groups).collect()
    most = min(most, max(total // max(len(sizes), 1), 1))
    if not sizes:
        return land(rows.select("doc_id", group), "sample")
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r[0], min(4.0 * most / r[1], 2.0))))
    near = rows.select("doc_id", group, F.xxhash64(F.lit(seed), "doc_id").alias("_turn"))
    near = near.where(F.shiftright("_turn", 1) + (1 << 62) < share[F.col(group)] * float(1 << 63))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_turn", "doc_id"))
    return land(near.withColumn("_rank", rank).where(F.col("_rank") <= most).select("doc_id", group), "sample")


def presence(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of 0 and 1: which n-grams each text contains."""
    n = len(offsets) - 1
    out = np.zeros((n, buckets), np.float32)
    flat, low = out.reshape(-1), _LETTER[raw].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * buckets, np.diff(offsets))
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    code = np.zeros(len(low), np.uint32)
    for k in ORDERS:
        code = low if k == 1 else (code[:-1] << np.uint32(8)) | low[k - 1 :]
        inside = row[: len(code)] == row[k - 1 :]
        hashed = ((code ^ np.uint32(k * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(15))
        hashed = (hashed * np.uint32(0x85EBCA6B)) >> shift
        flat[(row[: len(code)] + hashed)[inside]] = 1
    return out


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text contains a letter."""
    upto = np.concatenate(([0], np.cumsum((_LETTER != 0x20)[raw] & (raw < 0x80))))
    out = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def _kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(y.sum(axis=1), 1))[None, :]
    return (x @ y.T) / norm


class Model:
    """Landmarks and the weights from their kernels to the languages."""

    def __init__(self, x: np.ndarray, languages: list[str], landmarks: int, ridge: float):
        self.names = sorted(set(languages))
        y = np.array([self.names.index(s) for s in languages])
        turn = np.argsort(np.array([int((y[:i] == c).sum()) for i, c in enumerate(y)]), kind="stable")
        self.marks = x[turn[:landmarks]]
        value, vector = np.linalg.eigh(_kernel(self.marks, self.marks).astype(np.float64))
        use = value > 1e-6 * value.max()
        white = vector[:, use] / np.sqrt(value[use])
        z = _kernel(x, self.marks).astype(np.float64) @ white
        weight = 1.0 / np.bincount(y)[y]  # every language counts the same
        aim = np.where(y[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        self.shift = (weight @ z) / weight.sum(), (weight @ aim) / weight.sum()
        z, aim = z - self.shift[0], aim - self.shift[1]
        fit = np.linalg.solve((z.T * weight) @ z + ridge * np.eye(z.shape[1]), (z.T * weight) @ aim)
        self.weights = white @ fit
        self.bias = self.shift[1] - self.shift[0] @ fit
        self.norm = np.sqrt(np.maximum(self.marks.sum(axis=1), 1))

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its share of the softmax, by two matrix products."""
        near = (x @ self.marks.T) / (np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * self.norm)
        value = 4 * (near @ self.weights + self.bias)
        value = np.exp(value - value.max(axis=1, keepdims=True))
        best = value.argmax(axis=1)
        return best, value[np.arange(len(best)), best] / value.sum(axis=1)


def _blocks(b: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = T.text_buffer(b.column(text))
    for lo, hi in T.slices(offsets, 1 << 20):
        for a in range(lo, hi, BLOCK):
            z = min(a + BLOCK, hi)
            yield a, z, raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]


def fit(
    documents: DataFrame, per_language: int = 400, landmarks: int = 128, buckets: int = 1 << 14, ridge: float = 1e-3, held_out: int = 5, languages: int = 512, sampled: int = 20_000
) -> Model | None:
    """Model from the documents with a language outside the held-out fold, ``per_language`` of each at most."""
    ship(documents.sparkSession)
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(held_out) != 0))
    ids = sample(known, "lang", per_language, 4, languages, sampled).distinct()
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])  # ``sampled`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("bits", pa.binary())])
        for b in batches:
            for a, z, raw, offsets in _blocks(b, 2):
                bits = np.packbits(presence(raw, offsets, buckets) > 0, axis=1)
                yield A.batch(schema, b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), [x.tobytes() for x in bits])

    rows = texts.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, "doc_id long, lang string, bits binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.bits)))
    if not rows:
        return None
    x = np.unpackbits(np.stack([np.frombuffer(bytes(r.bits), np.uint8) for r in rows]), axis=1)[:, :buckets].astype(np.float32)
    return Model(x, [r.lang for r in rows], max(landmarks, 2 * len({r.lang for r in rows})), ridge)


def predict(documents: DataFrame, model: Model | None, buckets: int = 1 << 14) -> DataFrame:
    """(doc_id, lang_pred, score, held_out) for every row of ``documents(doc_id, text)``."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            names, scores = [], []
            for _, _, raw, offsets in _blocks(b, 2):
                letters = has_letter(raw, offsets) & (model is not None)
                if model is None:
                    best, score = np.zeros(len(letters), int), np.zeros(len(letters))
                else:
                    best, score = model.score(presence(raw, offsets, buckets))
                names += [model.names[k] if ok else "und" for k, ok in zip(best, letters)]
                scores.append(np.where(letters, score, 0.0))
            yield A.batch(schema, b.column(0), b.column(1), names, np.concatenate(scores) if scores else [])

    given = documents.select(F.col("doc_id").cast("long"), (fold(5) == 0).alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled documents of four folds in five."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(documents, fit(documents))
