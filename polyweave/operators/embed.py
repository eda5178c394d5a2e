"""Embedders: a small interface, and one that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

#: Texts and their language tag in, one row of a matrix per text out; called with a batch of one tag at a time.
Encoder = Callable[[list[str], str | None], np.ndarray]


def hashing(dim: int = 64, orders: tuple[int, ...] = (2, 3, 4)) -> Encoder:
    """Signed hashed character n-grams of the lower-cased text; the tag is not looked at."""

    def encode(texts: list[str], tag: str | None = None) -> np.ndarray:
        padded = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64) for t in texts]
        flat, row = np.concatenate(padded), np.repeat(np.arange(len(texts)), [len(p) for p in padded])
        out = np.zeros(len(texts) * dim)
        code = np.zeros(len(flat), np.uint64)
        for k in range(1, max(orders) + 1):
            code = code[: len(flat) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[k - 1 :] + np.uint64(1)
            if k not in orders:
                continue
            inside = row[: len(code)] == row[k - 1 :]
            h = code[inside] ^ (code[inside] >> np.uint64(29))
            h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)
            at = row[: len(code)][inside] * dim + ((h >> np.uint64(1)) % np.uint64(dim)).astype(np.int64)
            out += np.bincount(at, weights=np.where(h & np.uint64(1), 1.0, -1.0), minlength=len(out))
        return out.reshape(len(texts), dim)

    return encode


def pooled(tokens: Callable[[list[str], str | None], tuple[np.ndarray, np.ndarray]]) -> Encoder:
    """Encoder from a model that gives token vectors (text, token, dimension) and a mask (text, token): the mean over unmasked tokens."""

    def encode(texts: list[str], tag: str | None = None) -> np.ndarray:
        vectors, mask = tokens(texts, tag)
        weight = mask[:, :, None].astype(float)
        return (vectors * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)

    return encode


def clipped(encoder: Encoder, most: int) -> Encoder:
    """An encoder that sees the first ``most`` characters of each text, for models with a longest input."""
    return lambda texts, tag=None: encoder([t[:most] for t in texts], tag)


def embedder(*encoders: Callable[[], Encoder], batch: int = 64) -> Callable[..., Column]:
    """Column function of a text and, if wanted, its language tag: the encoders' outputs end to end, of unit length; null for null.

    Each argument makes an encoder; it is called once per worker, so that models are loaded there. The outputs are
    joined as they come, and only the whole is brought to unit length.
    """

    @pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        models = [make() for make in encoders]
        for texts, tags in parts:
            found: list = [None] * len(texts)
            given: dict = {}
            for i, (text, tag) in enumerate(zip(texts, tags)):
                if text is not None:
                    given.setdefault(tag, []).append((i, text))
            for tag, rows in given.items():
                for lo in range(0, len(rows), batch):
                    some = rows[lo : lo + batch]
                    block = np.concatenate([m([t for _, t in some], tag) for m in models], axis=1)
                    block = block / (np.linalg.norm(block, axis=1, keepdims=True) + 1e-9)
                    for (i, _), v in zip(some, block):
                        found[i] = v.astype(np.float32)
            yield pd.Series(found, dtype=object)

    return lambda text, tag=None: run(text, F.lit(None).cast("string") if tag is None else tag)


def embed_once(rows: DataFrame, text: str, embed: Callable[..., Column], name: str = "v", tag: str | None = None) -> DataFrame:
    """``rows`` with a vector per text (and tag); every distinct one is encoded once."""
    keys = [text] if tag is None else [text, tag]
    vector = embed(F.col(text)) if tag is None else embed(F.col(text), F.col(tag))
    known = rows.select(*keys).where(F.col(text).isNotNull()).distinct().withColumn(name, vector)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_{k}").eqNullSafe(F.col(k))
    known = known.withColumnsRenamed({k: f"_{k}" for k in keys})
    return rows.join(known, same, "left").drop(*(f"_{k}" for k in keys))
