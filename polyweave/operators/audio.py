"""Audio to unit sequences: decode, mix down, resample, cut into chunks, extract.

The unit extractor is an argument, as models are not part of this package.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mono samples in -1..1 and their rate in, units out.
Extractor = Callable[[np.ndarray, int], list[int]]


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """PCM wave bytes as (channels x samples) in -1..1, and the rate."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.reshape(-1).view("<i4").astype(np.float32) / float(1 << 31)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).T, rate


def prepare(x: np.ndarray, rate: int, target: int = 16000) -> np.ndarray:
    """Mean of the channels at the target rate, by linear interpolation."""
    mono = x.mean(axis=0)
    if rate == target or not len(mono):
        return mono
    n = int(round(len(mono) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(mono)), mono).astype(np.float32)


def chunks(x: np.ndarray, rate: int, seconds: float = 30) -> Iterator[np.ndarray]:
    """Pieces of that many seconds, the last one shorter; all at once for 0 or less."""
    step = int(rate * seconds)
    if step <= 0:
        yield x
        return
    for lo in range(0, len(x), step):
        yield x[lo : lo + step]


def level_units(x: np.ndarray, rate: int, levels: int = 100) -> list[int]:
    """Stand-in extractor: loudness of every 20 ms in steps, repeats joined."""
    frame = max(rate // 50, 1)
    loud = [float(np.sqrt((x[i : i + frame] ** 2).mean())) for i in range(0, len(x), frame)]
    steps = [min(int(v * levels), levels - 1) for v in loud]
    return [u for i, u in enumerate(steps) if not i or u != steps[i - 1]]


def add_units(rows: DataFrame, files: DataFrame, extract: Extractor = level_units, target: int = 16000, seconds: float = 30) -> DataFrame:
    """``rows(path, ...)`` with units and sample_rate; both null where the file is missing or can't be decoded.

    ``files`` is what the ``binaryFile`` source reads.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            units, rates = [], []
            for data in pdf["content"]:
                try:
                    x, rate = decode(data)
                    x = prepare(x, rate, target)
                    units.append([int(u) for c in chunks(x, target, seconds) for u in extract(c, target)])
                    rates.append(target)
                except Exception:
                    units.append(None)
                    rates.append(None)
            yield pd.DataFrame({"path": pdf["path"], "units": units, "sample_rate": pd.array(rates, dtype="Int32")})

    plain = F.regexp_replace("path", "^file:(//)?", "")
    wanted = files.select(plain.alias("path"), "content").join(rows.select("path").distinct(), "path", "left_semi")
    found = wanted.mapInPandas(run, "path string, units array<int>, sample_rate int")
    return rows.join(found, "path", "left")
