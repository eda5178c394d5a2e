"""Sentences, spans and script checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from polyweave.functions import fixed as X
from polyweave.functions import text as T


#: Starts of spans that one row holds before they are told apart.
CHUNK = 256


def pieces(text: Column) -> Column:
    """Text cut after each run of boundary characters, trimmed, without blank pieces."""
    no = f"[^{X.BOUNDARY[1:-1]}]"
    found = F.regexp_extract_all(text, F.lit(f"{no}*+{X.BOUNDARY}++\\s*+|{no}++"), F.lit(0))
    return F.filter(F.transform(found, lambda p: F.regexp_extract(p, r"(?Us)^\s*+(.*\S)?", 1)), lambda p: p != "")


def blank(piece: Column) -> Column:
    return ~piece.rlike(r"[\p{L}\p{N}]")


def strict(parts: Column, min_len: int, min_chars: int) -> Column:
    """Pieces long enough in characters and words, not of signs only."""
    return F.filter(parts, lambda p: (F.length(p) >= min_len) & T.has_words(p, min_len) & (F.length(p) >= min_chars) & ~blank(p))


def buffered(parts: Column, min_len: int, min_chars: int) -> Column:
    """Short pieces joined to the sentence before them; leading ones are a sentence of their own."""
    short = lambda p: ((F.length(p) <= min_len) & (F.size(T.words(p)) < min_len)) | (F.length(p) < min_chars) | blank(p)

    def joined(p: Column, begin: Column) -> Column:
        return F.transform(begin, lambda at, k: F.array_join(F.slice(p, at, F.coalesce(F.get(begin, k + 1), F.size(p) + 1) - at), " "))

    def cut(p: Column) -> Column:
        begin = F.filter(F.transform(p, lambda s, i: F.when((i == 0) | ~short(s), i + 1)), lambda i: i.isNotNull())
        return T.bound(begin, lambda b: joined(p, b))

    return T.bound(parts, cut)


def tokenizer(make: Callable[[], Callable[[str], list[str]]]) -> Callable[[Column], Column]:
    """Column function: the sentences that a model finds in a text; the whole text where it fails, null for null.

    ``make`` loads the model; it is called once per worker.
    """

    @pandas_udf(ArrayType(StringType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()

        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            try:
                return list(model(text))
            except Exception:
                return [text]

        for texts in parts:
            yield pd.Series([one(t) for t in texts], dtype=object)

    return run


def split(text: Column, min_len: int, min_chars: int, buffer: bool, tokenize: Callable[[Column], Column] | None = None) -> Column:
    """Sentences of a text: those of the tokenizer, if any, each cut at its boundaries; short pieces are joined within a sentence of the tokenizer."""
    cut = lambda t: (buffered if buffer else strict)(pieces(t), min_len, min_chars)
    return cut(text) if tokenize is None else F.flatten(F.transform(tokenize(text), cut))


def sentences(df: DataFrame, text: str, keys: list[str], min_len: int = 5, min_chars: int = 3, buffer: bool = True, tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, idx, sentence) of every row, in order."""
    rows = df.select(*keys, split(F.col(text), min_len, min_chars, buffer, tokenize).alias("_s"))
    return numbered(rows, keys, "sentence")


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, idx, ``name``): the items of the list ``_s``; an outer explode, as for an inner one the optimizer makes the list once more, in a filter on its size."""
    return rows.select(*keys, F.posexplode_outer("_s").alias("idx", name)).where("idx is not null")


def widths(duplicates: bool = False) -> list[int]:
    """Span widths in words; ``duplicates`` gives those on two ranges twice."""
    every = [w for a, b in X.SPAN_RANGES for w in range(a, b + 1)]
    return every if duplicates else sorted(set(every))


def _chunks(df: DataFrame, text: str, keys: list[str], script: str | None = None) -> DataFrame:
    """(keys, _at, _w, _n, _x): chunks of the words, so that no row carries the whole text, with running sums of characters and of words of mixed script.

    Lists that are never empty are exploded as outer ones: else the optimizer makes them once more, in a filter on their size.
    """
    words = df.select(*keys, T.words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    chunk = lambda at: F.struct(at.alias("at"), F.slice("_w", at + 1, CHUNK + max(widths()) - 1).alias("w"))
    chunks = words.select(*keys, F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(CHUNK)), chunk)).alias("_c"))
    running = lambda of: F.aggregate("_c.w", F.array(F.lit(0)), lambda sums, w: F.concat(sums, F.array(F.element_at(sums, -1) + of(w))))
    sums = [running(lambda w: F.length(w) + 1).alias("_n")]
    if script:
        sums.append(running(lambda w: T.mixes_scripts(w, script).cast("int")).alias("_x"))
    return chunks.select(*keys, F.col("_c.at").alias("_at"), F.col("_c.w").alias("_w"), *sums)


def _starts(of: Callable[[Column], Column]) -> Column:
    """``of`` each place of a chunk where spans start."""
    return F.transform(F.sequence(F.lit(0), F.least(F.size("_w"), F.lit(CHUNK)) - 1), of)


def span_sums(df: DataFrame, text: str, keys: list[str], min_chars: int = X.MIN_SPAN_CHARS) -> DataFrame:
    """(keys, n_spans, chars, first_span) of what ``spans`` gives, for keys that have any: their number, their characters and the smallest.

    A chunk is summed up in its row: groups of spans with a smallest text would be sorted, and spilled, span by span. The widths
    that a start allows are a range, from the first that has the characters to the last that has the words, whose characters
    are a difference of running sums. Spans of one start begin with each other, so that the shortest is the smallest of them.
    """
    lengths = widths()
    if lengths != list(range(1, lengths[-1] + 1)):
        raise ValueError("widths have a gap")
    n = lambda i: F.get(F.col("_n"), i)
    enough = lambda i, w: n(i + w) - n(i) - 1 >= min_chars

    def start(i: Column) -> Column:
        most = F.least(F.lit(lengths[-1]), F.size("_w") - i)
        least = F.coalesce(*(F.when(enough(i, w), w) for w in (1, 2)), F.get(F.filter(F.array(*map(F.lit, lengths)), lambda w: F.coalesce(enough(i, w), F.lit(False))), F.lit(0)))

        def some(w: Column) -> Column:
            count = (most - w + 1).cast("long")
            chars = F.get(F.col("_m"), i + most + 1) - F.get(F.col("_m"), i + w) - count * (n(i) + 1)
            first = F.when(w == 1, F.get(F.col("_w"), i)).otherwise(F.array_join(F.slice("_w", i + 1, w), " "))
            return F.when(w <= most, F.struct(count.alias("n"), chars.alias("chars"), first.alias("first")))

        return T.bound(least, some)

    sums = _chunks(df, text, keys)
    sums = sums.withColumn("_m", F.aggregate("_n", F.array(F.lit(0).cast("long")), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))))
    sums = sums.select(*keys, F.filter(_starts(start), lambda s: s.isNotNull()).alias("_s"))
    total = lambda c: F.aggregate("_s", F.lit(0).cast("long"), lambda sum, s: sum + s[c])
    sums = sums.select(*keys, total("n").alias("n_spans"), total("chars").alias("chars"), F.array_min("_s.first").alias("first_span"))
    return sums.groupBy(*keys).agg(F.sum("n_spans").alias("n_spans"), F.sum("chars").alias("chars"), F.min("first_span").alias("first_span")).where("n_spans > 0")


def spans(df: DataFrame, text: str, keys: list[str], min_chars: int = X.MIN_SPAN_CHARS, duplicates: bool = False, script: str | None = None) -> DataFrame:
    """(keys, s, e, chars, span): every run of the allowed widths, without those that hold a word of mixed script."""
    lengths = widths(duplicates)
    most = max(lengths)
    # rows carry a chunk of the words, then the words of one start only, and not the whole text
    chunks = _chunks(df, text, keys, script)

    def start(i: Column) -> Column:
        since = lambda c: F.transform(F.slice(c, i + 2, most), lambda x: x - F.get(F.col(c), i))
        mixed = [since("_x").alias("x")] if script else []
        return F.struct((F.col("_at") + i).alias("s"), F.array_join(F.slice("_w", i + 1, most), " ").alias("t"), since("_n").alias("n"), *mixed)

    starts = chunks.select(*keys, F.explode_outer(_starts(start)).alias("_s"))
    ok = lambda w: (F.get(F.col("_s.n"), w - 1) > min_chars) & (F.get(F.col("_s.x"), w - 1) == 0 if script else F.lit(True))
    made = starts.select(*keys, "_s.s", "_s.t", "_s.n", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda w: F.coalesce(ok(w), F.lit(False)))).alias("_width"))
    chars = F.get(F.col("n"), F.col("_width") - 1) - 1
    return made.select(*keys, "s", (F.col("s") + F.col("_width")).alias("e"), chars.alias("chars"), F.left("t", chars).alias("span"))
