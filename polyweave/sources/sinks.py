"""Writers. Each writes to a new folder; none overwrites what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyweave.functions import text as T
from polyweave.log import log

#: Columns of a standard alignment sheet besides the language's own.
SHEET = ("English", "similarity", "raw_similarity", "aligned", "stage")


def _tsv(rows: DataFrame, path: str, header: bool, by: tuple[str, ...] = ()) -> None:
    rows.write.partitionBy(*by).option("sep", "\t").option("quote", "").option("header", header).option("emptyValue", "").option("nullValue", "").csv(path)


def _flat(rows: DataFrame) -> DataFrame:
    """Lists and structs as JSON text, for formats that have cells only."""
    return rows.select(*(F.to_json(f"`{c}`").alias(c) if t.startswith(("array", "struct")) else F.col(f"`{c}`") for c, t in rows.dtypes))


def table(rows: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """A table as parquet, tsv (with header), json (a line per row, nulls written) or xlsx (a sheet per task).

    ``by`` makes a folder per value of these columns; in sheets they stay columns.
    """
    if kind == "parquet":
        rows.write.partitionBy(*by).parquet(path)
    elif kind == "tsv":
        flat = _flat(rows)
        text = (T.tsv_field(F.col(f"`{c}`")).alias(c) if t == "string" and c not in by else F.col(f"`{c}`") for c, t in flat.dtypes)
        _tsv(flat.select(*text), path, True, by)
    elif kind == "json":
        line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in by)), {"ignoreNullFields": "false"})
        rows.select(*by, line.alias("value")).write.partitionBy(*by).text(path)
    elif kind == "xlsx":
        from polyweave.shipping import ship
        from polyweave.sources.xlsx import XlsxSource

        ship(rows.sparkSession)
        rows.sparkSession.dataSource.register(XlsxSource)
        _flat(rows).write.format("xlsx").mode("append").save(path)
    else:
        raise ValueError(f"no writer for {kind}")


def lines(rows: DataFrame, path: str, keys: list[str], order: str, text: str) -> None:
    """One stripped text per line, in order, a folder per key."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    dealt.select(*keys, F.trim(F.regexp_replace(text, r"[\r\n]+", " ")).alias("value")).write.partitionBy(*keys).text(path)


def id_sidecar(rows: DataFrame, path: str, keys: list[str], order: str) -> None:
    """line index, sentence id and text in the order of ``lines``, a folder per key."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    dealt = rows.withColumn("line_index", number).repartition(*keys).sortWithinPartitions(*keys, order)
    _tsv(dealt.select(*keys, "line_index", "sentence_id", T.tsv_field(F.col("text")).alias("text")), path, False, tuple(keys))


def paragraph_sidecar(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Six columns per segment, a folder per key; empty where a gap has neither English nor similarity."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "seg_idx")
    english, score = F.coalesce("english", F.lit("")), F.coalesce(F.col("similarity").cast("string"), F.lit(""))
    _tsv(dealt.select(*keys, "seg_idx", "sentence_id", "aligned", T.tsv_field(english).alias("english"), score.alias("similarity"), T.tsv_field(F.col("text")).alias("text")), path, False, tuple(keys))


def split_segments(segments: DataFrame, path: str, keys: list[str]) -> None:
    """Texts of the aligned and of the other segments, each with the ids of its lines, and all in order with the paragraph's sidecar."""
    for name, rows in (("aligned_audio", segments.where("aligned")), ("unaligned_audio", segments.where("not aligned"))):
        lines(rows, f"{path}/{name}", keys, "seg_idx", "text")
        id_sidecar(rows, f"{path}/{name}_ids", keys, "seg_idx")
    lines(segments, f"{path}/full_paragraph", keys, "seg_idx", "text")
    paragraph_sidecar(segments, f"{path}/full_paragraph_ids", keys)


def id_tsv(rows: DataFrame, path: str, ids: str, texts: str, by: tuple[str, ...] = ()) -> None:
    """Distinct non-null cells, lists flattened in order; of equal cells the one with the smallest id."""
    cells = distinct_cells(rows, ids, texts, by)
    _tsv(cells.select(*by, F.col(ids), T.tsv_field(F.col(texts)).alias(texts)), path, False, by)


def distinct_cells(rows: DataFrame, ids: str, texts: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ids, texts) of ``id_tsv``."""
    cells = rows.where(F.col(texts).isNotNull()).groupBy(*by, texts).agg(F.min(ids).alias(ids)).select(*by, ids, texts)
    if dict(cells.dtypes)[texts].startswith("array"):
        pair = F.posexplode(F.arrays_zip(F.col(ids).alias("i"), F.col(texts).alias("t"))).alias("n", "p")
        cells = cells.select(*by, pair).select(*by, F.col("p.i").alias(ids), F.col("p.t").alias(texts))
    return cells


def alignment_sheet(rows: DataFrame, path: str, language: str, kind: str = "parquet", more: tuple[str, ...] = ()) -> bool:
    """The eight standard columns, defaults filled in; nothing, and a word in the log, where a column is missing or no row is there."""
    given = set(rows.columns)
    missing = {language, "English", "similarity"} - given
    if missing or not rows.head(1):
        log.warning("no sheet %s: %s", path, f"without {', '.join(sorted(missing))}" if missing else "no rows")
        return False
    full = rows.withColumn("stage", F.col("stage") if "stage" in given else F.lit("sliding"))
    full = full.withColumn("aligned", F.col("aligned") if "aligned" in given else F.lit(True))
    full = full.withColumn("raw_similarity", F.coalesce("raw_similarity", "similarity") if "raw_similarity" in given else F.col("similarity"))
    ids = (f"{language}_sentence_id", "English_sentence_id")
    for c in ids:
        full = full if c in given else full.withColumn(c, F.lit(None).cast("string"))
    table(full.select(language, *SHEET, *more, *ids), path, kind)
    return True


def merged(rows: DataFrame, path: str, by: str = "language", kinds: tuple[str, ...] = ("parquet",)) -> None:
    """The merged table in each format asked for; beyond one, in a folder each."""
    for kind in kinds:
        table(rows, path if len(kinds) == 1 else f"{path}/{kind}", kind, (by,))


def enriched_tsv(rows: DataFrame, path: str) -> None:
    _tsv(_flat(rows), path, True)


def splits(rows: DataFrame, path: str, pair: str, kinds: tuple[str, ...] = ("parquet",)) -> None:
    """The split rows by pair and split, in each format asked for."""
    for kind in kinds:
        table(rows, path if len(kinds) == 1 else f"{path}/{kind}", kind, (pair, "split"))


def manifest(records: DataFrame, path: str, pair: str) -> None:
    """Nested JSON lines, a folder per pair and split, in the order of ids."""
    dealt = records.repartition(pair, "split").sortWithinPartitions(pair, "split", "id")
    dealt.select(pair, "split", F.col("record").alias("value")).write.partitionBy(pair, "split").text(path)
