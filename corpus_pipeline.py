"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``.

1. quality classifier: documents predicted poor go;
2. line dedup: lines that repeat an earlier line, up to one edited word, go, and
   with them documents of which nothing is left;
3. n-gram Jaccard join: of near-equal documents the one with the smallest id stays;
4. mixing: sources are brought to their target weights; a document taken twice is there twice;
5. packing: token sequences in which every window has the sources' proportions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyweave.llm import line_dedup, ngram_jaccard, packing, quality, source_mixing
from polyweave.llm.tables import land


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, predicts good."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier."""
    return line_dedup.rewrite(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal ones."""
    return ngram_jaccard.keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, sampled by the quality that the first stage's model predicts."""
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return source_mixing.mixture(docs, model)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their sequences."""
    return packing.pack_query(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing", mixing),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written out and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = land(docs, f"stage-{i + 1}")
    return docs
