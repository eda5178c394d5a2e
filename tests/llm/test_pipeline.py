import collections
import os
import re
import subprocess
import sys

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    from polyweave.llm.tables import land

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = land(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        after = collections.Counter(r.doc_id for r in docs.collect())
        assert set(after) <= set(before)
        if name == "quality classifier":
            gone = [labels[i] for i in set(before) - set(after) if i in labels]
            assert gone.count(0) >= 0.95 * list(labels.values()).count(0) and gone.count(1) <= 0.02 * len(labels)
        if name == "line dedup":
            assert all(set((r.text or "").split("\n")) <= set((before[r.doc_id] or "").split("\n")) for r in docs.collect())
        if name == "mixing":
            assert set(after.values()) <= {1, 2}
        before = {r.doc_id: r.text for r in docs.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    fill = collections.Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert sum(n != 4096 for n in fill.values()) <= 1


def test_mixing_prefers_good_texts(spark):
    """Of texts without signs, those labelled good enter the fraction of an epoch more often than those labelled poor."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    plain = docs.where(r"not text rlike '[!#$%&*+<=>@^_|~]'").join(labels.select("doc_id", "quality"), "doc_id").orderBy("doc_id").collect()
    rows, quality = [], {}
    for wanted in (0, 1):
        for i, r in enumerate([r for r in plain if r.quality == wanted][:7]):
            for k in range(30):
                quality[at := 1000 * wanted + 100 * i + k] = wanted
                rows.append((at, " ".join(r.text.split()[:60]), "a"))
    out = corpus_pipeline.mixing(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf)
    twice = collections.Counter(quality[i] for i, n in collections.Counter(r.doc_id for r in out.collect()).items() if n == 2)
    assert twice[1] > 2 * twice[0] and twice[1] > 0.5 * sum(quality.values())


def test_stages_on_edge_cases(spark):
    """Nulls in every column, blank and long texts, repeated rows, no rows, columns that share names with what operators add."""
    from polyweave.llm.tables import land

    line = "the quick brown fox jumps over the lazy dog and then goes home to rest a while"
    rows = [
        (1, line, "en", "a", 5), (1, line, "en", "a", 5), (2, line + " now", "en", None, 5), (None, "seven words that no other line has", None, "a", None),
        (None, "and six that are found nowhere else", "en", "a", 1), (2, "another text under an id that is taken", "en", "b", 2), (None, line, "en", "b", 3),
        (3, None, "en", "b", 0), (4, "", None, None, 0), (None, None, None, None, None), (5, " \n\t", "de", "b", 3), (6, "x" * 200_000, "en", "a", 9),
        (7, (line + "\n") * 5000, "en", "b", 1), (8, "a b", "fr", "b", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    added = ["score", "predicted", "taken", "size", "target", "source_size", "_whole", "_rest", "_turn", "doc", "doc_i", "k", "component", "n.m"]
    more = ", ".join(f"`{c}` string" for c in added)
    plain, clash = spark.createDataFrame(rows, schema), spark.createDataFrame([(*r, *added) for r in rows], f"{schema}, {more}")
    sf = "/root/testdata/sf0.001"
    own = {(None, rows[3][1]), (None, rows[4][1]), (2, rows[5][1])}
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert {tuple(r)[:2] for r in stage(spark, plain, sf).collect()} >= own, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = [land(stage(spark, d, sf), "edge") for d in (plain, clash, plain.where("false"), clash.where("false"))]
        found = [sorted(map(str, (tuple(r)[:5] for r in o.collect()))) for o in out]
        assert found[0] == found[1] and found[0] and not found[2] + found[3], name
        assert [o.columns for o in out] == [plain.columns, clash.columns] * 2
        assert {tuple(r)[5:] for r in out[1].collect()} == {tuple(added)}, name
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, clash, sf).count() >= len(rows) and pack(spark, plain.where("false"), sf).count() == 0


def test_mixing_counts_words_of_long_texts(spark):
    """A document of eight million words fits a heap that a list of its words does not; what counts as a word stays."""
    from polyweave.llm import source_mixing

    code = """
from pyspark.sql import SparkSession
import corpus_pipeline

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.range(1).selectExpr("id as doc_id", "repeat('a ', cast(8000000 + id as int)) as text", "'a' as source")
out = corpus_pipeline.mixing(spark, docs, "/root/testdata/sf0.001")
print("taken", [r.n for r in out.selectExpr("length(text) as n").collect()])
"""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "taken [16000000, 16000000]" in done.stdout, done.stderr[-2000:]

    odd = [None, "", " ", "\t\n", " a", "a ", "  a  b\x0b\x0c\rc ", "\U0001d4b3 y", "x\x85y\u2028z", "\x1c a \x1f", "$1 \\x", " \n $ \\ ", "a\x00b c"]
    got = spark.createDataFrame([(s,) for s in odd], "text string").select("text", source_mixing.words_in("text").alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall(source_mixing.WORDS, r.text or "")) for r in got]
