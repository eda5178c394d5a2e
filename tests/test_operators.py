import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from polyweave.operators import align, audio, corpus, manifest, similarity
from polyweave.operators.embed import embed_once, embedder, hashing


def test_mutual_ties_and_threshold(spark):
    left = spark.createDataFrame([("b", 0, [0.9, 0.9, 0.0]), ("b", 1, [0.8, 0.9, 0.0]), ("b", 2, [0.0, 0.0, 0.1]), ("b", 3, None)], "block string, i long, v array<double>")
    right = spark.createDataFrame([("b", j, [float(j == k) for k in range(3)]) for j in range(3)], "block string, j long, v array<double>")
    ranks = similarity.ranked(left, right, ["block"], 3)
    got = {(r.i, r.j) for r in similarity.mutual(ranks, ["block"], 1, 0.2).collect()}
    assert got == {(0, 0)}  # j = 1 prefers the smaller of two equal i
    three = similarity.usage_capped(similarity.mutual(ranks, ["block"], 3, 0.2), ["block"], 1).collect()
    assert len({r.i for r in three}) == len(three) == len({r.j for r in three})
    one = similarity.mutual(ranks, ["block"], 1, 0.2)
    assert similarity.all_compared(ranks, one, ["block"]).count() == 3
    rows = {r.i: (r.j, r.raw_similarity, r.similarity, r.aligned) for r in similarity.all_compared(ranks, one, ["block"], side="i").collect()}
    assert rows == {0: (0, 0.9, 0.9, True), 1: (1, 0.9, 0.45, False), 2: (2, 0.1, 0.05, False)}


@pytest.mark.parametrize("tile", [2048, 7])
def test_tiles_against_all_pairs(spark, tile, monkeypatch):
    """Ranks, threshold pairs, short lists and capped matches are those of the whole matrix, however it is cut."""
    monkeypatch.setattr(similarity, "TILE", tile)
    rng = random.Random(4)
    vector = lambda: [rng.randint(-2, 2) / 2 for _ in range(4)]  # noqa: E731  many ties
    left = [(b, i, vector(), vector()) for b in "xy" for i in range(23)]
    right = [(b, j, vector(), vector()) for b in "xyz" for j in range(31)]
    a, b = spark.createDataFrame(left, "g string, i long, v array<double>, w array<double>"), spark.createDataFrame(right, "g string, j long, v array<double>, w array<double>")
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    pairs = {(g, i, j): (dot(v, x), dot(w, y)) for g, i, v, w in left for h, j, x, y in right if g == h}
    f = {k: 1 + sum(g == k[0] and i == k[1] and (-s[0], j) < (-pairs[k][0], k[2]) for (g, i, j), s in pairs.items()) for k in pairs}
    r = {k: 1 + sum(g == k[0] and j == k[2] and (-s[0], i) < (-pairs[k][0], k[1]) for (g, i, j), s in pairs.items()) for k in pairs}
    ranks = similarity.ranked(a.drop("w"), b.drop("w"), ["g"], 3)
    assert {(x.g, x.i, x.j, x.sim, x.f) for x in ranks.where("f <= 3").collect()} == {(*k, pairs[k][0], f[k]) for k in pairs if f[k] <= 3}
    assert {(x.g, x.i, x.j, x.b) for x in ranks.where("b <= 3").collect()} == {(*k, r[k]) for k in pairs if r[k] <= 3}
    assert {(x.g, x.i, x.j) for x in similarity.scores(a, b, ["g"], 1.5).collect()} == {k for k in pairs if pairs[k][0] >= 1.5}
    assert {(x.g, x.i, x.j, x.second) for x in similarity.shortlist(a, b, ["g"], 5).collect()} == {(*k, pairs[k][1]) for k in pairs if f[k] <= 5}
    for most in (1, 2):
        used, want = {}, set()
        matches = similarity.mutual(ranks, ["g"], 3, -9.0)
        for x in sorted(matches.collect(), key=lambda x: (x.g, -x.sim, x.i, x.j)):
            ends = (x.g, "i", x.i), (x.g, "j", x.j)
            if all(used.get(e, 0) < most for e in ends):
                want.add((x.g, x.i, x.j))
                used |= {e: used.get(e, 0) + 1 for e in ends}
        assert {(x.g, x.i, x.j) for x in similarity.usage_capped(matches, ["g"], most).collect()} == want


def fold(rows, override, margin=0.1):
    """The choice among candidates as a loop over arrivals."""
    held = {}
    for r in rows:
        k, old = r["key"], held.get(r["key"])
        if old is None:
            held[k] = r
        elif r["aligned"] != old["aligned"]:
            held[k] = r if r["aligned"] else old
        elif r["stage"] == old["stage"]:
            held[k] = r if r["similarity"] > old["similarity"] else old
        elif override and r["aligned"] and old["stage"] == "sliding" and r["stage"] != "sliding":
            weak = old["threshold"] and (old["similarity"] - old["threshold"]) / old["threshold"] < margin
            held[k] = r if weak else old
    return {k: r["ordinal"] for k, r in held.items()}


@pytest.mark.parametrize("override", [False, True])
def test_collapse_is_the_fold(spark, override):
    rng = random.Random(3)
    rows = []
    for key in range(300):
        own = [{"key": key, "stage": s, "threshold": 0.5, "aligned": rng.random() < 0.6, "similarity": rng.randint(40, 70) / 100} for s in ["sliding"] * rng.randint(0, 3) + ["mutual_topk_cosine"] * rng.randint(0, 3)]
        rows += own
    rows = [{**r, "ordinal": i} for i, r in enumerate(rows)]
    got = {r.key: r.ordinal for r in align.collapse(spark.createDataFrame(rows), ["key"], override).collect()}
    assert got == fold(rows, override)


def test_frontier_and_deoverlap(spark):
    rng = random.Random(5)
    rows = [(b, i, s, s + rng.randint(1, 9), rng.randint(30, 90) / 100) for b in range(6) for i in range(12) for s in rng.sample(range(120), 5)]
    df = spark.createDataFrame(rows, "b int, i long, s long, e long, sim double")
    want = set()
    for b in range(6):
        at = 0
        for i in range(12):
            fit = [r for r in rows if r[:2] == (b, i) and r[4] >= (0.5 if r[2] >= at - 15 else 0.75)]
            if fit:
                best = min(fit, key=lambda r: (-r[4], r[2], r[3]))
                want.add(best)
                at = max(at, best[3])
    walked = align.frontier(df, ["b"], 0.5, 0.75)
    assert {tuple(r) for r in walked.collect()} == want
    kept = []
    for r in sorted(want, key=lambda r: (-r[4], r[1])):
        if all(r[0] != k[0] or r[3] <= k[2] or k[3] <= r[2] for k in kept):
            kept.append(r)
    got = align.deoverlap(walked, ["b"])
    shown = align.compared(df, walked, got, ["b"]).collect()
    assert len(shown) == 72 and {(r.b, r.i, r.s, r.e) for r in shown if r.aligned} == {k[:4] for k in kept}
    assert {(r.b, r.i, r.s, r.e) for r in shown} >= {w[:4] for w in want} and all(r.similarity == r.raw_similarity if r.aligned else r.similarity <= 0.5 for r in shown)
    assert {tuple(r) for r in got.select("b", "i", "s", "e", "sim").collect()} == set(kept)
    n = spark.createDataFrame([(b, 140) for b in range(7)], "b int, n long")
    segs = align.segments(got, n, ["b"])
    assert all(r.ok for r in align.coverage(segs, n, ["b"]).collect())
    for _, rows in itertools.groupby(sorted(segs.collect(), key=lambda r: (r.b, r.s)), key=lambda r: r.b):
        at = 0
        for r in rows:
            assert r.s == at
            at = r.e


def test_wide_and_pairs(spark):
    rows = spark.createDataFrame([("e", "A", "x"), ("e", "A", "x"), ("e", "B", "y"), ("f", "A", None)], "k string, l string, t string")
    table = corpus.wide(rows, "k", "l", "t", ["A", "B", "C"])
    assert [tuple(r) for r in table.collect()] == [("e", ["x"], ["y"], None)]
    assert corpus.enough_languages(table, ["A", "B", "C"], 0.5).count() == 1  # round half to even: 2
    assert corpus.enough_languages(table, ["A", "B", "C"], 0.9).count() == 0
    lists = spark.createDataFrame([("E", "id", ["a", "b"], ["1"]), ("E", "id", ["c", None], ["3", "4"]), (None, "id", ["d"], ["5"])], "English string, English_sentence_id string, L array<string>, L_sentence_ids array<string>")
    assert {(r.text, r.sentence_id) for r in corpus.explode_pairs(lists, "L", "English").collect()} == {("a", None), ("b", None), ("c", "3")}


@pytest.mark.parametrize("n", [999, 1000, 1001, 1300])
def test_split_sizes(spark, n):
    rows = spark.range(n).select(F.lit("p").alias("pair"), F.col("id").alias("key"), F.when(F.col("id") % 7 != 0, F.col("id") / n).alias("similarity"))
    got = {r.split: r["count"] for r in manifest.split(rows, "pair", "key").groupBy("split").count().collect()}
    assert got == ({} if n < 1000 else {"valid": n // 20, "test": 500, "train": n - n // 20 - 500})


def test_manifest_records(spark):
    rows = spark.createDataFrame([("p", "train", "hin", "अ", None, None, "eng", "a", "x", [1])], "pair string, split string, source_lang string, source_text string, source_path string, source_units array<int>, target_lang string, target_text string, target_path string, target_units array<int>")
    record = json.loads(manifest.records(rows, "pair", ["source_text"]).first().record)
    assert record["source"] == {"id": 1, "lang": "hin", "text": "अ", "audio_local_path": None, "waveform": None, "sampling_rate": 16000, "units": None} and record["target"]["units"] == [1]


def test_embed_and_audio(spark, tmp_path):
    import wave

    rows = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    got = embed_once(rows, "t", embedder(hashing, lambda: hashing(8))).collect()
    assert [len(r.v) for r in got if r.t] == [72, 72] and [r.v for r in got if r.t is None] == [None]
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(b"\x00\x10" * 16000)
    (tmp_path / "b.wav").write_bytes(b"no audio")
    paths = spark.createDataFrame([(str(tmp_path / f),) for f in ("a.wav", "b.wav", "c.wav")], "path string")
    found = {r.path[-5:]: r for r in audio.add_units(paths, spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert found["a.wav"].units == [12] and found["a.wav"].sample_rate == 16000
    assert found["b.wav"].units is None and found["c.wav"].units is None


def test_embedders(spark):
    import numpy as np

    seen = []

    def tagged(texts, tag=None):
        seen.append(tag)
        return np.array([[len(t), 1.0 if tag == "x" else 2.0] for t in texts])

    import polyweave.operators.embed as E

    rows = spark.createDataFrame([("ab", "x"), ("ab", "y"), ("ab", "x"), (None, "x"), ("abcd", None)], "t string, tag string")
    got = [(r.t, r.tag, r.v) for r in E.embed_once(rows, "t", E.embedder(lambda: E.clipped(tagged, 3)), tag="tag").collect()]
    want = {("ab", "x"): [2, 1], ("ab", "y"): [2, 2], ("abcd", None): [3, 2]}
    assert len(got) == 5 and all(v is None if t is None else np.allclose(v, np.array(want[t, k]) / np.linalg.norm(want[t, k]), atol=1e-6) for t, k, v in got)
    tokens = lambda texts, tag: (np.arange(12.0).reshape(2, 3, 2), np.array([[1, 1, 0], [0, 0, 0]]))
    assert E.pooled(tokens)(["a", "b"], None).tolist() == [[1.0, 2.0], [0.0, 0.0]]
    x = E.hashing(16)(["Abc", "abc", "abd", ""])
    assert (x[0] == x[1]).all() and (x[0] != x[2]).any() and np.abs(x[0]).sum() <= 4 + 3 + 2


def test_positions_languages_and_counts(spark, tmp_path):
    from polyweave import log
    from polyweave.sources import files, sinks

    rows = spark.createDataFrame([("Hindi", "e1", k, f"id{k}", t) for k, t in enumerate(("one", "two\nlines", "three"))], "language string, episode string, idx int, sentence_id string, text string")
    sinks.lines(rows, f"{tmp_path}/lines", ["language", "episode"], "idx", "text")
    sinks.id_sidecar(rows, f"{tmp_path}/ids", ["language", "episode"], "idx")
    keys, pattern = ["language", "episode"], "language=([^/]+)/episode=([^/]+)/"
    lines, side = files.numbered_lines(spark, f"{tmp_path}/lines/*/*", pattern, keys), files.sidecar(spark, f"{tmp_path}/ids/*/*", pattern, keys)
    got = corpus.positional_join(lines, side, keys).collect()
    assert {(r.language, r.line_index, r.text, r.sentence_id) for r in got} == {("Hindi", 0, "one", "id0"), ("Hindi", 1, "two lines", "id1"), ("Hindi", 2, "three", "id2")}
    texts = spark.createDataFrame([("English", "the cat"), ("English", "le chat"), ("Bodo", "the cat"), ("Bodo", "le chat"), ("Bodo", None)], "l string, t string")
    detect = lambda t: F.when(t.contains("the"), "en").when(t.isNotNull(), "xx")
    assert {tuple(r) for r in corpus.right_language(texts, "t", "l", detect).collect()} == {("English", "the cat"), ("Bodo", "le chat"), ("Bodo", None)}
    log.to(f"{tmp_path}/log")
    assert log.tell("texts", texts, null=F.col("t").isNull()) == {"rows": 5, "null": 1} and "texts: rows 5, null 1" in (tmp_path / "log").read_text()
    (tmp_path / "bad.json").write_text('[{"a": 1}')
    (tmp_path / "empty.tsv").write_text("")
    (tmp_path / "good.json").write_text('[{"a": 1}, {"a": 2}]')
    array = lambda spark, path: files.json_array(spark, path, "a int")
    assert files.safe(spark, f"{tmp_path}/none.json", array) is None and files.safe(spark, f"{tmp_path}/bad.json", array) is None
    assert files.safe(spark, f"{tmp_path}/empty.tsv", files.id_tsv) is None and files.safe(spark, f"{tmp_path}/good.json", array).count() == 2


def test_sinks(spark, tmp_path):
    from polyweave.sources import sinks
    from polyweave.sources.xlsx import XlsxSource

    rows = spark.createDataFrame([("a", ["x", "y"], 1), ("b", None, 2), ("a", ["x", "y"], 0)], "k string, l array<string>, n int").coalesce(1)
    for kind in ("parquet", "tsv", "json", "xlsx"):
        sinks.table(rows, f"{tmp_path}/{kind}", kind, ("k",))
    assert spark.read.parquet(f"{tmp_path}/parquet").where("k = 'a'").count() == 2
    assert spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(f"{tmp_path}/tsv").where("k = 'a'").first().l == '["x","y"]'
    assert {r.l is None for r in spark.read.json(f"{tmp_path}/json").collect()} == {True, False}
    spark.dataSource.register(XlsxSource)
    assert sorted(map(tuple, spark.read.format("xlsx").schema("k string, l string, n int").load(f"{tmp_path}/xlsx/*.xlsx").collect()), key=str) == [("a", '["x","y"]', 0), ("a", '["x","y"]', 1), ("b", None, 2)]
    cells = spark.createDataFrame([("9", "t"), ("1", "t"), ("2", "u"), ("3", None)], "i string, t string")
    assert {tuple(r) for r in sinks.distinct_cells(cells, "i", "t").collect()} == {("1", "t"), ("2", "u")}
    lists = spark.createDataFrame([(["1", "2"], ["t", "u"]), (["1", "2"], ["t", "u"]), (None, None)], "i array<string>, t array<string>")
    assert sorted(map(tuple, sinks.distinct_cells(lists, "i", "t").collect())) == [("1", "t"), ("2", "u")]
    sheet = spark.createDataFrame([("x", "e", 0.5)], "A string, English string, similarity double")
    assert sinks.alignment_sheet(sheet, f"{tmp_path}/sheet", "A") and not sinks.alignment_sheet(sheet, f"{tmp_path}/none", "B") and not sinks.alignment_sheet(sheet.where("false"), f"{tmp_path}/none", "A")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/sheet").collect()] == [("x", "e", 0.5, 0.5, True, "sliding", None, None)]
