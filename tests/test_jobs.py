import json

from pyspark.sql import functions as F

from polyweave.plans import build, cli
from polyweave.sources import files
from polyweave.sources.xlsx import XlsxSource, read_rows, read_sheets, write_rows
from polyweave.streaming import incremental


def corpus(root):
    texts = {"English": "The cat sat on the mat today. We like to walk in the park at night.", "Bodo": "The cat sat on the mat today. We like to walk in the park at night.", "Hindi": "We like to walk in the park at night. The cat sat on the mat today."}
    for language, text in texts.items():
        d = root / language / "MKB_2_x"
        d.mkdir(parents=True)
        (d / "MKB_2_x.txt").write_text(text)
        (d / "other.txt").write_text("not read")
    return root


def test_align_job(spark, tmp_path):
    root = corpus(tmp_path / "text")
    rows = files.transcripts(spark, str(root))
    assert rows.count() == 3 and files.transcripts(spark, str(root), ["Hindi"]).count() == 2 and files.transcripts(spark, str(tmp_path / "none")).count() == 0
    assert [r.episode_no for r in files.episodes(rows).collect()] == [2.0]
    out = tmp_path / "out"
    cli.run_align(spark, str(root), str(out), options=build.Options(single_score=()), save_all=True, debug=True, kinds=("tsv",))
    wide = [json.loads(line) for f in (out / "all_aligned").glob("part-*") for line in f.read_text().splitlines()]
    complete = spark.read.parquet(str(out / "all_pairs_before_threshold"))
    assert complete.groupBy("language", "episode").count().collect() and {r["count"] for r in complete.groupBy("language", "episode").count().collect()} == {2}
    both = spark.read.parquet(str(out / "aligned_both_candidates")).groupBy("language", "i").agg(F.count_if("is_selected_best").alias("n")).collect()
    assert {r.n for r in both} == {1} and all((out / f"sheets/Hindi_{v}.tsv").exists() for v in ("aligned", "sliding_aligned", "aligned_topk_only", "all_pairs_before_threshold"))
    lines = {p.parent.parent.name + "/" + p.parent.name: p.read_text() for p in (out / "full_paragraph").glob("*/*/part-*")}
    assert lines["language=Hindi/episode=MKB_2_x"].replace("\n", " ").split() == "We like to walk in the park at night. The cat sat on the mat today.".split()
    side = [line.split("\t") for p in (out / "full_paragraph_ids/language=Hindi").glob("*/part-*") for line in p.read_text().splitlines()]
    assert all(len(x) == 6 for x in side) and [int(x[0]) for x in side] == list(range(len(side)))
    ids = [line.split("\t") for p in (out / "en_aligned/language=Hindi").glob("*/part-*") for line in p.read_text().splitlines()]
    assert {x[1] for x in ids} == {w["Hindi"][0] for w in wide} and all(x[0].startswith("MKB_2_x_Hindi_") for x in ids)
    assert {w["English"] for w in wide} == {"The cat sat on the mat today.", "We like to walk in the park at night."}
    assert all(w["Hindi"] == [w["English"]] and len(w["Hindi_sentence_ids"]) == 1 for w in wide)
    segs = spark.read.parquet(str(out / "segments"))
    sums = segs.groupBy("language").agg(F.sum(F.col("e") - F.col("s")).alias("n")).collect()
    assert {r.n for r in sums} == {16}


def test_sheets(spark, tmp_path):
    data = write_rows(["A", "A_sentence_id", "similarity"], [("x<&\u0001", "1", 0.5), (None, "2", 1), ("y", "1", None)])
    rows = list(read_rows(data))
    assert rows[0] == ["A", "A_sentence_id", "similarity"] and rows[1] == ["x<&", "1", 0.5] and rows[2][:2] == [None, "2"]
    d = tmp_path / "ep1"
    d.mkdir()
    (d / "A_aligned.xlsx").write_bytes(data)
    (d / "all_aligned.xlsx").write_bytes(data)
    (d / "B_aligned.xlsx").write_bytes(b"broken")
    listed = files.binary(spark, f"{tmp_path}/*/*.xlsx")
    assert {r.file for r in files.sheets(listed).collect()} == {"A_aligned.xlsx", "B_aligned.xlsx"} and files.sheets(listed, ["ep1"]).count() == 0
    schema = "A string, A_sentence_id string, similarity double"
    assert read_sheets(listed.where("path like '%/A_%' or path like '%/B_%'"), schema).count() == 3
    cli.run_merge_sheets(spark, f"{tmp_path}/*/*.xlsx", str(tmp_path / "merged"), schema)
    assert spark.read.parquet(str(tmp_path / "merged")).count() == 2
    spark.dataSource.register(XlsxSource)
    spark.createDataFrame([("q", 1.5)], "a string, b double").coalesce(1).write.format("xlsx").mode("append").save(str(tmp_path / "w"))
    assert [tuple(r) for r in spark.read.format("xlsx").schema("a string, b double, c string").load(f"{tmp_path}/w/*.xlsx").collect()] == [("q", 1.5, None)]


def test_enrich_and_merge(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('1\ttext "one"\n2\ttwo\n')
    (tmp_path / "m.json").write_text('{"id":"1","audio_filepath":"/none.wav","duration":1.5}\n{"audio_filepath":"x"}\n')
    rows = cli.run_enrich(spark, str(tmp_path / "a.tsv"), str(tmp_path / "m.json"), str(tmp_path / "*.tsv"), str(tmp_path / "x/Hindi/ep"), "Hindi")
    assert {(r.sentence_id, r.text, r.duration, r.Hindi_Units) for r in rows.collect()} == {("1", 'text "one"', 1.5, None), ("2", "two", None, None)}
    cli.run_merge_tsv(spark, f"{tmp_path}/x/*/*/*.csv", str(tmp_path / "merged"), "sentence_id string, text string, path string")
    assert {(r.language, r.text) for r in spark.read.parquet(str(tmp_path / "merged")).collect()} == {("Hindi", 'text "one"'), ("Hindi", "two")}


def test_watch(spark, tmp_path):
    root, seen = corpus(tmp_path / "in"), []
    query = incremental.watch(spark, str(root), lambda df, _: seen.extend(r.language for r in df.where("text <> 'not read'").collect()), str(tmp_path / "state"))
    query.awaitTermination()
    assert sorted(seen) == ["Bodo", "English", "Hindi"]


def test_force_align(spark, tmp_path):
    import pytest

    base = tmp_path / "in"
    for language, episode, parts in (("English", "MKB_60_a", "tw"), ("English", "MKB_59_b", "tw"), ("English", "MKB_58_c", "t"), ("Hindi", "MKB_61_d", "tw"), ("Hindi", "MKB_3_fail", "tw")):
        d = base / language / episode
        d.mkdir(parents=True)
        for kind, name in (("t", f"{episode}_split_sentences.txt"), ("w", f"{episode}.wav")):
            if kind in parts:
                (d / name).write_text("x")
    program = tmp_path / "align.sh"
    program.write_text('case "$*" in *fail*) echo broken >&2; exit 3;; esac\necho "$@" > "${10}/args"\n')
    got = cli.run_force_align(spark, str(base), str(tmp_path / "out"), "/uroman", ["sh", str(program)], "MKB_59_b")
    assert {(r.language, r.episode, r.status) for r in got.collect()} == {("English", "MKB_59_b", "done"), ("English", "MKB_58_c", "skipped"), ("Hindi", "MKB_61_d", "done"), ("Hindi", "MKB_3_fail", "failed")}
    assert "broken" in got.where("status = 'failed'").first().message
    assert "--lang hi --uroman_path /uroman" in (tmp_path / "out/Hindi/MKB_61_d/MKB_61_d/args").read_text()
    with pytest.raises(ValueError):
        cli.run_force_align(spark, str(base), str(tmp_path / "out2"), "/uroman", ["true"], "MKB_1_none")


def test_tokenizer(spark):
    from polyweave.operators import segment

    def make():
        def model(text):
            if "fail" in text:
                raise RuntimeError
            return text.split("#")

        return model

    rows = spark.createDataFrame([(1, "one two three four five six#ok#seven eight nine ten eleven. yes"), (2, "fail now. with this text as it is"), (3, None)], "k int, t string")
    got = segment.sentences(rows, "t", ["k"], tokenize=segment.tokenizer(make)).collect()
    assert [(r.k, r.idx, r.sentence) for r in sorted(got, key=lambda r: (r.k, r.idx))] == [
        (1, 0, "one two three four five six"), (1, 1, "ok"), (1, 2, "seven eight nine ten eleven. yes"), (2, 0, "fail now."), (2, 1, "with this text as it is"),
    ]


def test_manifests(spark, tmp_path):
    """Pairs looked up, cleaned and split; ids run from 1 in each split, in the order of the keys."""
    n = 1300
    text = lambda i: f"A sentence of number {i} stands here."
    rows = [(text(i), f"e{i}", [f"यह {i} एक!", f"और {i}"], [f"h{i}", f"k{i}"]) for i in range(n)]
    wide = spark.createDataFrame(rows, "English string, English_sentence_id string, Hindi array<string>, Hindi_sentence_ids array<string>")
    ids = [f"e{i}" for i in range(n)] + [f"h{i}" for i in range(n) if i % 13]
    audio = spark.createDataFrame([(i, f"/{i}.wav", [1, 2]) for i in ids], "sentence_id string, path string, units array<int>")
    similarity = spark.createDataFrame([(f"h{i}", i / n) for i in range(0, n, 2)] + [("h0", 0.9)], "sentence_id string, similarity double")
    cli.run_manifests(spark, wide, audio, similarity, str(tmp_path), ["Hindi"], ("parquet", "tsv"))
    kept = [i for i in range(n) if i % 13]
    parts = spark.read.parquet(f"{tmp_path}/Hindi-English/parquet")
    assert {r.split: r["count"] for r in parts.groupBy("split").count().collect()} == {"valid": len(kept) // 20, "test": 500, "train": len(kept) - 500 - len(kept) // 20}
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/Hindi-English/tsv").count() == len(kept)
    assert parts.where("split = 'valid'").agg(F.min("similarity")).first()[0] >= 0.85
    records = [json.loads(line) for p in (tmp_path / "Hindi-English-manifest").glob("*/split=train/part-*") for line in p.read_text().splitlines()]
    assert [r["source"]["id"] for r in records] == list(range(1, len(records) + 1)) and {r["source"]["lang"] for r in records} == {"hin"}
    one = records[0]
    i = one["target"]["audio_local_path"][2:-4]
    assert one["source"] == {"id": 1, "lang": "hin", "text": f"यह {i} एक", "audio_local_path": f"/h{i}.wav", "waveform": None, "sampling_rate": 16000, "units": [1, 2]} and one["target"]["text"] == text(i)


def test_merge_without_some_episodes(spark, tmp_path):
    for language, episode in (("Hindi", "a"), ("Hindi", "b"), ("Bodo", "b")):
        d = tmp_path / "in" / language / episode
        d.mkdir(parents=True)
        (d / "x.tsv").write_text(f"sentence_id\ttext\n{episode}1\tone\n")
    cli.run_merge_tsv(spark, f"{tmp_path}/in/*/*/*.tsv", str(tmp_path / "out"), "sentence_id string, text string", ["b"], ("parquet", "xlsx"))
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/parquet").select("sentence_id", "language").collect()] == [("a1", "Hindi")]
    assert list((tmp_path / "out/xlsx").glob("*.xlsx"))


def brute_sliding(english, words, first, second, k, least, override, gated):
    """Accepted spans and what is compared, sentence by sentence and span by span."""
    import numpy as np

    spans = [(s, s + w) for s in range(len(words)) for w in range(1, 26) if s + w <= len(words) and len(" ".join(words[s : s + w])) >= 3]
    unit = lambda encode, texts: (lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9))(encode(texts)).astype(np.float32).astype(float)
    texts = [" ".join(words[s:e]) for s, e in spans]
    a, b = unit(first, english) @ unit(first, texts).T, unit(second, english) @ unit(second, texts).T
    at, accepted, shown = 0, [], []
    for i in range(len(english)):
        short = sorted(range(len(spans)), key=lambda j: (-a[i, j], spans[j]))[:k]
        scored = sorted(((0.45 * a[i, j] + 0.55 * b[i, j], *spans[j]) for j in short), key=lambda x: (-x[0], x[1:]))
        fit = [x for x in scored if x[0] >= (least if not gated or x[1] >= at - 15 else override)]
        shown.append((i, *(fit or scored)[0][1:]))
        if fit:
            accepted.append((*fit[0], i))
            at = max(at, fit[0][2])
    kept = []
    for x in sorted(accepted, key=lambda x: (-x[0], x[3])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
            kept.append(x)
    return {(i, s, e) for _, s, e, i in kept}, shown


def test_sliding_against_brute_force(spark):
    import random

    from polyweave.operators.embed import embedder, hashing

    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 9))) + "."
    rows, want = [], {}
    for episode in ("MKB_1", "MKB_2"):
        english = [sentence() for _ in range(7)]
        rows.append(("English", episode, " ".join(english)))
        for language in ("Hindi", "Garo"):
            other = list(english)
            rng.shuffle(other)
            other = [" ".join(w if rng.random() < 0.8 else rng.choice(vocabulary) for w in s[:-1].split()) for s in other[: 5 + (language == "Garo")]]
            rows.append((language, episode, " ".join(f"{s}." for s in other)))
            low = language == "Garo"
            args = (75, 0.45, 0.75, True) if low else (25, 0.55, 1.0, False)
            want[episode, language] = brute_sliding(english, rows[-1][2].split(), hashing(128, (2, 3)), hashing(128, (3, 4)), *args)
    transcripts = spark.createDataFrame(rows, "language string, episode string, text string")
    first, second = (embedder(lambda o=o: hashing(128, o)) for o in ((2, 3), (3, 4)))
    sentences = build.sentence_table(transcripts)
    assert sentences.where("language = 'English'").count() == 14
    accepted, segments, compared = build.sliding(build.sides(sentences, first, second), transcripts, first, second, build.Options())
    words = {(r[1], r[0]): r[2].split() for r in rows}
    got = {k: set() for k in want}
    for r in accepted.collect():
        got[r.episode, r.language].add((r.i, r.text))
    for key, (kept, shown) in want.items():
        assert got[key] == {(i, " ".join(words[key][s:e])) for i, s, e in kept}, key
        mine = [r for r in compared.collect() if (r.episode, r.language) == key]
        assert {(r.i, r.text, r.aligned) for r in mine} == {(i, " ".join(words[key][s:e]), (i, s, e) in kept) for i, s, e in shown}
    assert sum(len(kept) for kept, _ in want.values()) > 10
    flags = set()
    for key in want:
        own = sorted((r for r in segments.collect() if (r.episode, r.language) == key), key=lambda r: r.seg_idx)
        assert " ".join(r.text for r in own).split() == words[key]
        flags |= {r.aligned for r in own}
    assert flags == {True, False}
