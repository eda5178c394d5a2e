import collections
import hashlib
import html.parser
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from polyweave.llm import embedding_dedup, language_id, license_rules, license_scan, line_dedup, media, ngram_jaccard, packing, quality, queries, source_mixing, substring_dedup
from polyweave.llm import textkit as T

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, doc int, n int, part int, cut int, k1 int, key int, taken int, score int, epochs int, s int, hub int"


def prose(seed, n, vocabulary=4000):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, blanks, repeats, near copies, shared passages, a long word and a long text, ids out of order."""
    base, shared, long = prose(1, 120), prose(2, 30), prose(3, 30_000)
    near = base.split()
    near[60] = "changed"
    grown = base.split()
    grown.insert(10, "more")
    texts = {
        9: base, 2: base, 5: " ".join(near), 7: " ".join(grown), 11: base.upper(), 3: None, 4: "", 6: " \n\t ", 8: "x" * 100_000, 10: long,
        12: long + "\n" + shared, 13: prose(4, 40) + " " + shared + " " + prose(5, 40), 14: prose(6, 40) + "\n" + shared + "\nOf.\n" + prose(7, 9),
        15: "a b c", 16: "A b c", 17: "a a " * 60, 18: "é!é ß 12,3 don't <|endoftext|> Ünïcode—dash naïve İ K", 19: "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0",
    }
    out = [(i, t, ["en", "de", None][i % 3], [None, "b", "a"][i % 3], 0) for i, t in texts.items()]
    out += [out[0], out[0], (None, base, None, None, None), (None, None, None, None, None)]
    return [(*r, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) for r in out]


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def key(i):
    return (1 << 63) - 1 if i is None else i


def tag(text):
    """Order of rows of one id: 63 bits of the hash of the text."""
    return (42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)) & ((1 << 63) - 1)


def distinct(rows):
    """The documents: rows of equal id and text are one."""
    return sorted({(key(i), tag(t), t) for i, t, *_ in rows}, key=lambda r: r[:2])


def brute_windows(rows, n=20):
    first, docs = {}, [((i, x), (t or "").encode().split()) for i, x, t in distinct(rows)]
    for i, w in docs:
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), (i, s))
    gone = collections.defaultdict(set)
    for i, w in docs:
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (i, s):
                gone[i].update(range(s, s + n))
    return {(i[0], len(w), len(gone[i]), b" ".join(x for k, x in enumerate(w) if k not in gone[i]).decode()) for i, w in docs}


#: Unique texts beside repeated ones under null and repeated ids.
TWICE = [(1, "base"), (None, "base"), (None, "other"), (7, "base"), (7, "third"), (7, "third"), (None, "other")]


def twice(spark, words):
    texts = {"base": prose(31, words), "other": prose(32, words), "third": prose(33, words)}
    return texts, spark.createDataFrame([(i, texts[t]) for i, t in TWICE], "doc_id long, text string").repartition(3)


def test_substring_dedup(spark, sf, documents, rows):
    for df, given in ((documents, rows), real(spark, sf)):
        got = substring_dedup.dedup_substrings(df, bits=20).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert len(got) == len(given)
        assert {(key(r[0]), *r[1:]) for r in got} == brute_windows(given)


def test_repeated_ids_are_documents_of_their_own(spark):
    texts, df = twice(spark, 40)
    want = collections.Counter((i, "" if t == "base" and i != 1 else texts[t]) for i, t in TWICE)
    got = substring_dedup.dedup_substrings(df, bits=18).collect()
    assert collections.Counter((r.doc_id, r.kept_text) for r in got) == want
    got = line_dedup.dedup_lines(df).collect()
    assert collections.Counter((r.doc_id, r.kept_text) for r in got) == want
    assert collections.Counter((r.doc_id, r.text) for r in line_dedup.rewrite(df).collect()) == collections.Counter({k: n for k, n in want.items() if k[1]})
    top = (1 << 63) - 1
    df = spark.createDataFrame([(top, texts["base"]), (None, texts["base"]), (None, texts["other"])], "doc_id long, text string")
    for got in (substring_dedup.dedup_substrings(df, bits=18), line_dedup.dedup_lines(df)):
        assert sorted((r.doc_id is None, r.n_removed > 0) for r in got.collect()) == [(False, False), (True, False), (True, True)]


def edit(x, y):
    """Whether one word more, less or else turns x into y, by trying each."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:c] + y[c + 1 :] == x for c in range(len(y)))


def brute_lines(rows, min_words=1, near_words=3):
    """(id, lines, lines removed, text left) of every document; entirely long lines are compared pair by pair."""
    seen, full, less, long, gone = {}, set(), set(), [], set()
    docs = distinct(rows)
    for i, x, t in docs:
        for k, line in enumerate((t or "").encode().split(b"\n")):
            w = tuple(line.translate(LOWER).split())
            if len(w) >= min_words and seen.setdefault(w, (i, x, k)) != (i, x, k):
                gone.add((i, x, k))
            if len(w) >= 1000:
                if any(edit(w, v) for v in long):
                    gone.add((i, x, k))
                long.append(w)
            elif len(w) >= near_words:
                cuts = [(w[:c] + w[c + 1 :], c) for c in range(len(w))]
                if (w, None) in less or any(v in less or v[0] in full for v in cuts):
                    gone.add((i, x, k))
                less.update(cuts, ((v, None) for v, _ in cuts))
                full.add(w)
    out = set()
    for i, x, t in docs:
        own = (t or "").split("\n")
        left = [s for k, s in enumerate(own) if (i, x, k) not in gone]
        out.add((i, len(own), len(own) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("min_words, near_words", [(1, 3), (1, 1), (3, 8)])
def test_line_dedup(spark, sf, documents, rows, min_words, near_words):
    short = [(50, "One.\na b c\nnew here"), (51, "one.\na b d\nalso new"), (52, "a c\na b c d\nnew here\nlast"), (53, "x y z u v w\nx y u v w\nx z u v\ntwo words"), (54, "two wards")]
    huge = prose(41, 1500).split()
    short += [(60, " ".join(huge)), (61, " ".join([*huge[:700], "other", *huge[701:]])), (62, " ".join([*huge[:30], "added", *huge[30:]])), (63, " ".join([*huge[:1400], *huge[1402:]]))]
    own = documents.select("doc_id", "text").union(spark.createDataFrame(short, "doc_id long, text string"))
    for df, given in ((own, [r[:2] for r in rows] + short), real(spark, sf))[: 2 if near_words == 3 else 1]:
        got = line_dedup.dedup_lines(df, min_words, near_words).select("doc_id", "n_lines", "n_removed", "kept_text").collect()
        assert len(got) == len(given)
        assert {(key(r[0]), *r[1:3], r[3] or "") for r in got} == brute_lines(given, min_words, near_words)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, 4, 3)


def test_line_dedup_of_a_large_family(spark):
    """Thousands of copies, and lines that differ from one line in a word each, over many batches."""
    line = prose(42, 12).split()
    rows = [(i, " ".join(line)) for i in range(3000)] + [(3000 + i, " ".join([*line[: i % 12], f"x{i}", *line[i % 12 + i % 2 :]])) for i in range(500)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), bits=18).collect()
    assert {r.doc_id for r in got if not r.n_removed} == {0} and len(got) == len(rows)


def brute_jaccard(rows):
    sets = {}
    for i, _, t in distinct(rows):
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i in sorted(sets):
        for y, k in collections.Counter(y for t in sets[i] for y in lists[t]).items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[y]) - k):
                a, b = sorted((root(i), root(y)))
                parent[b] = a
        for t in sets[i]:
            lists[t].append(i)
    return {(i, len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [2048, 3])
def test_ngram_jaccard(spark, sf, documents, rows, block, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    rng = np.random.default_rng(8)
    base, family = prose(9, 150).split(), []
    for i in range(60):  # a family around one text, some members linked only through others
        w = list(base)
        for p in rng.choice(150, rng.integers(0, 5), replace=False):
            w[p] = f"e{i}x{p}"
        family.append((100 + i, " ".join(w)))
    given = [(i, t) for i, t, *_ in rows] + family
    df = documents.select("doc_id", "text").union(spark.createDataFrame(family, "doc_id long, text string"))
    for df, given in ((df, given),) if block == 3 else ((df, given), real(spark, sf)):
        got = ngram_jaccard.jaccard_components(df, bits=20).collect()
        assert len(got) == len(given)
        want = {(i, n, c) for i, n, c in brute_jaccard(given) if i < 1 << 62}
        assert {tuple(r) for r in got if r.doc_id is not None} == want
    assert ngram_jaccard.keep_first(documents, bits=20).columns == documents.columns


def test_ngram_jaccard_of_repeated_ids(spark):
    """Texts under one id or none link only where their own words do; of each component one row stays."""
    a, b, c = (prose(k, 60) for k in (51, 52, 53))
    rows = [(None, a), (5, a), (None, b), (6, b + " more"), (9, c), (9, a + " end"), (None, c), (None, None), (None, " "), (None, a), (5, a), (None, "x y z"), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {a: 5, b: 6, c: 9}
    got = ngram_jaccard.jaccard_components(df, bits=18).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == collections.Counter((i, next((n for s, n in want.items() if (t or "").startswith(s)), None)) for i, t in rows)
    kept = collections.Counter((r.doc_id, r.text) for r in ngram_jaccard.keep_first(df, bits=18).collect())
    assert kept == collections.Counter([(5, a), (6, b + " more"), (9, c), (None, None), (None, " "), (None, "x y z")])


def test_packing(spark, documents, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path)
    ids = {t: encode.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows}
    got = packing.pack(documents, path, length=512).collect()
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, struct.unpack(f"<{r.length}I", bytes(r.ids)), r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    want = collections.Counter((i, len(ids[t])) for i, t, *_ in rows)
    assert sum(r.length for r in got) == sum(n * c for (_, n), c in want.items())
    for i, t, *_ in rows:
        own = [p for p in pieces[i] if p[2] == len(ids[t])]
        assert all(tuple(ids[t][a : a + len(x)]) == x for a, x, _ in own)
        assert {k for a, x, _ in own for k in range(a, a + len(x))} == set(range(len(ids[t])))
    sizes = []
    for s in sorted(places):
        at = 0
        for a, n in sorted(places[s]):
            assert a == at
            at += n
        sizes.append(at)
    assert sorted(places) == list(range(len(sizes))) and set(sizes[:-1]) <= {512} and 0 < sizes[-1] <= 512

    for weights in (None, {"a": 3.0, "b": 1.0}):  # windows against all ids sorted by when they are due
        got = packing.pack(documents, path, 512, weights=weights, rest=2.0).collect()
        queue = {s: k for k, s in enumerate(["a", "b", None])}
        source = collections.defaultdict(set)
        for r in rows:
            source[r[0], len(ids[r[1]])].add(r[3])
        assert all(len(x) == 1 for x in source.values())
        held = collections.Counter()
        for r in got:
            held[r.sequence_id, queue[min(source[r.doc_id, r.doc_tokens], key=str)]] += r.length
        totals = [sum(n for (_, q), n in held.items() if q == k) for k in range(3)]
        each = totals if weights is None else [3, 1, 2]
        order = sorted(((k + 1) / w, q) for q, (n, w) in enumerate(zip(totals, each)) for k in range(n))
        assert held == collections.Counter((at // 512, q) for at, (_, q) in enumerate(order))
    some = packing.pack(documents, path, 512, queues=1).groupBy().sum("length").first()[0]
    assert some == sum(r.length for r in got)
    with pytest.raises(ValueError):
        packing.pack(documents, path, weights={"a": 0.0})


@pytest.mark.parametrize("totals, weights", [([70_000, 3, 0, 911], None), ([5000, 3, 0, 911], [1, 5, 1, 2]), ([0, 0], None), ([7], None)])
def test_quotas(totals, weights):
    """Windows take what stands in them when all ids are sorted by when they are due."""
    weights = weights or [max(n, 1) for n in totals]
    q = packing.Quotas(totals, weights, 64)
    order = sorted(((k + 1) / w, i) for i, (n, w) in enumerate(zip(totals, weights)) for k in range(n))
    want = np.zeros((len(order) // 64 + 3, len(totals)), np.int64)
    for at, (_, i) in enumerate(order):
        want[at // 64 + 1 :, i] += 1
    assert (q.upto(np.arange(len(want))) == want).all()
    for i, n in enumerate(totals):
        for place in range(0, n, 7):
            w = int(np.searchsorted(want[:, i], place, side="right")) - 1
            assert {w, w + 1} <= set(q.around(np.array([i]), np.array([place]), np.array([place + 1])).tolist())


def test_rare_source_costs_its_own_ids():
    q = packing.Quotas([2_000_000_000_000, 100], [2_000_000_000_000, 100], 4096)
    windows = q.around(np.array([1]), np.array([0]), np.array([100]))
    assert len(windows) <= 600 and windows[-1] - windows[0] > 10**8
    doc, lo, length, window, offset = packing._places(q, np.array([1, 0]), np.array([0, 10**11]), np.array([100, 9000]))
    assert doc.tolist() == [0] * 100 + [1] * (len(doc) - 100) and lo.tolist()[:100] == list(range(100)) and set(length[:100].tolist()) == {1}
    assert (np.diff(window[:100]) > 10**6).all() and set(offset[:99].tolist()) == {4095} and int(length[100:].sum()) == 9000


def test_mixing(spark, sf, documents, rows):
    got = source_mixing.mix(documents).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(target[s] - 4 < taken[s] <= target[s] for s in target) and abs(sum(target.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    docs = source_mixing.taken_rows(source_mixing.mix(documents), documents.columns)
    assert sum(len((r.text or "").encode().split()) for r in docs.collect()) == sum(taken.values())


def test_mixing_against_sql(spark, sf, tmp_path):
    """The query's rows are those of SQL over the documents and their scores."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    quality.score(docs, quality.fit(docs, labels)).write.parquet(f"{tmp_path}/scored")
    con = duckdb.connect()
    con.execute(f"create view scored as select * from '{tmp_path}/scored/*.parquet'")
    df = source_mixing.query(spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"select {', '.join(df.columns)} from ({source_mixing.ORACLE})").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.sql(f"select {columns} from ({queries.ORACLES[name]})").fetchall()))


def test_license_scan(spark, documents, rows):
    got = license_scan.summary(license_scan.scan(documents)).collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and found[3].n_words == 0 and found[3].labels == "" and found[3].first_word is None
    assert tuple(found[19])[1:7] == (13, 1, 8, 8, "cc-by", "apache-2.0,cc-by,cc-by-nc-4.0")
    texts = [(1, "cc by " * 3000), (2, "CC-BY cc\nby CC_BY ccby All RIGHTS reserved."), (3, "permission is hereby granted free of charge to any person obtaining a copy")]
    found = {r.doc_id: r for r in license_scan.summary(license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word) == (3000, 0, 5998)
    assert (found[2].n_base, found[2].base_labels, found[2].last_word) == (4, "cc-by,reserved", 7) and found[3].labels == "mit"
    assert not any(" " in t for t in license_rules.TRIGGERS)
    for r in license_rules.rules():
        plain, old = r["pattern"].replace("[cs]", "s"), None
        while plain != old:  # what any match has: neither optional parts nor one of several
            old, plain = plain, re.sub(r"\([^()]*\)\?|[a-z]\?", "", plain)
        choices = [c for part in re.findall(r"\(([^()]*\|[^()]*)\)", plain) if "$" not in part for c in [part.split("|")]]
        plain = re.sub(r"\([^()]*\|[^()]*\)", "#", plain)
        has = lambda x: any(t in x for t in license_rules.TRIGGERS)
        assert has(plain) or plain.startswith("^cc by") or any(all(map(has, c)) for c in choices), r
        assert re.match(r"\^\(?[a-z|]*" + r["keyword"][:-1], r["pattern"])


@pytest.mark.parametrize("text, label", [
    ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software", "mit"),
    ("Neither the name of the Example Corp. nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("under the GNU GPL; either version 3 of the License, or\n(at your option) any later version.", "gpl-3.0-or-later"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("GNU General Public License v2.0 only, with the Classpath Exception", "classpath-exception"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa-4.0"),
    ("Altered source versions must be plainly\nmarked as such", "zlib"), ("The Software shall be used for Good, not Evil.", "json"),
    ("Reproduction in whole or in part without written permission", "proprietary"), ("for non-commercial use only", "non-commercial"),
    ("LLAMA 3.1 Community License Agreement", "llama"), ("Redistributions of any form whatsoever must retain the following acknowledgment", "openssl"),
])
def test_license_notices(spark, text, label):
    row = license_scan.summary(license_scan.scan(spark.createDataFrame([(1, f"Some words before.\n{text}\nand after")], "doc_id long, text string"))).first()
    assert label in row.labels.split(",")


def test_language_id(spark, sf, documents, rows):
    df, _ = real(spark, sf)
    model = language_id.fit(df, per_language=100, landmarks=64)
    truth = {r.doc_id: r.lang for r in df.collect()}
    got = language_id.predict(df, model).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    edge = {r.doc_id: r for r in language_id.predict(documents, model).collect()}
    assert {i for i, r in edge.items() if r.lang_pred == "und"} >= {3, 4, 6} and all(0 <= r.score <= 1 for r in edge.values())
    assert edge[9].score == edge[2].score and edge[2].held_out == (zlib.crc32(b"2") % 5 == 0)
    few = language_id.fit(df, per_language=50, languages=2)
    assert len(few.names) == 2 and len(language_id.fit(df, sampled=8).marks) == 8
    none = language_id.fit(df.where("false"))
    assert none is None and {r.lang_pred for r in language_id.predict(documents, none).collect()} == {"und"}


def grams(text, buckets):
    """Buckets of a text's n-grams of letters, one by one."""
    low = bytes(b if b >= 0x80 else b | 0x20 if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in text.encode())
    for k in (1, 2, 3, 4):
        for i in range(len(low) - k + 1):
            code = int.from_bytes(low[i : i + k], "big")
            code = ((code ^ (k * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1 & 0xFFFFFFFF) ^ (code >> 15)
            yield (code * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - (buckets.bit_length() - 1))


def test_language_scores_by_brute_force(spark, sf):
    """Scores from sets of n-grams, kernel by kernel."""
    df, given = real(spark, sf)
    model = language_id.fit(df, per_language=40, landmarks=16)
    marks = [set(np.flatnonzero(m).tolist()) for m in model.marks]
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    for i, t in given[:40]:
        if not any(c.isalpha() for c in t or ""):
            continue
        own = set(grams(t, 1 << 14))
        kernel = np.array([len(own & m) / (len(own) * len(m)) ** 0.5 for m in marks])
        value = np.exp(4 * (kernel @ model.weights + model.bias))
        assert got[i].lang_pred == model.names[int(value.argmax())] and abs(got[i].score - value.max() / value.sum()) < 1e-4


def test_quality_scores_by_brute_force(spark, sf):
    """Scores as the mean over features taken one by one."""
    df, given = real(spark, sf)
    model = quality.fit(df, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    space = b" \t\n\x0b\x0c\r"
    for i, t in sorted(given, key=lambda r: len(r[1] or ""))[:60]:
        raw = (t or "").encode()
        words = [int(T.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in raw.split()]
        found = [w >> 49 for w in words]
        found += [2 * quality.BUCKETS + (int(T.mix64(np.array([(b - a) % 2**64], np.uint64))[0]) >> 49) for a, b in zip(words, words[1:])]
        for k in (3, 4):
            for at in range(len(raw) - k + 1):
                if not any(b in space for b in raw[at + 1 : at + k - 1]):
                    code = int.from_bytes(bytes(0x20 if b in space else b for b in raw[at : at + k]), "big")
                    code = ((code ^ (code >> 13)) * (0x9E3779B1 + 2 * k) & 0xFFFFFFFF) ^ (code >> 7)
                    found.append((code * 0x85EBCA6B & 0xFFFFFFFF) >> 17 | quality.BUCKETS)
        value = sum(model.table[f] for f in found) / max(len(found), 1) + model.bias
        assert abs(got[i] - 1 / (1 + np.exp(-value))) < 1e-9


def test_quality(spark, documents, rows):
    sf = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(df, labels)
    got = {r.doc_id: r for r in quality.score(df.select("doc_id", "text"), model).collect()}
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    edge = quality.score(documents, model)
    assert edge.columns == [c for c in documents.columns if c != "score"] + ["score", "predicted"]
    found = edge.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert {r.predicted for r in quality.score(documents, quality.fit(df, labels.where("false"))).collect()} == {1}


def digest(items):
    return hashlib.sha256("\x1e".join("\x1f".join((kind, text or "", caption or "")) for kind, text, caption in items).encode()).hexdigest()


def brute_feature(image):
    bands = [float(x.mean()) for x in np.array_split(image, 4)]
    tiles = np.array([[x.mean() for x in np.array_split(rows, 8, axis=1)] for rows in np.array_split(image, 8)])
    bits = int("".join("1" if x else "0" for x in (tiles > tiles.mean()).ravel()), 2)
    return f"{image.shape[1]}x{image.shape[0]};mean={image.mean():.4f};std={image.std():.4f};bands={','.join(f'{x:.3f}' for x in bands)};hash={bits:016x}"


def test_media(spark, documents, rows, tmp_path):
    """All that the query returns, against the texts alone."""
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        data = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        first, *rest = [" ".join(x.split()) for x in (t or "").split("\n")]
        caption = f"Payload of document {'without id' if i is None else i}"
        items = [("text", first, None)] * bool(first) + [("img", f"media:{hashlib.sha256(data).hexdigest()}", caption)] + [("text", x, None) for x in rest if x]
        image = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        want[
            i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(),
            brute_feature(image), int(bool(first)), caption, len(items), digest(items),
        ] += 1
    assert collections.Counter(map(tuple, media.query(spark, str(tmp_path)).collect())) == want


class Reader(html.parser.HTMLParser):
    """Text and media of a page, by the parser of the standard library."""

    BLOCKS = "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split()

    def __init__(self, page):
        super().__init__()
        self.items, self.held, self.hidden = [], "", False
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join(self.held.split()):
            self.items.append(("text", text, None))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        self.hidden |= tag in ("script", "style")
        assert tag not in ("img", "video", "audio", "source", "embed")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.hidden &= tag not in ("script", "style")

    def handle_data(self, data):
        self.held += "" if self.hidden else data


def test_page_sequences(spark, sf):
    given = {r.page_id: Reader(r.html).items for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.n_items, r.n_media, r.items_sha256) for r in media.pages_query(spark, sf).collect()}
    assert got == {i: (len(x), 0, digest(x)) for i, x in given.items()} and sum(len(x) for x in given.values()) > 100


def test_parse():
    page = '<p>One &amp; <b>two</b><!-- <img src=x> --><script>"<img src=y>"</script><figure><img src="media:d1" alt="a"><img src=u.png><figcaption>The <i>cap</i></figcaption></figure>tail<img alt="only" src=\'v.png\'><p>'
    items = media.parse(page)
    assert [(i["pos"], i["kind"], i.get("text") or i["address"], i.get("caption")) for i in items] == [
        (0, "text", "One & two", None), (1, "img", "media:d1", "The cap"), (2, "img", "u.png", "The cap"), (3, "text", "tail", None), (4, "img", "v.png", "only"),
    ]
    assert items[1]["digest"] == "d1" and media.parse(None) == [] and media.parse("<img <p") == [{"pos": 0, "kind": "text", "text": "<img <p"}]


@pytest.mark.parametrize("cell", [2048, 40])
def test_embeddings(spark, cell, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50 if cell == 40 else 8192)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * (0.12 if i % 3 else 3)).tolist(), i % 2) for i in range(400)]
    rows += [(1000 + i, rows[1][1], 1) for i in range(50)] + [(2000, rows[1][1], None)]
    rows += [(2001, None, 1), (2002, [0.0] * 16, 1), (2003, [None] * 16, 1), (2004, [float("nan")] * 16, 1), (2005, [], 1), (2006, [float("inf")] * 16, 1), (None, rows[1][1], 1), (2007, [1.0, 2.0], 1)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    ok = [r for r in rows if r[0] is not None and r[0] < 2000]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, ids = np.array([r[2] for r in ok]), np.array([r[0] for r in ok])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    comp, old = ids.copy(), None
    while old is None or (old != comp).any():
        old, comp = comp, np.array([comp[n].min() for n in near])
    want = {int(i): (int(n.sum()) - 1, int(c), bool(c == i)) for i, n, c in zip(ids, near, comp)}
    assert near.sum() > 3000
    want |= {i: (0, i, True) for i in range(2000, 2008)}
    assert {r.vec_id: tuple(r)[1:] for r in got if r.vec_id is not None} == want and len(got) == len(rows)


def test_embeddings_of_repeated_ids_and_any_size(spark):
    """Every row has its own vector's links; squares of components may over- or underflow."""
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (1, [0.0, 2.0], "a"), (3, [1e200, 1e190], "a"), (4, [1e-300, 0.0], "a"), (1, [1.0, 0.0], "a"), (9, [-1e308, 0.0], "b"), (8, [-5e-324, 0.0], "b"), (9, [1.0, 1.0], "b")]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)).collect()
    want = [(1, 3, 1), (1, 3, 1), (3, 3, 1), (4, 3, 1), (1, 1, 1), (2, 1, 1), (8, 1, 8), (9, 1, 8), (9, 0, 9)]
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == collections.Counter(want) and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embeddings_of_rescaled_copies(spark, monkeypatch):
    """Pivots that differ in the last bits only: copies of one vector by FLOAT factors, and vectors at the edge of the radius around them."""
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    rng = np.random.default_rng(16)
    base = rng.normal(size=16)
    base /= np.linalg.norm(base)
    vectors = [(base * s).astype(np.float32) for s in rng.uniform(0.5, 2, 400)]
    for angle in np.arccos(0.98) + rng.uniform(-0.02, 0.02, 300):
        side = rng.normal(size=16)
        side -= (side @ base) * base
        vectors.append((np.cos(angle) * base + np.sin(angle) * side / np.linalg.norm(side)).astype(np.float32))
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    unclear = np.abs(near - 0.98) < 1e-12
    assert not unclear.any() and len(np.unique(x, axis=0)) > 500
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: int(n) - 1 for i, n in enumerate((near >= 0.98).sum(axis=1))}


def test_line_dedup_removes_repeats_only(spark, tmp_path):
    """Lines that occur nowhere earlier stay, whatever else their document loses."""
    footer = "all rights of this page are reserved"
    rows = [(1, "first\n" + footer), (2, "oak\nelm tree\n\n" + footer), (3, "\n" + footer + "\n "), (4, footer), (5, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {1: rows[0][1], 2: "oak\nelm tree\n", 3: "\n ", 4: "", 5: ""}
    want = {(i, len((t or "").split("\n")), int(i in (2, 3, 4)), hashlib.sha256(kept[i].encode()).hexdigest()) for i, t in rows}
    assert {tuple(r) for r in line_dedup.query(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in line_dedup.rewrite(made, bits=20).collect()} == {1: kept[1], 2: kept[2], 5: None}


def test_mixture_holds_entire_texts(spark):
    """No text of the mix is cut, and a source misses its target by half the document at its cut at most."""
    rows = [(i, "\n".join(prose(100 * i + k, 5 + i) for k in range(1 + i % 4)), "ab"[i % 2], i) for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string, tag int").repartition(3)
    got = source_mixing.mixture(made)
    assert got.columns == made.columns
    got = got.collect()
    assert {tuple(r) for r in got} <= set(rows)
    target = {r.source: r.target for r in source_mixing.mix(made).collect()}
    for s in "ab":
        taken = sum(len(r.text.split()) for r in got if r.source == s)
        assert abs(taken - target[s]) <= max(len(t.split()) for _, t, x, _ in rows if x == s) / 2 + 1
    one = spark.createDataFrame([(1, prose(1, 99), "a"), (2, "few words", "b")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.taken) for r in source_mixing.mix(one, entire=True).collect()} <= {(1, 99, 0), (1, 99, 99), (1, 99, 198), (2, 2, 2), (2, 2, 4)}


def test_packing_of_more_words_than_kept(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "KEEP", 8)
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("one two three", "one two three " + " ".join(f"word{chr(97 + i)}" for i in range(20)), "three more", "", prose(3, 50)):
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, rows = words.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids and rows.tolist() == [0, len(ids)]


def test_empty_tables(spark, documents):
    import public_tokenizers

    none = documents.where("false")
    for df in (
        substring_dedup.dedup_substrings(none, bits=18), line_dedup.dedup_lines(none), ngram_jaccard.jaccard_components(none, bits=18), source_mixing.mix(none),
        license_scan.summary(license_scan.scan(none)), media.references(media.sequences(media.document_pages(none), "doc_id", ("n_bytes",))),
        embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")), packing.pack_query(none),
    ):
        assert df.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.score(none, quality.fit(none, labels))
    pages = media.sequences(spark.createDataFrame([], "page_id long, html string"))
    for df in (
        scored, quality.keep_good(none, quality.fit(none, labels)), language_id.predict(none, language_id.fit(none)), media.decoded(media.store(none.select(media.stored(media.payload("text")).alias("data")))),
        media.resolve(media.references(pages), media.decoded(media.store(none.select(media.stored(media.payload("text")).alias("data"))))), line_dedup.rewrite(none), ngram_jaccard.keep_first(none, bits=18),
        source_mixing.mixture(none, quality.fit(none, labels)), packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), weights={"a": 1.0}),
    ):
        assert df.count() == 0


def _landed(monkeypatch, module, name: str) -> list:
    """The tables of this name that ``module`` lands from now on."""
    seen, land = [], module.land
    monkeypatch.setattr(module, "land", lambda df, n: (t := land(df, n), seen.append(t) if n == name else None)[0])
    return seen


def _unlike(n: int, words: int) -> list[str]:
    """Texts of words that occur nowhere else."""
    return [" ".join(f"w{i}x{k}" for k in range(words)) for i in range(n)]


def test_more_lines_than_the_sketch_has_cells(spark, monkeypatch):
    lines = _unlike(60_000, 8)
    texts = ["\n".join(lines[i : i + 20]) for i in range(0, len(lines), 20)] + [lines[7], lines[9].replace("x3", "y3")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = _landed(monkeypatch, line_dedup, "lines")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df, bits=16).collect()}
    assert {i: n for i, n in got.items() if n} == {3000: 1, 3001: 1} and len(got) == len(texts)
    assert seen[0].count() < 600


def test_more_shingles_than_the_sketch_has_cells(spark, monkeypatch):
    texts = _unlike(5000, 60)
    texts += [texts[11], texts[12].replace("x59", "y59")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = _landed(monkeypatch, ngram_jaccard, "sets")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(df, bits=16).collect()}
    assert {i: c for i, c in got.items() if i != c} == {5000: 11, 5001: 12} and len(got) == len(texts)
    assert seen[0].where("toks is not null").count() < 50
