import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyweave.functions import text as T
from polyweave.operators import segment
from polyweave.shipping import ship


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize("given, want", [(" a 　b\t\r\nc ", "a b c"), ("", ""), (None, None)])
def test_collapse_space(spark, given, want):
    assert one(spark, given, T.collapse_space) == want


def test_normalize_branches(spark):
    assert one(spark, "“x” — …​ ९²", lambda c: T.normalize(c, "eng")) == '"x" - ... 92'
    assert one(spark, "أَةـى", lambda c: T.normalize(c, "urd-script_arabic")) == "اهي"
    assert one(spark, "ड़ चाँद", lambda c: T.normalize(c, "hin")) == "ड चांद"
    assert one(spark, "\u09be কা", lambda c: T.normalize(c, "ben")) == "কা"


def test_sentence_id_is_pure(spark):
    rows = spark.createDataFrame([("a  b",), ("a b ",)], "t string")
    got = {r[0] for r in rows.select(T.sentence_id(F.lit("My Lang"), F.lit("ep 1"), T.collapse_space(F.col("t")))).collect()}
    assert got == {"ep_1_My_Lang_" + hashlib.sha1(b"My Lang|ep 1|a b").hexdigest()[:16]}


def test_cleaners(spark):
    assert one(spark, "Yes. This is a long enough sentence here. Ok.", T.drop_weak_leading) == "This is a long enough sentence here. Ok."
    assert one(spark, "Yes. No.", T.drop_weak_leading) == "Yes. No."
    assert one(spark, "Done now. left over", T.drop_fragments) == "Done now."
    assert one(spark, "left over", T.drop_fragments) == "left over"
    assert one(spark, "a,b\tc १! é", T.keep_letters) == "abc १ é"
    assert one(spark, "[1, 2]", T.parse_units) == [1, 2] and one(spark, "x", T.parse_units) is None
    assert one(spark, None, T.tsv_field) == "" and one(spark, "a\t\nb", T.tsv_field) == "a b"
    assert one(spark, "MKB_59_x", T.episode_number) == 59.0 and one(spark, "x", T.episode_number) == float("inf")


def test_split(spark):
    parts = one(spark, "One two three four five six. 3.14! ok. A much longer sentence stands here", segment.pieces)
    assert parts == ["One two three four five six.", "3.", "14! ok.", "A much longer sentence stands here"]
    got = one(spark, "Hm. One two three four five six. ok. no. And a much longer sentence here", lambda c: segment.buffered(segment.pieces(c), 5, 3))
    assert got == ["Hm.", "One two three four five six. ok. no.", "And a much longer sentence here"]
    assert one(spark, "a. b", lambda c: segment.buffered(segment.pieces(c), 5, 3)) == ["a. b"]
    assert one(spark, "… — ab. abc", lambda c: segment.strict(segment.pieces(c), 0, 3)) == ["ab.", "abc"]


def test_spans(spark):
    rows = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 3, 26)], "k int, t string")
    got = {r.k: r.n for r in segment.spans(rows, "t", ["k"]).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {3: 3, 26: sum(26 - w + 1 for w in range(1, 26)) - 10}  # less the words of two characters
    twice = segment.spans(rows.where("k = 26"), "t", ["k"], duplicates=True).count()
    assert twice == got[26] + sum(26 - w + 1 for w in (4, 6, 10, 18))
    mixed = spark.createDataFrame([(1, "কখগ কxখ abc কখগ")], "k int, t string")
    assert {r.span for r in segment.spans(mixed, "t", ["k"], script="Beng").collect()} == {"কখগ", "abc", "abc কখগ"}


def test_has_words(spark):
    texts = ["", " ", "a", " a　b ", "a b c", "a\n b\t c d"]
    for n in (0, 1, 3, 65):
        rows = spark.createDataFrame([(t,) for t in texts], "t string")
        assert all(r[0] == r[1] for r in rows.select(T.has_words(F.col("t"), n), F.size(T.words(F.col("t"))) >= n).collect())


def test_pieces_at_odd_ends(spark):
    assert one(spark, "　 a b  .\u0085\n\n ‼ c\n  d\u0085", segment.pieces) == ["a b  .", "‼", "c", "d"]
    assert one(spark, " \n ", segment.pieces) == [] and one(spark, "", segment.pieces) == [] and one(spark, None, segment.pieces) is None


def test_batches_for_python_are_bounded(spark):
    """Texts reach Python workers in batches of a bound in bytes, however many rows there are."""
    own = spark.newSession()
    ship(own)
    rows = own.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    size = F.arrow_udf("int")(lambda t: pa.array([len(t)] * len(t), pa.int32()))
    assert max(r[0] for r in rows.select(size("t")).collect()) <= 9
    odd = own.createDataFrame([("é",), (None,), ("क़",)], "t string")
    assert [r[0] for r in odd.select(T.nfc("t")).collect()] == ["é", None, "क़"]


def test_span_sums_are_those_of_spans(spark):
    texts = ["", "a", "ab", "a b", " ab c  def", "é" * 3, " ".join(f"w{i % 7}" for i in range(600)), "x " * 30, "aa b a"]
    rows = spark.createDataFrame([(n % 8, t) for n, t in enumerate(texts)] + [(9, None)], "k int, t string")
    made = segment.spans(rows, "t", ["k"]).groupBy("k").agg(F.count("*"), F.sum("chars"), F.min("span"))
    sums = segment.span_sums(rows, "t", ["k"])
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, made.collect()))
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1  # chunks only: no row per span reaches a group
    many = segment.span_sums(rows, "t", ["k"], min_chars=9)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, segment.spans(rows, "t", ["k"], min_chars=9).groupBy("k").agg(F.count("*"), F.sum("chars"), F.min("span")).collect()))
