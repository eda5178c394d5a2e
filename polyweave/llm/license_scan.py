"""License scan: ordered signature rules over whole texts, in DataFrame expressions only.

A text's words are runs of letters, digits and bytes from 0x80 on, A-Z
lower-cased, numbered from 0. The rules are in ``license_rules``.

Method: a text that holds none of the rules' trigger strings has no detection
and is not split. In the others, each word that is some rule's keyword opens a
span of ``SPAN`` words, and the rules of this keyword are matched at its start.
Detections, ordered by start, longest first, are suppressed when an earlier one
of the same or better priority contains them; as no match is longer than the
span, only detections that start within a span before can. Detections of the
base phrases are always kept. Everything happens within a row: no shuffle, no
join, no Python.

Defined results: a null or empty text has no words, empty label strings, null
first and last word and score 0; rows that repeat an id are scanned each; other
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyweave.llm import license_rules as R

#: Words that a rule can look at from its keyword on.
SPAN = 40

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "struct<priority:int,label:string,pattern:string,weight:double,base:boolean,id:int>"


def _rules_by_keyword() -> tuple[Column, list[str], int]:
    """Constant map from keyword to its rules, the keywords, and the most rules that one keyword has."""
    table: dict[str, list[dict]] = {}
    for r in R.rules():
        table.setdefault(r["keyword"], []).append({k: v for k, v in r.items() if k != "keyword"})
    return F.from_json(F.lit(json.dumps(table)), f"map<string,array<{_RULE}>>"), sorted(table), max(map(len, table.values()))


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, detections) for each row of ``documents(doc_id, text)``.

    A detection is (start, stop, priority, label, weight, base, kept), stop exclusive, by place.
    """
    rules, keywords, most = _rules_by_keyword()
    low = F.lower("text")
    trigger = low.contains(R.TRIGGERS[0])
    for t in R.TRIGGERS[1:]:
        trigger = trigger | low.contains(t)
    trigger = trigger | (low.contains("cc") & low.rlike(r"(^|[\x00-\x2F\x3A-\x60\x7B-\x7F])cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))
    some = F.filter(F.split(F.translate("text", _UPPER, _LOWER), _BREAK), lambda w: w != "")
    rows = documents.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.when(trigger, some).alias("words"))

    def hit(w: Column, i: Column) -> Column:
        return F.when(w.isin(keywords), F.struct(i.alias("i"), w.alias("w"), F.array_join(F.slice("words", i + 1, SPAN), " ").alias("span")))

    hits = F.filter(F.transform("words", hit), lambda h: h.isNotNull())
    rows = rows.select("doc_id", "n_words", F.coalesce(hits, F.array().cast("array<struct<i:int,w:string,span:string>>")).alias("hits"))

    def detect(h: Column) -> Column:
        def one(r: Column) -> Column:
            found = F.rtrim(F.call_function("regexp_extract", h["span"], r["pattern"], F.lit(0)))
            n = F.when(found == "", 0).otherwise(F.length(found) - F.length(F.replace(found, F.lit(" "), F.lit(""))) + 1)
            return F.struct(
                h["i"].cast("long").alias("start"), (-(h["i"] + n)).cast("long").alias("end"), r["priority"].alias("priority"),
                r["id"].alias("id"), r["label"].alias("label"), r["weight"].alias("weight"), r["base"].alias("base"),
            )

        return F.filter(F.transform(rules[h["w"]], one), lambda d: -d["end"] > d["start"])

    rows = rows.select("doc_id", "n_words", F.array_sort(F.flatten(F.transform("hits", detect))).alias("found"))
    reach = SPAN * most

    def judge(d: Column, k: Column) -> Column:
        before = F.slice("found", F.greatest(k - reach, F.lit(0)) + 1, F.least(k, F.lit(reach)))
        inside = F.exists(before, lambda e: (e["end"] <= d["end"]) & (e["priority"] <= d["priority"]))
        return F.struct(
            d["start"].alias("start"), (-d["end"]).alias("stop"), d["priority"].alias("priority"), d["label"].alias("label"),
            d["weight"].alias("weight"), d["base"].alias("base"), (d["base"] | ~inside).alias("kept"),
        )

    return rows.select("doc_id", "n_words", F.transform("found", judge).alias("detections"))


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, places and labels per document."""
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: d["kept"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    starts = F.transform("base", lambda d: d["start"])
    rows = scanned.select("doc_id", "n_words", base.alias("base"), kept.alias("kept"))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"), names("kept").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Licenses in every document."""
    return summary(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = (f"({r['id']}, {r['priority']}, {quote(r['label'])}, {quote(r['keyword'])}, {quote(r['pattern'])}, {r['weight']}::double, {str(r['base']).lower()})" for r in R.rules())
    return ", ".join(rows)


ORACLE = rf"""
with rules(id, priority, label, keyword, pattern, weight, base) as (values {_values()}),
texts as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as words from documents
), hits as (
    select doc_id, i - 1 as i, words[i] as w, array_to_string(words[i:i + {SPAN - 1}], ' ') as span
    from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from texts) where words[i] in (select keyword from rules)
), found as (
    select h.doc_id, h.i as start, h.i + len(string_split(rtrim(regexp_extract(h.span, r.pattern)), ' ')) as stop, r.*
    from hits h join rules r on h.w = r.keyword where regexp_extract(h.span, r.pattern) <> ''
), judged as (
    select *, max(stop) filter (priority = 1) over earlier as m1, max(stop) filter (priority <= 2) over earlier as m2, max(stop) over earlier as m3
    from found window earlier as (partition by doc_id order by start, stop desc, priority, id rows between unbounded preceding and 1 preceding)
), kept as (
    select *, base or coalesce(case priority when 1 then m1 when 2 then m2 else m3 end, 0) < stop as keep from judged
), sums as (
    select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
        array_to_string(list_sort(list_distinct(list(label) filter (base))), ',') as base_labels,
        array_to_string(list_sort(list_distinct(list(label) filter (keep))), ',') as labels, max(weight) filter (keep) as score
    from kept group by doc_id
)
select t.doc_id, len(t.words)::bigint as n_words, coalesce(s.n_base, 0)::bigint as n_base, s.first_word::bigint as first_word, s.last_word::bigint as last_word,
    coalesce(s.base_labels, '') as base_labels, coalesce(s.labels, '') as labels, coalesce(s.score, 0.0)::double as score
from texts t left join sums s on t.doc_id = s.doc_id
"""
