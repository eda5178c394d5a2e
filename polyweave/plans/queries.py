"""Queries that apply the corpus operators to whole tables, with their DuckDB counterparts.

``documents`` stands for transcripts (lang, source: language, episode), even and
odd ``embeddings`` for the two sides of a block (label), ``conversations`` for
ordered utterances (role: language), ``labels`` for a partial right side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyweave import log
from polyweave.functions import fixed as X
from polyweave.functions import text as T
from polyweave.functions import vectors as V
from polyweave.operators import align, corpus, manifest, segment, similarity
from polyweave.plans import build
from polyweave.shipping import ship

QUERIES, ORACLES = {}, {}
BLOCK = ["label"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f"q_{f.__name__}"] = f
        if oracle:
            ORACLES[f"q_{f.__name__}"] = oracle
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf}/embeddings.parquet").where("label is not null")
    left = e.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    return left, e.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("j"), F.col("embedding").alias("v"))


def ranked(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return similarity.ranked(*sides(spark, sf), BLOCK, k)


_WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PLAIN = "replace(translate(regexp_replace(text, '[​-‍﻿]', '', 'g'), '“”‘’—–•·ـ', '\"\"''''--..'), '…', '...')"
_SCORED = """scored as (select a.label, a.vec_id as i, b.vec_id as j, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as sim
  from embeddings a join embeddings b on a.label = b.label and a.vec_id % 2 = 0 and b.vec_id % 2 = 1)"""
_RANKED = _SCORED + """, ranked as (select *, row_number() over (partition by label, i order by sim desc, j) as f,
  row_number() over (partition by label, j order by sim desc, i) as b from scored)"""
_WORDS = "list_filter(string_split_regex(trim({}), '\\s+'), lambda w: w <> '')"


@query(f"select doc_id, {_WS.format(_PLAIN)} as text_norm from documents")
def ws_normalize(spark, sf):
    """Zero-width characters, punctuation and white space."""
    return docs(spark, sf).select("doc_id", T.collapse_space(T.map_punctuation(T.strip_zero_width(F.col("text")))).alias("text_norm"))


@query(f"select doc_id, {_WS.format(_PLAIN.replace('regexp_replace(text', 'regexp_replace(nfc_normalize(text)'))} as text_norm from documents")
def nfc_normalize(spark, sf):
    """Full normalisation of a Latin-script language."""
    ship(spark)
    return docs(spark, sf).select("doc_id", T.normalize(F.col("text"), "eng").alias("text_norm"))


@query(rf"""select doc_id, regexp_replace(trim(source), '\s+', '_', 'g') || '_' || regexp_replace(trim(lang), '\s+', '_', 'g') || '_' ||
  substr(sha1(lang || '|' || source || '|' || {_WS.format(_PLAIN)}), 1, 16) as sentence_id from documents""")
def sentence_id(spark, sf):
    norm = T.collapse_space(T.map_punctuation(T.strip_zero_width(F.col("text"))))
    return docs(spark, sf).select("doc_id", T.sentence_id(F.col("lang"), F.col("source"), norm).alias("sentence_id"))


@query(r"select doc_id, trim(regexp_replace(coalesce(text, ''), '[\t\r\n]+', ' ', 'g')) as field from documents")
def sanitize_tsv(spark, sf):
    return docs(spark, sf).select("doc_id", T.tsv_field(F.col("text")).alias("field"))


@query(rf"""select doc_id, {_WS.format("regexp_replace(regexp_replace(text, '\\p{Zs}', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N} ]', '', 'g')")} as cleaned from documents""")
def clean_agnostic(spark, sf):
    return docs(spark, sf).select("doc_id", T.keep_letters(F.col("text")).alias("cleaned"))


_PARTS = r"""parts as (select doc_id, text, list_filter(string_split_regex(regexp_replace(trim(text), '([.!?।॥])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p) <> '') as p from documents),
sized as (select *, [len(list_filter(string_split_regex(trim(x), '\s+'), lambda w: w <> '')) for x in p] as n, [regexp_matches(x, '[.!?।॥]$') for x in p] as t from parts)"""


@query(f"""with {_PARTS} select doc_id, case when len(p) > 1 and list_max(n) >= 6
  then array_to_string([p[i] for i in range(1, len(p) + 1) if n[i] > 3 or i = len(p)], ' ') else trim(text) end as cleaned from sized""")
def weak_leading(spark, sf):
    return docs(spark, sf).select("doc_id", T.drop_weak_leading(F.col("text")).alias("cleaned"))


@query(f"""with {_PARTS} select doc_id, case when len([1 for i in range(1, len(p) + 1) if t[i] or n[i] >= 4]) > 0
  then array_to_string([p[i] for i in range(1, len(p) + 1) if t[i] or n[i] > 3], ' ') else trim(text) end as cleaned from sized""")
def trailing_fragments(spark, sf):
    return docs(spark, sf).select("doc_id", T.drop_fragments(F.col("text")).alias("cleaned"))


_B = r"।?؟॥።܀۔⁇⁈⁉‼⸮⸼…—~.|\n\r\t"
_PIECES = rf"""cut as (select doc_id, [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_extract_all(text, '(?s)[^{_B}]*[{_B}]+\s*|[^{_B}]+$')] as p from documents),
pieces as (select doc_id, generate_subscripts(p, 1) as k, unnest(p) as s from (select doc_id, [x for x in p if x <> ''] as p from cut)),
short as (select *, ((length(s) <= 5 and len(string_split_regex(s, '\s+')) < 5) or length(s) < 3 or not regexp_matches(s, '[\p{{L}}\p{{N}}]')) as short from pieces)"""


@query(rf"""with {_PIECES}, kept as (select * from pieces where length(s) >= 5 and len(string_split_regex(s, '\s+')) >= 5 and regexp_matches(s, '[\p{{L}}\p{{N}}]'))
  select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as idx, s as sentence from kept""")
def split_strict(spark, sf):
    return segment.sentences(docs(spark, sf), "text", ["doc_id"], min_len=5, buffer=False)


@query(f"""with {_PIECES}, runs as (select *, sum(case when short then 0 else 1 end) over (partition by doc_id order by k) as g from short)
  select doc_id, (row_number() over (partition by doc_id order by g) - 1)::int as idx, string_agg(s, ' ' order by k) as sentence from runs group by doc_id, g""")
def split_buffered(spark, sf):
    return segment.sentences(docs(spark, sf), "text", ["doc_id"], min_len=5, buffer=True)


@query("select doc_id, lang from documents where lang in ('de', 'fr') or lang = 'en'")
def language_prune(spark, sf):
    return docs(spark, sf).where(F.col("lang").isin("de", "fr") | (F.col("lang") == "en")).select("doc_id", "lang")


@query("""select source as episode, row_number() over (order by no desc, source)::int as place from
  (select distinct source, coalesce(try_cast(nullif(regexp_extract('MKB_' || substr(source, 4), 'MKB_(\\d+)', 1), '') as double), 'inf'::double) as no from documents)""".replace("\\\\", "\\"))
def episode_order(spark, sf):
    from pyspark.sql import Window

    number = T.episode_number(F.concat(F.lit("MKB_"), F.substring("source", 4, 100)))
    found = docs(spark, sf).select("source", number.alias("no")).distinct()
    return found.select(F.col("source").alias("episode"), F.row_number().over(Window.orderBy(F.desc("no"), "source")).alias("place"))


@query(r"""with w as (select conv_id, turn, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') as w from conversations),
  s as (select conv_id, turn, k, unnest(range(0, len(w) - k + 1)) as s, w from w, unnest([1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,21,22,23,24,25]) as t(k) where len(w) >= k)
  select conv_id, turn, count(*) as n_spans, sum(len)::bigint as chars, min(span) as first_span from
  (select conv_id, turn, array_to_string(w[s + 1:s + k], ' ') as span, length(array_to_string(w[s + 1:s + k], ' ')) as len from s) where len >= 3 group by 1, 2""")
def span_gen(spark, sf):
    """Spans of every turn, summed up per turn."""
    return segment.span_sums(turns(spark, sf), "text", ["conv_id", "turn"])


@query(r"""with w as (select doc_id, unnest(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) as w from documents)
  select doc_id, count(*) as n_words, count(*) filter (regexp_matches(w, '[A-Za-z]') and regexp_matches(regexp_replace(w, '[A-Za-z]', '', 'g'), '\p{L}')) as n_mixed from w group by 1""")
def script_mixing(spark, sf):
    """Words that mix basic Latin letters with others."""
    words = docs(spark, sf).select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if(T.mixes_scripts(F.col("w"), "Latn")).alias("n_mixed"))


@query(f"with {_SCORED} select * from scored where sim >= 0.3")
def sim_join(spark, sf):
    """All pairs from a threshold on."""
    return similarity.scores(*sides(spark, sf), BLOCK, 0.3)


@query(f"with {_RANKED} select label, i, j, sim, f as r from ranked where f <= 3 and sim >= 0.2")
def fwd_topk(spark, sf):
    return similarity.forward(ranked(spark, sf, 3), BLOCK, 3, 0.2)


@query(f"with {_RANKED} select label, i, j, sim, b as r from ranked where b <= 3 and sim >= 0.2")
def bwd_topk(spark, sf):
    return similarity.backward(ranked(spark, sf, 3), BLOCK, 3, 0.2)


@query(f"with {_RANKED} select label, i, j, sim from ranked where f <= 1 and b <= 1 and sim >= 0.2")
def mutual_topk(spark, sf):
    return similarity.mutual(ranked(spark, sf, 1), BLOCK, 1, 0.2)


@query(f"""with {_RANKED}, accepted as (select * from ranked where f <= 1 and b <= 1 and sim >= 0.2)
  select r.label, r.j, coalesce(a.i, r.i) as i, coalesce(a.sim, r.sim) as raw_similarity,
    round_even(case when a.i is not null then a.sim else r.sim * 0.5 end, 4) as similarity, a.i is not null as aligned
  from ranked r left join accepted a on r.label = a.label and r.j = a.j where r.b = 1""")
def all_compared(spark, sf):
    s = ranked(spark, sf, 1)
    return similarity.all_compared(s, similarity.mutual(s, BLOCK, 1, 0.2), BLOCK)


@query(f"""with {_RANKED}, covered as (select distinct label, j from ranked where f <= 1 and b <= 1 and sim >= 0.2),
  rest as (select label, i, j, sim, row_number() over (partition by label, i order by sim desc, j) as f, row_number() over (partition by label, j order by sim desc, i) as b
    from scored s where not exists (select 1 from covered c where c.label = s.label and c.j = s.j))
  select label, i, j, sim from rest where f <= 1 and b <= 1 and sim >= 0.1""")
def leftover_topk(spark, sf):
    return similarity.leftover(*sides(spark, sf), similarity.mutual(ranked(spark, sf, 1), BLOCK, 1, 0.2), BLOCK, 1, 0.1)


_CAPPED = """recursive """ + _RANKED + """, m as (select label, i, j, sim, row_number() over (partition by label order by sim desc, i, j) as n from ranked where f <= 3 and b <= 3 and sim >= 0.1),
  walk(label, n, i, j, sim, ok, us, vs) as (select distinct label, 0::bigint, null::bigint, null::bigint, null::double, false, []::bigint[], []::bigint[] from m
    union all select m.label, m.n, m.i, m.j, m.sim, free, case when free then list_append(us, m.i) else us end, case when free then list_append(vs, m.j) else vs end
    from (select m.*, us, vs, not list_contains(us, m.i) and not list_contains(vs, m.j) as free from walk w join m on m.label = w.label and m.n = w.n + 1) m)"""


@query(f"with {_CAPPED} select label, i, j, sim from walk where ok")
def usage_cap(spark, sf):
    """Reciprocal top 3, each vector used once."""
    ship(spark)
    return similarity.usage_capped(similarity.mutual(ranked(spark, sf, 3), BLOCK, 3, 0.1), BLOCK, 1)


@query("""with s as (select a.label, a.vec_id as i, b.vec_id as j, round(list_dot_product(a.embedding[1:32]::double[], b.embedding[1:32]::double[]), 6) as s1,
    round(list_dot_product(a.embedding[33:64]::double[], b.embedding[33:64]::double[]), 6) as s2
  from embeddings a join embeddings b on a.label = b.label and a.vec_id % 2 = 0 and b.vec_id % 2 = 1),
  k as (select *, row_number() over (partition by label, i order by s1 desc, j) as r from s),
  f as (select label, i, j, round(s1 * 0.45::double + s2 * 0.55::double, 8) as sim from k where r <= 25)
  select label, i, j, sim from (select *, row_number() over (partition by label, i order by sim desc, j) as r from f) where r = 1""")
def rerank(spark, sf):
    """Two halves of each vector as the two models."""
    halves = lambda d, n: d.select("label", n, F.slice("v", 1, 32).alias("v"), F.slice("v", 33, 32).alias("w"))
    left, right = sides(spark, sf)
    return similarity.rerank(halves(left, "i"), halves(right, "j"), BLOCK, X.SHORTLIST)


_CANDIDATES = _RANKED + """, c as (select label, j, i, sim as similarity, sim >= 0.2 as aligned, case when b % 2 = 1 then 'sliding' else 'mutual_topk_cosine' end as stage,
  case when b % 2 = 1 then 0.2::double else 0.25::double end as threshold, b as ordinal from ranked where b <= 4)"""


def candidates(spark, sf) -> DataFrame:
    """Four best per j, dealt out over two stages."""
    four = similarity.backward(ranked(spark, sf, 4), BLOCK, 4, -2.0)
    sliding = F.col("r") % 2 == 1
    return four.select(
        "label", "j", "i", F.col("sim").alias("similarity"), (F.col("sim") >= 0.2).alias("aligned"), F.when(sliding, "sliding").otherwise("mutual_topk_cosine").alias("stage"),
        F.when(sliding, 0.2).otherwise(0.25).alias("threshold"), F.col("r").alias("ordinal"),
    )


_PICK = "row_number() over (partition by label, j order by aligned::int desc, {} , similarity desc, ordinal) = 1"
_STAGE = "(stage = 'mutual_topk_cosine')::int"


@query(f"with {_CANDIDATES} select * from c qualify {_PICK.format(_STAGE)}")
def collapse_best(spark, sf):
    return align.collapse(candidates(spark, sf), ["label", "j"])


@query(f"""with {_CANDIDATES}, w as (select *, max(similarity) filter (stage = 'sliding' and aligned) over (partition by label, j) as best from c)
  select * exclude (best) from w qualify {_PICK.format("case when coalesce((best - 0.2::double) / 0.2::double < 0.1, false) then -" + _STAGE + " else " + _STAGE + " end")}""")
def collapse_override(spark, sf):
    return align.collapse(candidates(spark, sf), ["label", "j"], override=True)


@query(f"with {_CANDIDATES} select *, {_PICK.format(_STAGE)} as is_selected_best from c")
def both_candidates(spark, sf):
    return align.both_candidates(candidates(spark, sf), ["label", "j"])


@query(f"""with {_RANKED}, main as (select label, i, j, sim from ranked where f <= 1 and b <= 1 and sim >= 0.4), second as (select label, i, j, sim from ranked where f <= 1 and b <= 1 and sim >= 0.2)
  select * from main union all select * from second where label not in (select label from main)""")
def fallback_retry(spark, sf):
    s = ranked(spark, sf, 1)
    return align.with_fallback(similarity.mutual(s, BLOCK, 1, 0.4), similarity.mutual(s, BLOCK, 1, 0.2), BLOCK)


#: A label's right side in order stands for a paragraph: a vector's place there is where its span starts, its number gives the width.
_PLACED = "recursive " + _RANKED + """, place as (select label, vec_id as j, (row_number() over (partition by label order by vec_id) - 1)::bigint as s, (1 + vec_id % 4)::bigint as w
    from embeddings where label is not null and vec_id % 2 = 1),
  lengths as (select label, max(s + w)::bigint as n from place group by 1),
  placed as (select r.label, r.i, p.s, p.s + p.w as e, r.sim from ranked r join place p on r.label = p.label and r.j = p.j where r.f <= 4 and r.sim >= 0.1)"""
_FRONTIER = _PLACED + """, given as (select label, i, row_number() over (partition by label order by i) as k, list({'s': s, 'e': e, 'sim': sim} order by sim desc, s, e) as c from placed group by 1, 2),
  steps(label, k, front_at, i, x) as (select distinct label, 0::bigint, 0::bigint, null::bigint, null::struct(s bigint, e bigint, sim double) from given
    union all select label, k, greatest(front_at, coalesce(x.e, 0)), i, x from (select g.label, g.k, w.front_at, g.i,
      list_filter(g.c, lambda y: y.sim >= case when y.s >= w.front_at - 15 then 0.15 else 0.3 end)[1] as x from steps w join given g on g.label = w.label and g.k = w.k + 1)),
  front as (select label, i, x.s as s, x.e as e, x.sim as sim from steps where x is not null)"""
_DEOVERLAP = _FRONTIER + """, by_score as (select *, row_number() over (partition by label order by sim desc, i, s, e) as k from front),
  picks(label, k, i, s, e, sim, ok, kept) as (select distinct label, 0::bigint, null::bigint, null::bigint, null::bigint, null::double, false, []::struct(s bigint, e bigint)[] from by_score
    union all select label, k, i, s, e, sim, free, case when free then list_append(kept, {'s': s, 'e': e}) else kept end
    from (select f.*, p.kept, len(list_filter(p.kept, lambda y: f.s < y.e and y.s < f.e)) = 0 as free from picks p join by_score f on f.label = p.label and f.k = p.k + 1)),
  held as (select label, i, s, e, sim from picks where ok)"""
_SEGMENTS = _DEOVERLAP + """, gaps as (select label, lag(e, 1, 0) over (partition by label order by s) as s, s as e from held),
  tails as (select n.label, coalesce(max(h.e), 0) as s, n.n as e from lengths n left join held h on n.label = h.label group by 1, 3),
  every as (select label, s, e, true as aligned from held union all select label, s, e, false from gaps where s < e union all select label, s, e, false from tails where s < e)"""


def placed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Candidate spans of each block, and the blocks' lengths."""
    left, right = sides(spark, sf)
    from pyspark.sql import Window

    start = F.row_number().over(Window.partitionBy("label").orderBy("j")) - 1
    place = right.select("label", "j", start.cast("long").alias("s")).withColumn("e", F.col("s") + 1 + F.col("j") % 4)
    near = similarity.forward(similarity.ranked(left, right, BLOCK, 4), BLOCK, 4, 0.1)
    return near.join(place, ["label", "j"]).select("label", "i", "s", "e", "sim"), place.groupBy("label").agg(F.max("e").alias("n"))


def held(spark, sf) -> tuple[DataFrame, DataFrame]:
    spans, lengths = placed(spark, sf)
    return align.deoverlap(align.frontier(spans, BLOCK, 0.15, 0.3), BLOCK), lengths


@query(f"with {_FRONTIER} select * from front")
def frontier(spark, sf):
    """Order-constrained walk over the sentences of each block."""
    ship(spark)
    return align.frontier(placed(spark, sf)[0], BLOCK, 0.15, 0.3)


@query(f"with {_DEOVERLAP} select * from held")
def deoverlap(spark, sf):
    """Of what the walk accepts, the best spans that don't overlap."""
    ship(spark)
    return held(spark, sf)[0]


@query(f"with {_SEGMENTS} select label, s, e, aligned, (row_number() over (partition by label order by s) - 1)::int as seg_idx from every")
def segments(spark, sf):
    """The spans kept, and the gaps around them."""
    ship(spark)
    return align.segments(*held(spark, sf), BLOCK)


@query(f"""with {_SEGMENTS}, marked as (select label, unnest(range(s, e)) as word from every)
  select l.label, l.n, count(m.word)::bigint as covered, count(m.word) = l.n and count(distinct m.word) = l.n as ok from lengths l left join marked m on l.label = m.label group by 1, 2""")
def coverage(spark, sf):
    """Words in segments, against the paragraph's words one by one."""
    ship(spark)
    spans, lengths = held(spark, sf)
    return align.coverage(align.segments(spans, lengths, BLOCK), lengths, BLOCK)


@query("select conv_id, role, array_to_string(list_sort(list_distinct(list(text))), chr(10)) as texts from conversations where text is not null group by 1, 2")
def sorted_set(spark, sf):
    return corpus.sorted_sets(turns(spark, sf), ["conv_id", "role"], "text").withColumn("texts", F.array_join("texts", "\n"))


ROLES = ["user", "assistant", "system"]
_WIDE = "select conv_id, " + ", ".join(f"array_to_string(list_sort(list_distinct(list(text) filter (role = '{r}'))), chr(10)) as {r}_texts" for r in ROLES) + " from conversations where text is not null group by 1"


@query(_WIDE)
def wide_pivot(spark, sf):
    """Roles as languages, conversations as the shared key."""
    table = corpus.wide(turns(spark, sf), "conv_id", "role", "text", ROLES)
    return table.select("conv_id", *(F.array_join(r, "\n").alias(f"{r}_texts") for r in ROLES))


@query(f"select conv_id from ({_WIDE}) where (user_texts is not null)::int + (assistant_texts is not null)::int + (system_texts is not null)::int >= 2")
def min_lang_frac(spark, sf):
    return corpus.enough_languages(corpus.wide(turns(spark, sf), "conv_id", "role", "text", ROLES), ROLES, 0.5).select("conv_id")


@query("""select distinct 'conv' || conv_id as "English", conv_id::varchar as "English_sentence_id", text, sha1(text) as sentence_id from conversations where text is not null""")
def explode_pairs(spark, sf):
    """All turns of a conversation as the texts of one cell."""
    lists = turns(spark, sf).where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set("text")).alias("Target"))
    ids = F.transform("Target", lambda t: F.sha1(t.cast("binary")))
    table = lists.select("Target", ids.alias("Target_sentence_ids"), F.concat(F.lit("conv"), "conv_id").alias("English"), F.col("conv_id").cast("string").alias("English_sentence_id"))
    return corpus.explode_pairs(table, "Target", "English")


@query("select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id")
def id_left_join(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "id")
    return corpus.id_join(docs(spark, sf).select("doc_id", "source"), labels, "doc_id")


@query("select d.doc_id, l.quality, m.toxic from documents d join labels l on d.doc_id = l.doc_id join labels m on d.doc_id + 1 = m.doc_id where l.quality is not null and m.toxic is not null")
def pair_audio_join(spark, sf):
    """Both sides looked up, rows without either dropped."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = corpus.id_join(docs(spark, sf).select("doc_id", (F.col("doc_id") + 1).alias("next")), labels.select(F.col("doc_id").alias("id"), "quality"), "doc_id")
    return corpus.id_join(rows, labels.select(F.col("doc_id").alias("id"), "toxic"), "next").na.drop(subset=["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("""select d.doc_id, l.similarity from documents d left join (select doc_id, quality::double as similarity from labels
  qualify row_number() over (partition by doc_id order by quality, toxic) = 1) l on d.doc_id = l.doc_id""")
def similarity_attach(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("similarity"), "toxic")
    return corpus.attach_first(docs(spark, sf).select("doc_id"), labels, "doc_id", F.struct("similarity", "toxic")).select("doc_id", "similarity")


@query("select doc_id, lang, source from documents qualify row_number() over (partition by text order by doc_id) = 1")
def dedupe_keep_first(spark, sf):
    return corpus.keep_first(docs(spark, sf), ["text"], ["doc_id"]).select("doc_id", "lang", "source")


@query("""with a as (select * from documents qualify row_number() over (partition by text order by doc_id) = 1)
  select doc_id from a qualify row_number() over (partition by n_chars order by doc_id) = 1""")
def dedupe_text_legacy(spark, sf):
    return corpus.legacy_dedupe(docs(spark, sf), "text", "n_chars", ["doc_id"]).select("doc_id")


@query("""select doc_id, lang, case when doc_id % 3 <> 1 then source end as source from documents""")
def union_episodes(spark, sf):
    """Three parts of the documents, one of which lacks a column."""
    d = docs(spark, sf).select("doc_id", "lang", "source")
    part = lambda k: d.where(F.col("doc_id") % 3 == k)
    return corpus.union_episodes([part(0), part(1).drop("source"), part(2)])


_SIM = "rows as (select doc_id, lang, ((doc_id * 7919) % 1000)::double / 1000 as similarity from documents)"
_HIGH = _SIM + ", cuts as (select lang, quantile_cont(similarity, 0.9) as cut, count(*) as n from rows group by 1), pool as (select r.*, c.n, coalesce(similarity >= cut, false) as high from rows r join cuts c on r.lang = c.lang)"


def rated(spark, sf) -> DataFrame:
    return docs(spark, sf).select("doc_id", "lang", ((F.col("doc_id") * 7919 % 1000).cast("double") / 1000).alias("similarity"))


@query(f"with {_HIGH} select doc_id, lang, similarity, high from pool")
def quantile_pool(spark, sf):
    return manifest.high_pool(rated(spark, sf), "lang").select("doc_id", "lang", "similarity", "high")


_SPLIT = _HIGH + """, v as (select *, row_number() over (partition by lang order by high desc, sha256((case when high then '42:' else '43:' end) || doc_id), doc_id) <= floor(n * 0.05) as valid from pool where n >= 100),
  s as (select doc_id, lang, similarity, case when valid then 'valid' when row_number() over (partition by lang order by valid, sha256('24:' || doc_id), doc_id) <= 500 then 'test' else 'train' end as split from v)"""


@query(f"with {_SPLIT} select * from s")
def split_assign(spark, sf):
    return manifest.split(rated(spark, sf), "lang", "doc_id", min_rows=100)


@query(f"with {_SPLIT} select lang, split, count(*) as n, round(avg(similarity), 6) as mean_similarity from s group by 1, 2")
def split_stats(spark, sf):
    return manifest.split_stats(split_assign(spark, sf), "lang")


@query("""with r as (select *, row_number() over (partition by lang, s order by doc_id) as id from (select *, case when doc_id % 10 = 0 then 'valid' else 'train' end as s from documents))
  select lang, s as split, id::int as id, '{"source":{"id":' || id || ',"lang":"' || lang || '","text":"' || sha1(text) || '","audio_local_path":null,"waveform":null,"sampling_rate":16000,"units":null},"target":{"id":' || id
    || ',"lang":"eng","text":"' || doc_id || '","audio_local_path":null,"waveform":null,"sampling_rate":16000,"units":[' || doc_id || ',1]}}' as record from r""")
def manifest_json(spark, sf):
    none = F.lit(None).cast("string")
    rows = docs(spark, sf).select(
        "doc_id", "lang", F.when(F.col("doc_id") % 10 == 0, "valid").otherwise("train").alias("split"), F.col("lang").alias("source_lang"), F.sha1(F.col("text").cast("binary")).alias("source_text"),
        none.alias("source_path"), F.lit(None).cast("array<int>").alias("source_units"), F.lit("eng").alias("target_lang"), F.col("doc_id").cast("string").alias("target_text"),
        none.alias("target_path"), F.array(F.col("doc_id").cast("int"), F.lit(1)).alias("target_units"),
    )
    return manifest.records(rows, "lang", ["doc_id"])


@query("select doc_id, case when doc_id % 3 = 0 then null else 2::int end as n_units, case when doc_id % 3 = 0 then null else doc_id::int end as first_unit from documents")
def parse_units(spark, sf):
    """Unit lists from text, null where malformed."""
    text = F.when(F.col("doc_id") % 3 == 0, "not a list").otherwise(F.concat(F.lit("["), "doc_id", F.lit(", 7]")))
    units = T.parse_units(text)
    return docs(spark, sf).select("doc_id", F.when(units.isNotNull(), F.size(units)).alias("n_units"), F.get(units, F.lit(0)).alias("first_unit"))


_DIM = ", ".join(f"('{n}', '{n[:2].lower()}', '{m}')" for n, _, _, m, _ in X.LANGUAGES)


@query(f"""with dim(name, lang, code) as (values {_DIM}), one as (select lang, min(code) as code from dim group by 1)
  select d.lang, coalesce(o.code, 'unk') as code, count(*) as n from documents d left join one o on d.lang = o.lang group by 1, 2""")
def language_dim(spark, sf):
    """Lookup in the language dimension, by the first two letters of the names, with a default."""
    dim = build.languages(spark).select(F.lower(F.substring("language", 1, 2)).alias("lang"), "manifest_code").groupBy("lang").agg(F.min("manifest_code").alias("code"))
    rows = docs(spark, sf).join(F.broadcast(dim), "lang", "left").withColumn("code", F.coalesce("code", F.lit("unk")))  # as many rows as languages
    return rows.groupBy("lang", "code").agg(F.count("*").alias("n"))


#: Letters of the text turned into characters that the folds replace, so that each of their rules has work in every document.
_TO_DIGITS = ("0123456789", "०১୨٣۴௫౬೭൮９")
_TO_ARABIC = ("abcdefghij", "ىةۀأإآًّـو")
_TO_BENGALI = ("abcdefgh", "কখািে়োঁ")


@query(f"""with t as (select doc_id, translate(text, '{"".join(_TO_DIGITS[1])}', '') as text from documents),
  a as (select doc_id, text, translate(lower(text), '{_TO_ARABIC[0]}', '{_TO_ARABIC[1]}') as arab, replace(replace(lower(text), 'a', 'ड़'), 'b', 'चँढ़') as deva from t)
  select doc_id, text as digits, translate(translate(arab, '{X.HARAKAT}{X.TATWEEL}', ''), 'ىةۀأإآ', 'يههااا') as arabic,
    replace(replace(translate(deva, 'ँ', 'ं'), 'ड़', 'ड'), 'ढ़', 'ढ') as nukta from a""")
def script_folds(spark, sf):
    """Digits of any script, Arabic letters and marks, nukta and chandrabindu."""
    rows = docs(spark, sf).select("doc_id", F.translate("text", _TO_DIGITS[1], "").alias("text"))
    arab = F.translate(F.lower("text"), *_TO_ARABIC)
    deva = F.replace(F.replace(F.lower("text"), F.lit("a"), F.lit("ड़")), F.lit("b"), F.lit("चँढ़"))
    return rows.select("doc_id", T.map_digits(F.translate("text", *_TO_DIGITS)).alias("digits"), T.fold_arabic(arab).alias("arabic"), T.fold_nukta(deva).alias("nukta"))


@query(rf"""with t as (select doc_id, translate(lower(text), '{_TO_BENGALI[0]}', '{_TO_BENGALI[1]}') as t from documents),
  a as (select doc_id, t as was from t),
  b as (select doc_id, array_to_string([w for w in list_transform(range(1, length(was) + 1), lambda i: case when was[i] similar to '[{X.BENGALI_SIGNS}]' and (i = 1 or not was[i - 1] similar to '[{X.BENGALI_BASE}]') then '' else was[i] end)], '') as t from a),
  c as (select doc_id, regexp_replace(regexp_replace(t, '([োো])[\s\p{{Z}}]+[োো]', '\1', 'g'), '([{X.BENGALI_BASE}])[\s\p{{Z}}]+([{X.BENGALI_VOWELS}])', '\1\2', 'g') as t from b)
  select doc_id, sha256(replace(replace(regexp_replace(regexp_replace(t, '^[{X.BENGALI_VOWELS}]+', ''), '়+', '়', 'g'), '্ী', 'ী'), '  ', ' ')) as tidied from c""")
def bengali_tidy(spark, sf):
    """Stray and split vowel signs."""
    return docs(spark, sf).select("doc_id", F.sha2(T.tidy_bengali(F.translate(F.lower("text"), *_TO_BENGALI)).cast("binary"), 256).alias("tidied"))


_NAMED = "case lang when 'en' then 'English' when 'de' then 'Bodo' when 'fr' then 'Garo' else 'Hindi' end"


@query(rf"""with docs as (select doc_id, {_NAMED} as language, text from documents where text is not null),
  cut as (select doc_id, [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_extract_all(text, '(?s)[^{_B}]*[{_B}]+\s*|[^{_B}]+$')] as p from docs),
  pieces as (select doc_id, generate_subscripts(p, 1) as k, unnest(p) as s from (select doc_id, [x for x in p if x <> ''] as p from cut)),
  short as (select *, ((length(s) <= 5 and len(string_split_regex(s, '\s+')) < 5) or length(s) < 3 or not regexp_matches(s, '[\p{{L}}\p{{N}}]')) as short from pieces),
  runs as (select *, sum(case when short then 0 else 1 end) over (partition by doc_id order by k) as g from short),
  buffered as (select doc_id, g as k, string_agg(s, ' ' order by k) as s from runs group by doc_id, g),
  strict as (select doc_id, k, s from pieces where length(s) >= 3 and regexp_matches(s, '[\p{{L}}\p{{N}}]')),
  every as (select d.doc_id, d.language, x.k, x.s from docs d join buffered x on d.doc_id = x.doc_id where d.language in ('English', 'Hindi')
    union all select d.doc_id, d.language, x.k, x.s from docs d join strict x on d.doc_id = x.doc_id where d.language in ('Bodo', 'Garo')),
  whole as (select doc_id, language, 1 as k, trim(text) as s from docs where trim(text) <> '' and doc_id not in (select doc_id from every)),
  rows as (select * from every union all select * from whole)
  select language, 'ep' || doc_id as episode, (row_number() over (partition by doc_id order by k) - 1)::int as idx, s as text, language in ('Bodo', 'Garo') as low_resource from rows""")
def sentence_table(spark, sf):
    """Sentences of every document as a transcript: strict for low-resource languages, buffered for others, whole where nothing is left."""
    ship(spark)
    language = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "Bodo").when(F.col("lang") == "fr", "Garo").otherwise("Hindi")
    rows = docs(spark, sf).where("text is not null").select(language.alias("language"), F.concat(F.lit("ep"), "doc_id").alias("episode"), "text")
    return build.sentence_table(rows).select("language", "episode", "idx", "text", "low_resource")


_SHOWN = "round_even(case when aligned then raw_similarity else raw_similarity * 0.5 end, 4)"


@query(f"""with {_DEOVERLAP}, best as (select * from placed qualify row_number() over (partition by label, i order by sim desc, s, e) = 1),
  mine as (select b.label, b.i, coalesce(f.s, b.s) as s, coalesce(f.e, b.e) as e, ((round(coalesce(f.sim, b.sim) * 1000000)::bigint + 50) // 100) / 10000.0::double as raw_similarity from best b left join front f on b.label = f.label and b.i = f.i),
  flagged as (select m.*, h.s is not null as aligned from mine m left join held h on m.label = h.label and m.i = h.i and m.s = h.s and m.e = h.e),
  numbered as (select *, round(raw_similarity * 10000)::int as x from flagged)
  select * exclude (x), (case when aligned then x when x % 2 = 0 then x / 2 else x // 2 + (x // 2) % 2 end / 10000.0)::double as similarity from numbered""")
def sliding_compared(spark, sf):
    """Per sentence: the accepted span, else the best one whatever its score; aligned only what de-overlap kept."""
    ship(spark)
    spans, _ = placed(spark, sf)
    walked = align.frontier(spans, BLOCK, 0.15, 0.3)
    return align.compared(spans, walked, align.deoverlap(walked, BLOCK), BLOCK)


_VIEW = """select r.label, r.i, coalesce(a.j, r.j) as j, coalesce(a.sim, r.sim) as raw_similarity, a.j is not null as aligned, '{}' as stage, {} as ordinal from ranked r
  left join (select * from ranked where f <= 1 and b <= 1 and sim >= {}) a on r.label = a.label and r.i = a.i where r.f = 1"""


@query(f"""with {_RANKED}, legs as ({_VIEW.format("sliding", 0, 0.4)} union all {_VIEW.format("mutual_topk_cosine", 1, 0.2)}), shown as (select *, {_SHOWN} as similarity from legs)
  select label, i, j, similarity, raw_similarity, aligned, stage from shown
  qualify row_number() over (partition by label, i order by aligned::int desc, (stage = 'mutual_topk_cosine')::int, similarity desc, ordinal) = 1""")
def complete_pairs(spark, sf):
    """One row per sentence over two legs, whatever the threshold."""
    ranks, rows = ranked(spark, sf, 1), []
    for n, (stage, least) in enumerate((("sliding", 0.4), ("mutual_topk_cosine", 0.2))):
        view = similarity.all_compared(ranks, similarity.mutual(ranks, BLOCK, 1, least), BLOCK, side="i")
        rows.append(view.withColumns({"stage": F.lit(stage), "ordinal": F.lit(n), "threshold": F.lit(None).cast("double")}))
    return align.collapse(corpus.union_episodes(rows), ["label", "i"]).select("label", "i", "j", "similarity", "raw_similarity", "aligned", "stage")


@query("""with s as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as line_index, role, text from conversations),
  side as (select conv_id, line_index, 'id' || conv_id || '-' || line_index as sentence_id from s where line_index % 3 <> 2)
  select s.conv_id, s.line_index, s.role, side.sentence_id from s left join side on s.conv_id = side.conv_id and s.line_index = side.line_index""")
def positional_join(spark, sf):
    """Lines of each conversation with the ids at the same place of a sidecar that lacks every third."""
    from pyspark.sql import Window

    lines = turns(spark, sf).withColumn("line_index", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    side = lines.where("line_index % 3 <> 2").select("conv_id", "line_index", F.concat_ws("-", F.concat(F.lit("id"), "conv_id"), "line_index").alias("sentence_id"))
    return corpus.positional_join(lines.select("conv_id", "line_index", "role"), side, ["conv_id"])


@query("""with p as (select distinct conv_id, role, text from conversations where text is not null), x as (select conv_id, role, list(text order by text) as t, list(sha1(text) order by text) as i from p group by 1, 2)
  select 'conv' || conv_id as "English", sha1('conv' || conv_id) as "English_sentence_id", """ + ", ".join(f"array_to_string(max(t) filter (role = '{r}'), chr(10)) as {r}, array_to_string(max(i) filter (role = '{r}'), ',') as {r}_sentence_ids" for r in ROLES) + " from x group by conv_id")
def wide_ids(spark, sf):
    """Wide table with a list of texts and the list of their ids per language."""
    name = F.concat(F.lit("conv"), "conv_id")
    pairs = turns(spark, sf).where("text is not null").select(
        F.lit("all").alias("episode"), name.alias("english"), F.sha1(name.cast("binary")).alias("English_sentence_id"), F.col("role").alias("language"), "text", F.sha1(F.col("text").cast("binary")).alias("sentence_id")
    )
    table = build.wide_table(pairs, ROLES)
    return table.select("English", "English_sentence_id", *(c for r in ROLES for c in (F.array_join(r, "\n").alias(r), F.array_join(f"{r}_sentence_ids", ",").alias(f"{r}_sentence_ids"))))


@query("""select d.source, count(*) as rows, count(l.quality) as matched, count(*) - count(l.quality) as unmatched, count(*) filter (l.toxic is null) as without_toxic
  from documents d left join labels l on d.doc_id = l.doc_id group by 1""")
def match_counts(spark, sf):
    """How many ids of each source found a partner."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "id")
    joined = corpus.id_join(docs(spark, sf).select("doc_id", "source"), labels, "doc_id")
    return log.counts(joined, ("source",), matched=F.col("quality").isNotNull(), unmatched=F.col("quality").isNull(), without_toxic=F.col("toxic").isNull())


@query("""with t as (select vec_id, [[x::double for x in embedding[k * 8 + 1:k * 8 + 8]] for k in range(0, 8)] as t, [(k < vec_id % 9)::int for k in range(0, 8)] as m from embeddings where embedding is not null),
  kept as (select vec_id, d, list_avg([t[k][d] for k in range(1, 9) if m[k] = 1]) as v from t, unnest(range(1, 9)) as u(d))
  select vec_id, list(round(v, 6) order by d) filter (v is not null) as pooled from kept group by 1""")
def mean_pool(spark, sf):
    """Mean of the first few of eight token vectors."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.slice("embedding", k * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k < F.col("vec_id") % 9).cast("int"))
    pooled = V.mean_pool(tokens, mask, 8)
    return rows.select("vec_id", F.transform(pooled, lambda x: V.rounded(x, 6)).alias("pooled"))


@query(r"""with d as (select doc_id, lang, case when text is null or not regexp_matches(text, '[A-Za-z]') then null when regexp_matches(text, '\b([Tt]he|and)\b') then 'en' else 'xx' end as found from documents)
  select doc_id, lang from d where found is null or (lang = 'en') = (found = 'en')""")
def right_language(spark, sf):
    """Texts that are what their language says, by a detector that knows two English words."""
    detect = lambda t: F.when(t.rlike("[A-Za-z]"), F.when(t.rlike(r"\b([Tt]he|and)\b"), "en").otherwise("xx"))
    return corpus.right_language(docs(spark, sf), "text", "lang", detect, "en").select("doc_id", "lang")


def _normal(column: str) -> str:
    return _WS.format(_PLAIN.replace("regexp_replace(text", f"regexp_replace(nfc_normalize({column})"))


@query(f"""with t as (select doc_id, translate(text, '{"".join(_TO_DIGITS[1])}', '') as text from documents),
  a as (select doc_id, translate(lower(text), '{_TO_ARABIC[0]}', '{_TO_ARABIC[1]}') as arab, replace(replace(lower(text), 'a', 'ड़'), 'b', 'चँढ़') as deva from t)
  select doc_id, {_WS.format(f"translate(translate({_normal('arab')}, '{X.HARAKAT}{X.TATWEEL}', ''), 'ىةۀأإآ', 'يههااا')")} as urdu,
    {_WS.format(f"replace(replace(translate({_normal('deva')}, 'ँ', 'ं'), 'ड़', 'ड'), 'ढ़', 'ढ')")} as hindi from a""")
def normalize_scripts(spark, sf):
    """Full normalisation of texts in Arabic and Devanagari letters."""
    ship(spark)
    rows = docs(spark, sf).select("doc_id", F.lower(F.translate("text", _TO_DIGITS[1], "")).alias("text"))
    deva = F.replace(F.replace("text", F.lit("a"), F.lit("ड़")), F.lit("b"), F.lit("चँढ़"))
    return rows.select("doc_id", T.normalize(F.translate("text", *_TO_ARABIC), "urd-script_arabic").alias("urdu"), T.normalize(deva, "hin").alias("hindi"))
