"""Registered queries of this package: one per operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import language_crf, quality_model
from kindred.llm.centroid_clusters import centroid_clusters, with_inertia
from kindred.llm.chat_format import format_turns, read_back
from kindred.llm.common import table
from kindred.llm.exact_dedup import exact_duplicates
from kindred.llm.filter_audit import audit_filters
from kindred.llm.html_text import extract_text
from kindred.llm.packing import best_fit_packing
from kindred.llm.personal_data import BASE_KINDS, find_personal_data, span_text
from kindred.llm.quality_rules import quality_rules
from kindred.llm.sentence_pieces import encode
from kindred.llm.simhash_links import near_duplicates
from kindred.llm.substring_dedup import repeated_substrings
from kindred.sources.scratch import Scratch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    added = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    return read_back(format_turns(turns.unionByName(added)))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.quality_scores(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_crf.languages(docs, language_crf.fit(docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))


OP6_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from t
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents"), Scratch(spark))


OP8_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') as words
  from documents),
s as (select doc_id, unnest(range(1, len(words) - 33)) as i, words from w where len(words) >= 35),
h as (select doc_id, i, array_to_string(words[i:i + 34], ' ') as win from s),
r as (select doc_id, i from (select *, count(*) over (partition by win) as n from h) where n > 1),
g as (select distinct doc_id, i + k as at from r, range(35) t(k)),
p as (select doc_id, words, unnest(range(1, len(words) + 1)) as at from w),
k as (select p.doc_id, string_agg(words[p.at], ' ' order by p.at) as kept, count(*) as n
      from p left join g on p.doc_id = g.doc_id and p.at = g.at where g.at is null group by p.doc_id)
select w.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), Scratch(spark), tokenizer_path("word_bpe_49k.json"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*centroid_clusters(table(spark, sf_dir, "embeddings"), Scratch(spark)))


# One assignment and one update of the centroids per round; the tables are sums over (cluster, component).
_NEAREST_SQL = """
a{r} as materialized (
  select row, arg_min(cluster, d * 16 + cluster) as cluster, min(d) as distance
  from (select v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x))::hugeint as d from v join c{r} c using (i) group by all)
  group by row)"""
_MOVED_SQL = """
c{s} as materialized (
  select c.cluster, c.i, coalesce(m.x, c.x) as x from c{r} c left join (
    select cluster, i, ((t - ((t % n) + n) % n) // n)::bigint as x
    from (select cluster, i, sum(x)::hugeint as t, count(*)::hugeint as n from a{r} join v using (row) group by all)
  ) m on c.cluster = m.cluster and c.i = m.i)"""
OP11_SQL = (
    """
with k as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)) as xs
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e::double))) = 64),
v as materialized (select row, i, xs[i]::bigint as x from k, range(1, 65) t(i)),
s as (
  select row, row_number() over (order by vec_id is null, sha256('3:' || coalesce(vec_id::varchar, '')), xs) - 1 as cluster
  from k qualify cluster < 8),
c0 as materialized (select cluster, i, x from s join v using (row)),"""
    + ",".join(_NEAREST_SQL.format(r=r) + "," + _MOVED_SQL.format(r=r, s=r + 1) for r in range(10))
    + ","
    + _NEAREST_SQL.format(r=10)
    + """
select vec_id, a10.cluster::int as cluster, distance::bigint as distance,
  sum(distance) over (partition by a10.cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, sha as centroid_sha256
from a10 join k using (row)
join (select cluster, sha256(string_agg(x::varchar, ',' order by i)) as sha from c10 group by cluster) h on a10.cluster = h.cluster
"""
)


def _is(value: str):
    return lambda x: x == value


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


OP13_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, coalesce(source, '') as part,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') as words
  from documents),
l as (
  select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic
  from labels where doc_id is not null group by doc_id),
f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [
    len(words) < 50,
    100 * len(list_distinct(words)) < 65 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) over (partition by text)] as fails
  from t left join l using (doc_id)),
m as materialized (
  select part, fails, count(*) as n, sum(good) as n_good, sum(toxic) as n_toxic from f group by all),
p as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from p a, p b, p c, p d, p e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
s as (
  select m.*, filter_order, step, fails[ascii(filter_order[step]) - 64] as own,
    list_bool_or([fails[ascii(filter_order[j]) - 64] for j in range(1, step)]) is true as before,
    len(list_filter(fails, lambda x: x)) as n_fails
  from m, o, range(1, 6) q(step)),
r as (
  select part, filter_order, step,
    sum(case when not own and not before then n else 0 end)::bigint as kept,
    sum(case when own and not before then n else 0 end)::bigint as removed,
    sum(case when own and before then n else 0 end)::bigint as redundant,
    sum(case when own and n_fails = 1 then n else 0 end)::bigint as unique_fails,
    sum(case when own and not before then n_good else 0 end)::bigint as good_lost,
    sum(case when own and not before then n_toxic else 0 end)::bigint as toxic_lost
  from s group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, filter_order[step])::bigint as shapley
from r
"""


QUERIES = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_chat_format": (op2_chat_format, None),
    "op3_quality_model": (op3_quality_model, None),
    "op4_html_text": (op4_html_text, None),
    "op5_language_crf": (op5_language_crf, None),
    "op6_exact_dedup": (op6_exact_dedup, OP6_SQL),
    "op7_quality_rules": (op7_quality_rules, None),
    "op8_substring_dedup": (op8_substring_dedup, OP8_SQL),
    "op9_simhash": (op9_simhash, None),
    "op10_packing": (op10_packing, None),
    "op11_centroid_clusters": (op11_centroid_clusters, OP11_SQL),
    "op12_personal_data": (op12_personal_data, None),
    "op13_filter_audit": (op13_filter_audit, OP13_SQL),
}
