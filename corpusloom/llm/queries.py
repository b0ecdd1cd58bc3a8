"""The corpus operators as registered queries: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .html_main import main_text
from .language_model import language_model_scores
from .licenses import BLANK, CUT, EXCEPT, INSIDE, JOINED, LATER, MARK, NUMBER, RULES, SENTENCES, STOP, TAG, license_scan, most_words
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .packing import pack
from .quality import quality, train
from .token_counts import token_counts
from .warc import roundtrip
from .whitening import whiten

TOKENIZER = "byte_bpe_50k.json"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_token_counts, op3_warc, op4_decontaminate, op5_pack, op6_license_scan, op7_lm_score, op8_line_dedup, op9_exact_dedup, op10_quality_crf, op11_whitening, op12_html_extraction, op13_filter_audit)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op4_decontaminate": rf"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents
), i as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark
), iw as (
  select distinct item_id, len(v) n, array_to_string(v, ' ') v from (
    select item_id, list_slice(w, s, s + 9) v from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) s from i where len(w) > 0))
), dw as (
  select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') v from (
    select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from d, (select distinct n from iw) where len(w) >= n)
), h as (select doc_id, s, dw.n, item_id from dw join iw on dw.v = iw.v and dw.n = iw.n),
p as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(s, s + n)) q from h) group by 1),
t as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) names from h group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join p using (doc_id) left join t using (doc_id)
""",
    "op9_exact_dedup": f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) keep_id, count(*) over (partition by text_sha256) group_size,
  doc_id = max(doc_id) over (partition by text_sha256) kept, text_sha256 from d
""",
    "op13_filter_audit": r"""
with recursive letters(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
l as (select doc_id, max(cast(quality = 1 as int)) good, max(cast(toxic = 1 as int)) toxic from labels group by 1),
t as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from t),
d as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when w.doc_id > min(w.doc_id) over (partition by t) then 'E' else '' end failed
  from w left join l on w.doc_id = l.doc_id
), c as (select part, failed, count(*) n, sum(good) good, sum(toxic) toxic from d group by 1, 2),
o(filter_order) as (
  select f from letters union all select filter_order || f from o, letters where length(filter_order) < 5 and not contains(filter_order, f)
), s as (
  select filter_order, step, filter_order[step] f, substr(filter_order, 1, cast(step - 1 as int)) before
  from (select filter_order, unnest(range(1, 6)) step from o where length(filter_order) = 5)
), r as (
  select part, filter_order, cast(step as int) step, f,
    case when before <> '' and regexp_matches(failed, '[' || before || ']') then 1 else 0 end earlier, contains(failed, f) fails, failed = f only_this, n, good, toxic
  from s, c
), k as (
  select part, filter_order, step, f, cast(sum(n * cast(not fails and earlier = 0 as int)) as bigint) kept,
    cast(sum(n * cast(fails and earlier = 0 as int)) as bigint) removed, cast(sum(n * cast(fails and earlier = 1 as int)) as bigint) redundant,
    cast(sum(n * cast(only_this as int)) as bigint) unique_fails, cast(sum(good * cast(fails and earlier = 0 as int)) as bigint) good_lost,
    cast(sum(toxic * cast(fails and earlier = 0 as int)) as bigint) toxic_lost
  from r group by 1, 2, 3, 4
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, f) as bigint) shapley from k
""",
    "op6_license_scan": f"""
with known(sid, s) as (values {", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())}),
rules(ord, name, ids) as (values {", ".join(f"({i}, '{n}', {list(ids)})" for i, (n, ids) in enumerate(RULES))}),
u as (
  select doc_id, list_filter(flatten(list_transform(ls, lambda a: case when len(a) < 2 then a else coalesce(
    list_filter(list_transform(range(greatest(len(a) - {most_words(SENTENCES.values()) - 1}, 1), len(a)), lambda i: case when list_contains({list(SENTENCES.values())}, array_to_string(a[i:], ' ')) then list_append(a[:i - 1], array_to_string(a[i:], ' ')) end), lambda x: x is not null)[1], a) end)), lambda x: not regexp_matches(x, '{NUMBER}')) s
  from (select doc_id, list_transform(string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{BLANK}', '{CUT}', 'g'), '{STOP}', '\\1{CUT}', 'g'), '{CUT}'),
    lambda p: list_filter(list_transform(string_split(p, chr(10)), lambda q: trim(regexp_replace(q, '[^a-z0-9]+', ' ', 'g'))), lambda q: q <> '')) ls from documents)
), d as (
  select doc_id, flatten(list_transform(s, lambda x: case when list_contains({list(SENTENCES.values())}, x) then [x]
    when starts_with(x, '{TAG}') then list_transform(string_split_regex(replace(substr(x, {len(TAG) + 1}), '{LATER}', '{MARK}'), '{JOINED}'), lambda y: '{TAG}' || regexp_replace(replace(y, '{MARK}', '{LATER}'), '{EXCEPT}', ''))
    when regexp_matches(x, '{INSIDE}') then regexp_extract_all(x, '{INSIDE}') else [x] end)) s from u
), e as (select doc_id, pos, sid from (select doc_id, unnest(s) s, unnest(range(len(s))) pos from d) join known using (s)),
m as (
  select e.doc_id, e.pos st, e.pos + len(ids) en, ord, name from e join rules on ids[1] = sid
  where (select count(*) from e f where f.doc_id = e.doc_id and f.pos >= e.pos and f.pos < e.pos + len(ids) and f.sid = ids[f.pos - e.pos + 1]) = len(ids)
), k as (select * from m where not exists (select 1 from m n where n.doc_id = m.doc_id and n.ord < m.ord and n.st < m.en and m.st < n.en)),
g as (select doc_id, count(*) n, string_agg(distinct name, ',' order by name) names from k group by 1)
select d.doc_id, len(d.s) n_sentences, (select count(*) from e where e.doc_id = d.doc_id) n_known, coalesce(g.n, 0) n_matches, coalesce(names, '') licenses
from d left join g using (doc_id)
""",
}
