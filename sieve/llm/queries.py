"""The registered queries opN_<name>, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import os


def tokenizer(name: str) -> str:
    """Place of a public vocabulary; SIEVE_TOKENIZERS names another folder than the installed package's."""
    folder = os.environ.get("SIEVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark, sf_dir):
    from .ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op2_decontaminate(spark, sf_dir):
    from .decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op3_html_extract(spark, sf_dir):
    from .html_extract import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import removed_bytes

    return removed_bytes(_table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_quality_classifier(spark, sf_dir):
    from .quality_classifier import classify, fit

    docs = _table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op7_token_files(spark, sf_dir):
    from .token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_url_filter(spark, sf_dir):
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark, sf_dir):
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_token_counts(spark, sf_dir):
    from .token_counts import count_sections

    return count_sections(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_decontaminate, op3_html_extract, op4_suffix_dedup, op5_bpe, op6_quality_classifier, op7_token_files, op8_url_filter, op9_quality_rules, op10_token_counts)}

ORACLE_SQL = {
    "op1_ngram_join": r"""
with recursive low as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
shingles as (
  select distinct doc_id, case when len(w) >= 4 then array_to_string(w[i : i + 3], ' ') else array_to_string(w, ' ') end g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) i from low)),
sizes as (select doc_id, count(*) n from shingles group by 1),
pairs as (select a.doc_id a, b.doc_id b, count(*) c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select a, b from edges union select r.doc_id, e.b from reach r join edges e on e.a = r.other),
least_ as (select doc_id, min(other) other from reach group by 1),
sets as (select doc_id, sha256(string_agg(g, chr(10) order by g)) h from shingles group by 1),
classes as (select doc_id, min(doc_id) over (partition by h) class_id from sets)
select d.doc_id, coalesce(s.n, 0) n_shingles, coalesce(c.class_id, d.doc_id) class_id, least(d.doc_id, coalesce(l.other, d.doc_id)) component_id
from documents d left join sizes s using (doc_id) left join classes c using (doc_id) left join least_ l using (doc_id)""",
    "op4_suffix_dedup": r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n_bytes from documents),
starts as (select doc_id, i, substr(h, 2 * i + 1, 200) s from (select doc_id, h, unnest(range(0, n_bytes - 99)) i from b)),
later as (select doc_id, i from starts qualify row_number() over (partition by s order by doc_id, i) > 1),
marked as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end opens from later),
runs as (select doc_id, run, min(i) lo, max(i) + 100 hi from (select doc_id, i, sum(opens) over (partition by doc_id order by i) run from marked) group by 1, 2),
counts as (select doc_id, sum(hi - lo) n_removed, count(*) n_spans, max(hi) last_ from runs group by 1),
gaps as (select doc_id, lo, coalesce(lag(hi) over (partition by doc_id order by lo), 0) from_ from runs),
pieces as (select doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (lo - from_)), '' order by lo) k from gaps join b using (doc_id) group by 1)
select b.doc_id, n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last_, 0) + 1))) kept_sha256
from b left join counts using (doc_id) left join pieces using (doc_id)""",
    "op2_decontaminate": r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') w from documents),
items as (
  select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') w from benchmark),
grams as (
  select distinct item, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from items where len(w) > 0)),
sizes as (select distinct n from grams),
spots as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from words, sizes where len(w) >= n)),
found as (select s.doc_id, s.n, s.i, g.item from spots s join grams g on s.g = g.g and s.n = g.n),
hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from found) group by 1),
named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from found) group by 1)
select w.doc_id, cast(len(w.w) as bigint) n_words, coalesce(h.n_hit, 0) n_hit, coalesce(n.n_items, 0) n_items,
  sha256(coalesce(n.items, '')) items_sha256, coalesce(h.n_hit, 0) > 0 contaminated
from words w left join hits h using (doc_id) left join named n using (doc_id)""",
    "op8_url_filter": r"""
with parts as (
  select page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') h, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path from pages),
low as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from parts),
rules(verdict, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit as (
  select page_id, arg_max(rh || rp, length(rh || rp)) rule, arg_max(verdict, length(rh || rp)) verdict
  from low join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1)
select l.page_id, l.host, l.path, f.rule, coalesce(f.verdict, 'allow') verdict from low l left join fit f using (page_id)""",
}
