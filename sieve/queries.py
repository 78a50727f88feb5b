"""Registered queries of the selection library, each with the DuckDB SQL of its definition where SQL can express it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .functions import responses, vectors
from .functions import text as T
from .functions.hashing import budget
from .operators import annotate, clusters, greedy, joins, metrics, profile, quota, scale, scores, selectors, topk
from .plans import pipeline
from .sources import shared, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# ---- SQL shared by oracles --------------------------------------------------------------------

_TOKENS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"
_CORPUS = f"""corpus as (select doc_id id, text, case doc_id % 10 when 0 then 'validation' when 1 then 'test' else 'train' end split, {_TOKENS} w from documents)"""
_LABELLED = f"""{_CORPUS}, labelled as (select c.*, l.quality label from corpus c join labels l on l.doc_id = c.id)"""
_VOWELS = "[aeiouyáéíóúàèìòùâêîôûäëïöü]+"
_COUNTS = f"""counts as (select len(w) words, len(regexp_extract_all(lower(text), '{_VOWELS}')) syll, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) sents, * from corpus)"""
_KEY = "md5('42:' || cast(id as varchar))"
_UNI = """
words as (select id, unnest(w) token from {src}),
vocab as (select token, count(*) n from words group by 1),
size as (select sum(n) total, count(*) types from vocab),
ppl as (select id, exp(-avg(ln((n + 1) / cast(total + types as double)))) pppl from words join vocab using (token), size group by 1)"""
_NB = """
tok as (select label, unnest(w) token from {train}),
nb as (select token, count(*) filter (label = 1) n1, count(*) filter (label = 0) n0 from tok group by 1),
sums as (select sum(n1) s1, sum(n0) s0, count(*) types from nb),
prior as (select ln((count(*) filter (label = 1) + 1) / cast(count(*) filter (label = 0) + 1 as double)) pr from {train}),
own as (select id, unnest(w) token from {src}),
llr as (select id, avg(ln((coalesce(n1, 0) + 1) / cast(s1 + types as double)) - ln((coalesce(n0, 0) + 1) / cast(s0 + types as double))) r, count(*) n from own left join nb using (token), sums group by 1),
prob as (select id, 1 / (1 + exp(-coalesce(r + pr / n, pr))) p1 from {src} left join llr using (id), prior)"""
_ENT = "greatest(0, -(p1 * ln(p1 + 1e-12) + (1 - p1) * ln(1 - p1 + 1e-12)))"
_WP = """
words as (select id, unnest(w) token from {src}),
common as (select token from words group by 1 order by count(*) desc, token limit 2000),
wp as (select s.id, coalesce(least(sum(case when c.token is not null then 1 else ceil(length(x.token) / 4.0) end) + 2, 512) / cast(count(x.token) as double), 0) wp_ratio
  from {src} s left join words x using (id) left join common c on c.token = x.token group by 1)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rounded(df, *cols, places: int = 6):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), places) + 0.0)
    return df


def _summary_sql(col: str) -> str:
    parts = [f"min({col}) {col}_min", f"max({col}) {col}_max", f"round(avg({col}), 6) {col}_mean", f"round(stddev_samp({col}), 6) {col}_std"]
    parts += [f"round(quantile_cont({col}, {q}), 6) {col}_{n}" for n, q in profile.QUANTILES.items()]
    return ", ".join(parts)


_STATS = [f"{c}_{s}" for c in ("char_len", "word_len") for s in ("mean", "std", *profile.QUANTILES)]
_LENGTHS = "select id, text, split, length(text) char_len, len(w) word_len, w from corpus"

# ---- profile ----------------------------------------------------------------------------------


@query(f"with {_CORPUS}, l as ({_LENGTHS}) select count(*) n_examples, {_summary_sql('char_len')}, {_summary_sql('word_len')} from l")
def profile_lengths(spark, sf_dir):
    return _rounded(profile.lengths(tables.documents(spark, sf_dir)), *_STATS)


@query(
    f"with {_CORPUS}, l as ({_LENGTHS}), t as (select split, unnest(w) token from l), "
    "v as (select coalesce(split, 'overall') split, count(distinct token) vocab_size from t group by rollup (split)), "
    f"s as (select coalesce(split, 'overall') split, count(*) n_examples, {_summary_sql('char_len')}, {_summary_sql('word_len')} from l group by rollup (split)) select * from s left join v using (split)"
)
def profile_by_split_rollup(spark, sf_dir):
    return _rounded(profile.by_split(tables.documents(spark, sf_dir)), *_STATS)


@query("select quality label, count(*) n, round(count(*) / cast(sum(count(*)) over () as double), 9) frac from documents left join labels using (doc_id) group by 1")
def label_balance(spark, sf_dir):
    df = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left").withColumnRenamed("quality", "label")
    return _rounded(profile.label_balance(df), "frac", places=9)


@query(f"with {_CORPUS}, t as (select unnest(w) token from corpus) select count(*) n_tokens, count(distinct token) vocab_size from t")
def vocab_size(spark, sf_dir):
    return profile.vocabulary_size(tables.documents(spark, sf_dir))


@query(f"with {_CORPUS}, t as (select unnest(w) token from corpus) select token, count(*) n from t group by 1 order by n desc, token limit 30")
def top_tokens_30(spark, sf_dir):
    return profile.top_tokens(tables.documents(spark, sf_dir))


@query(f"""with {_CORPUS}, l as (select len(w) x from corpus), b as (select min(x) lo, max(x) hi from l),
h as (select least(cast(floor((x - lo) / ((hi - lo) / 40.0)) as int) + 1, 40) bin, count(*) n from l, b group by 1)
select cast(i as int) bin, round(lo + (i - 1) * (hi - lo) / 40.0, 6) lo, round(lo + i * (hi - lo) / 40.0, 6) hi, coalesce(n, 0) n from (select unnest(range(1, 41)) i) left join h on bin = i, b""")
def length_histogram_40(spark, sf_dir):
    return _rounded(profile.histogram(profile.with_lengths(tables.documents(spark, sf_dir)), "word_len"), "lo", "hi")


@query(f"""with {_LABELLED}, x as (select label, len(w) v from labelled),
q as (select label, count(*) n, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) median, quantile_cont(v, 0.75) q3 from x group by 1)
select q.label, n, q1, median, q3, min(v) whisker_low, max(v) whisker_high from q join x on x.label = q.label and v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all""")
def length_boxplot_by_label(spark, sf_dir):
    return profile.boxplot(profile.with_lengths(tables.labelled(spark, sf_dir)), "word_len")


@query(f"""with {_CORPUS}, l as (select split, len(w) v, quality from corpus left join labels on doc_id = id),
e as (select * from l union all select 'overall', v, quality from l)
select split, count(*) n_examples, round(nullif(count(*) filter (quality = 0), 0) / cast(count(*) as double), 9) label_frac_0,
round(nullif(count(*) filter (quality = 1), 0) / cast(count(*) as double), 9) label_frac_1, round(avg(v), 6) word_len_mean from e group by 1""")
def summary_table_ragged(spark, sf_dir):
    labels = tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = profile.summary_table(tables.documents(spark, sf_dir).join(labels, "id", "left"), [0, 1])
    return _rounded(_rounded(out, "label_frac_0", "label_frac_1", places=9), "word_len_mean")


@query(f"""with {_LABELLED}, k as (select greatest(1, cast(floor(count(*) * cast(0.1 as double)) as bigint)) k from labelled),
r as (select *, row_number() over (order by {_KEY}, id) rn from labelled)
select count(*) n, count(*) filter (label = 1) n_1, count(*) filter (label = 0) n_0, round(avg(len(w)), 6) avg_words from r, k where rn <= k""")
def subset_stats(spark, sf_dir):
    df = tables.labelled(spark, sf_dir)
    return _rounded(profile.subset_stats(selectors.random(df, budget(df.count(), 0.1))), "avg_words")


# ---- text -------------------------------------------------------------------------------------


@query(f"""with {_CORPUS}, {_COUNTS}
select id, cast(words as double) token_count, cast(length(text) as double) char_count, case when words < 25 then 0 else round(list_unique(w) / cast(words as double), 6) end type_token_ratio,
round(list_sum(list_transform(w, lambda x: length(x))) / cast(greatest(words, 1) as double), 6) avg_word_len,
round(206.835 - cast(1.015 as double) * (words / cast(sents as double)) - cast(84.6 as double) * (syll / cast(greatest(words, 1) as double)), 6) flesch_reading_ease, cast(syll as int) syllable_count, cast(sents as int) sentence_count from counts""")
def text_metrics(spark, sf_dir):
    out = T.text_metrics(tables.documents(spark, sf_dir), "id", "text").drop("mtld", "mattr")
    return _rounded(out, "type_token_ratio", "avg_word_len", "flesch_reading_ease")


@query(f"""with {_CORPUS}, t as (select id, len(w) n, unnest(w) token, generate_subscripts(w, 1) i from corpus where len(w) >= 25),
p as (select id, n, i, coalesce(lag(i) over (partition by id, token order by i), 0) prev from t),
m as (select id, sum(greatest(least(i, n - 24) - greatest(prev + 1, i - 24, 1) + 1, 0)) / (25.0 * max(n - 24)) mattr from p group by 1)
select c.id, case when len(w) < 2 then 0 else round(list_unique(w) / cast(len(w) as double), 6) end ttr, round(coalesce(mattr, 0), 6) mattr from corpus c left join m using (id)""")
def ttr_mattr(spark, sf_dir):
    t = F.col("text")
    return _rounded(tables.documents(spark, sf_dir).select("id", T.ttr(t).alias("ttr"), T.mattr(25)(t).alias("mattr")), "ttr", "mattr")


@query(f"""with {_CORPUS}, {_COUNTS}, r as (select words / cast(sents as double) a, syll / cast(greatest(words, 1) as double) b, len(list_filter(w, lambda x: len(regexp_extract_all(lower(x), '{_VOWELS}')) >= 3)) poly, sents from counts)
select count(*) n, round(avg(206.835 - cast(1.015 as double) * a - cast(84.6 as double) * b), 6) flesch_reading_ease, round(avg(cast(1.043 as double) * sqrt(poly * 30 / cast(sents as double)) + cast(3.1291 as double)), 6) smog_index,
round(avg(cast(0.39 as double) * a + cast(11.8 as double) * b - cast(15.59 as double)), 6) flesch_kincaid_grade from r""")
def readability(spark, sf_dir):
    return _rounded(profile.readability_means(tables.documents(spark, sf_dir)), "flesch_reading_ease", "smog_index", "flesch_kincaid_grade")


@query(
    f"""with recursive {_CORPUS}, both_ways as (select id, 0 dir, w from corpus union all select id, 1, list_reverse(w) from corpus),
tok as (select id, dir, unnest(w) token, unnest(range(1, len(w) + 1)) pos from both_ways),
earlier as (select id, dir, list(coalesce(last, 0) order by pos) before, count(*) n from (select id, dir, pos, lag(pos) over (partition by id, dir, token order by pos) last from tok) group by id, dir),
fold(id, dir, n, pos, start, types, factors) as (
  select id, dir, n, 0::bigint, 1::bigint, 0::bigint, 0::bigint from earlier
  union all
  select id, dir, n, pos, case when full_ then pos + 1 else start end, case when full_ then 0 else types end, factors + cast(full_ as int)
  from (select *, types / cast(pos - start + 1 as double) <= cast(0.72 as double) full_
    from (select id, dir, f.n, pos + 1 pos, start, types + cast(before[pos + 1] < start as int) types, factors from fold f join earlier using (id, dir) where pos < f.n))),
ways as (select id, n, factors + case when start <= n then (1 - types / cast(n - start + 1 as double)) / (1 - cast(0.72 as double)) else 0 end f from fold where pos = n),
m as (select id, avg(case when f > 0 then n / f else n end) mtld from ways where n > 1 group by id)
select corpus.id, round(coalesce(mtld, 0), 6) mtld from corpus left join m using (id)"""
)
def mtld(spark, sf_dir):
    return _rounded(tables.documents(spark, sf_dir).select("id", T.mtld()(F.col("text")).alias("mtld")), "mtld")


# ---- scores -----------------------------------------------------------------------------------


@query(f"with {_CORPUS}, {_WP.format(src='corpus')} select id, round(wp_ratio, 6) wp_ratio from wp")
def wordpiece_ratio(spark, sf_dir):
    return _rounded(scores.wordpiece_ratio(tables.documents(spark, sf_dir)), "wp_ratio")


@query(f"with {_CORPUS}, {_UNI.format(src='corpus')} select c.id, round(pppl, 4) pppl from corpus c left join ppl using (id)")
def lm_perplexity(spark, sf_dir):
    return _rounded(scores.unigram_perplexity(tables.documents(spark, sf_dir)), "pppl", places=4)


def _probabilities(spark, sf_dir):
    df = tables.labelled(spark, sf_dir)
    return df, scores.naive_bayes(df, df)


@query(f"with {_LABELLED}, {_NB.format(train='labelled', src='labelled')} select id, round(1 - p1, 6) p0, round(p1, 6) p1 from prob")
def nb_probabilities(spark, sf_dir):
    return _rounded(_probabilities(spark, sf_dir)[1].select("id", (1 - F.col("p1")).alias("p0"), "p1"), "p0", "p1")


@query(f"with {_LABELLED}, {_NB.format(train='labelled', src='labelled')} select id, round({_ENT}, 6) + 0 entropy from prob")
def predictive_entropy(spark, sf_dir):
    return _rounded(_probabilities(spark, sf_dir)[1].select("id", scores.binary_entropy().alias("entropy")), "entropy")


def _el2n_sql() -> str:
    parts, names = [], []
    for t in range(1, 5):
        nb = _NB.format(train=f"tr{t}", src="labelled")
        for name in ("tok", "nb", "sums", "prior", "own", "llr", "prob"):
            nb = re.sub(rf"\b{name}\b", f"{name}{t}", nb)
        parts.append(f"tr{t} as (select * from marked where fold < {t}),{nb}")
        names.append(f"select id, sqrt(2) * abs(label - p1) e from prob{t} join labelled using (id)")
    fold = f"cast(floor(cast(('0x' || substr({_KEY}, 1, 8)) as bigint) / 1073741824.0) as int)"
    return f"{_LABELLED}, marked as (select *, {fold} fold from labelled), {', '.join(parts)}, el as (select id, avg(e) el2n from ({' union all '.join(names)}) group by 1)"


@query(f"with {_el2n_sql()} select id, round(el2n, 6) el2n from el")
def el2n_scores(spark, sf_dir):
    return _rounded(scores.el2n_scores(tables.labelled(spark, sf_dir)), "el2n")


@query("""with e as (select vec_id id, list_transform(embedding, lambda x: exp(cast(x as double) - cast(list_max(embedding) as double))) z, embedding v from embeddings)
select id, round(list_max(z) / list_sum(z), 6) p_max, cast(list_position(v, list_max(v)) - 1 as int) pred from e""")
def softmax_argmax(spark, sf_dir):
    p = vectors.softmax(F.col("v"))
    return _rounded(tables.vectors(spark, sf_dir).select("id", F.array_max(p).alias("p_max"), vectors.argmax(F.col("v")).alias("pred")), "p_max")


# ---- scaling, bands, quotas, top-k -------------------------------------------------------------


@query(f"with {_CORPUS}, x as (select id, len(w) v from corpus), b as (select min(v) lo, max(v) hi from x) select id, round((v - lo) / cast(hi - lo as double), 6) scaled from x, b")
def minmax_scale(spark, sf_dir):
    df = profile.with_lengths(tables.documents(spark, sf_dir)).select("id", "word_len")
    return _rounded(scale.minmax(df, scaled="word_len"), "scaled").select("id", "scaled")


@query(f"with {_CORPUS}, x as (select id, len(w) word_len from corpus), b as (select quantile_cont(word_len, 0.2) lo, quantile_cont(word_len, 0.8) hi from x) select id, word_len from x, b where word_len between lo and hi")
def quantile_band(spark, sf_dir):
    df = profile.with_lengths(tables.documents(spark, sf_dir)).select("id", "word_len")
    return scale.quantile_band(df, "word_len", 0.2, 0.8)


@query(f"with {_CORPUS}, x as (select id, len(w) word_len from corpus), b as (select quantile_cont(word_len, 0.1) lo from x) select id, word_len from x, b where word_len >= lo")
def quantile_floor(spark, sf_dir):
    df = profile.with_lengths(tables.documents(spark, sf_dir)).select("id", "word_len")
    return scale.quantile_floor(df, "word_len", 0.1)


_K10 = "greatest(1, cast(floor(count(*) * cast(0.1 as double)) as bigint))"


@query(f"""with n as (select label, count(*) n from embeddings group by 1), k as (select {_K10} k from embeddings), c as (select count(*) c from n),
r as (select *, row_number() over (order by label) rn from n) select label, n, k // c + case when rn <= k % c then 1 else 0 end quota from r, k, c""")
def quota_equal(spark, sf_dir):
    df = tables.vectors(spark, sf_dir)
    return quota.equal_quota(quota.group_counts(df, "label"), "label", budget(df.count(), 0.1)).withColumnRenamed("_quota", "quota")


_LR = """, n as (select {g} g, count(*) n from {src} group by 1), raw as (select g, n, k * n / cast(sum(n) over () as double) x from n, k),
base as (select *, cast(floor(x) as bigint) b, row_number() over (order by round(x - floor(x), 9) desc, g) rk from raw),
quota as (select g, n, b + case when rk <= (select max(k) - sum(b) from base, k) then 1 else 0 end quota from base)"""


@query(f"with k as (select {_K10} k from embeddings){_LR.format(g='label', src='embeddings')} select g label, n, quota from quota")
def quota_largest_remainder(spark, sf_dir):
    df = tables.vectors(spark, sf_dir)
    return quota.largest_remainder_quota(quota.group_counts(df, "label"), "label", budget(df.count(), 0.1)).withColumnRenamed("_quota", "quota")


_SHARE = f"""k as (select {_K10} k from embeddings), n as (select label, count(*) n from embeddings group by 1),
want as (select *, least(n, greatest(1, cast(round_even(round(k * n / cast(sum(n) over () as double), 9), 0) as bigint))) want from n, k),
quota as (select label, n, greatest(0, least(want, k - coalesce(sum(want) over (order by label rows between unbounded preceding and 1 preceding), 0))) quota from want)"""


@query(f"with {_SHARE} select label, n, cast(quota as bigint) quota from quota")
def quota_kmeans_share(spark, sf_dir):
    df = tables.vectors(spark, sf_dir)
    return quota.share_quota(quota.group_counts(df, "label"), "label", budget(df.count(), 0.1)).withColumnRenamed("_quota", "quota")


@query(f"with {_CORPUS}, x as (select id, len(w) word_len from corpus) select * from x order by word_len desc, id limit (select {_K10} from x)")
def topk_global(spark, sf_dir):
    df = profile.with_lengths(tables.documents(spark, sf_dir)).select("id", "word_len")
    return topk.top_k(df, budget(df.count(), 0.1), F.col("word_len"), ["id"])


@query(f"with {_CORPUS}, x as (select id, split, len(w) word_len from corpus) select * from x qualify row_number() over (partition by split order by word_len desc, id) <= 7")
def topk_per_group(spark, sf_dir):
    df = profile.with_lengths(tables.documents(spark, sf_dir)).select("id", "split", "word_len")
    quotas = quota.group_counts(df, "split").select("split", F.lit(7).cast("long").alias("_quota"))
    return topk.top_per_group(df, "split", quotas, F.col("word_len"), ["id"]).select("id", "split", "word_len")


def _topup_sql(source: str, quotas: str, score: str, extra: str = "") -> str:
    """Two stages: quotas first, then the best of the rest until k."""
    return f"""{source}, {quotas},
first_ as (select r.* from (select *, row_number() over (partition by label order by {score} desc nulls last, id) rn from scored) r join quota on g = label where rn <= quota),
rest as (select *, row_number() over (order by {score} desc nulls last, id) rn2 from scored where id not in (select id from first_)),
chosen as (select id, label, {score} from first_ union all select id, label, {score} from rest where rn2 <= (select max(k) from k) - (select count(*) from first_)) select id, label{extra} from chosen"""


_EQ = """n as (select label g, count(*) n from scored group by 1), c as (select count(*) c from n),
quota as (select g, k // c + case when row_number() over (order by g) <= k % c then 1 else 0 end quota from n, c, k)"""
_K30 = "k as (select greatest(1, cast(floor(count(*) * cast(0.3 as double)) as bigint)) k from scored)"


@query(_topup_sql(f"with {_LABELLED}, scored as (select id, label, len(w) word_len from labelled), {_K30}", _EQ, "word_len", ", word_len"))
def topk_quota_topup(spark, sf_dir):
    df = profile.with_lengths(tables.labelled(spark, sf_dir)).select("id", "label", "word_len")
    k = budget(df.count(), 0.3)
    return quota.quota_then_best(df, "label", quota.equal_quota(quota.group_counts(df, "label"), "label", k), k, F.col("word_len"), ["id"]).select("id", "label", "word_len")


# ---- selection --------------------------------------------------------------------------------


@query(f"with {_CORPUS} select id, split from corpus order by {_KEY}, id limit (select {_K10} from corpus)")
def sel_random(spark, sf_dir):
    df = tables.documents(spark, sf_dir).select("id", "split")
    return selectors.select("random", df, budget(df.count(), 0.1))


@query(f"with {_CORPUS} select id, split from corpus")
def sel_full(spark, sf_dir):
    return selectors.select("full", tables.documents(spark, sf_dir).select("id", "split"), 1)


_ENTROPY = f"with {_LABELLED}, {_NB.format(train='labelled', src='labelled')}, scored as (select id, label, round({_ENT}, 9) s from prob join labelled using (id))"
_WPR = f"with {_CORPUS}, {_WP.format(src='corpus')}, scored as (select id, round(wp_ratio, 9) s from wp)"
_BAND = f", b as (select quantile_cont(s, 0.2) lo, quantile_cont(s, 0.8) hi from scored) select id from scored, b where s between lo and hi order by {_KEY}, id limit (select {_K10} from scored)"


def _entropy(spark, sf_dir):
    df, p = _probabilities(spark, sf_dir)
    return shared.settled(df.join(p, "id").select("id", "label", F.round(scores.binary_entropy(), 9).alias("entropy")))


def _entropy_selection(keep):
    def run(spark, sf_dir):
        df = _entropy(spark, sf_dir)
        return selectors.select("predictive_entropy", df, budget(df.count(), 0.1), keep=keep).select("id")

    run.__name__ = f"sel_entropy_{keep}"
    return run


def _wordpiece_selection(keep):
    def run(spark, sf_dir):
        df = shared.settled(scores.wordpiece_ratio(tables.documents(spark, sf_dir)).withColumn("wp_ratio", F.round("wp_ratio", 9)))
        return selectors.select("wordpiece_ratio", df, budget(df.count(), 0.1), keep=keep).select("id")

    run.__name__ = f"sel_wordpiece_{keep}"
    return run


for _make, _source in ((_entropy_selection, _ENTROPY), (_wordpiece_selection, _WPR)):
    query(f"{_source} select id from scored order by s desc, id limit (select {_K10} from scored)")(_make("high"))
    query(f"{_source} select id from scored order by s, id limit (select {_K10} from scored)")(_make("low"))
    query(_source + _BAND)(_make("middle"))


_PPL = f"with {_CORPUS}, {_UNI.format(src='corpus')}, scored as (select c.id, round(pppl, 6) pppl, len(w) n, case when len(w) < 25 then 0 else list_unique(w) / cast(len(w) as double) end t from corpus c left join ppl using (id)), k as (select {_K10} k from scored), b as (select quantile_cont(pppl, 0.3) lo, quantile_cont(pppl, 0.7) hi from scored), band as (select s.* from scored s, b where pppl between lo and hi)"


def _perplexity_rows(spark, sf_dir):
    df = tables.documents(spark, sf_dir)
    t = F.col("text")
    metrics_ = df.select("id", T.word_len(t).alias("token_count"), F.when(T.word_len(t) < 25, 0.0).otherwise(T.ttr(t)).alias("type_token_ratio"), T.flesch_reading_ease(t).alias("flesch_reading_ease"))
    return shared.settled(joins.with_features(scores.unigram_perplexity(df).withColumn("pppl", F.round("pppl", 6)), metrics_))


@query(f"""{_PPL}, m as (select min(-n) ln, max(-n) hn, min(t) lt, max(t) ht from band)
select id from band, m order by round(cast(0.2 as double) * (-n - ln) / cast(hn - ln as double) + cast(0.2 as double) * (t - lt) / (ht - lt), 12) desc, id limit (select k from k)""")
def sel_perplexity(spark, sf_dir):
    df = _perplexity_rows(spark, sf_dir)
    return selectors.select("perplexity", df, budget(df.count(), 0.1)).select("id")


@query(f"{_PPL} select id from band order by id limit (select k from k)")
def sel_perplexity_no_quality(spark, sf_dir):
    df = _perplexity_rows(spark, sf_dir)
    return selectors.select("perplexity", df, budget(df.count(), 0.1), use_quality=False).select("id")


@query(f"with {_el2n_sql()}, scored as (select id, round(el2n, 9) s from el) select id from scored order by s desc, id limit (select {_K10} from scored)")
def sel_datadiet(spark, sf_dir):
    df = shared.settled(scores.el2n_scores(tables.labelled(spark, sf_dir)).withColumn("el2n", F.round("el2n", 9)))
    return selectors.select("datadiet", df, budget(df.count(), 0.1)).select("id")


_CLEAR = f"with {_LABELLED}, {_NB.format(train='labelled', src='labelled')}, scored as (select id, label, round(p1, 9) s from prob join labelled using (id)), {_K30}"


def _clear(spark, sf_dir):
    df, p = _probabilities(spark, sf_dir)
    return shared.settled(joins.aligned(df, p).select("id", "label", F.round("p1", 9).alias("p_clear")))


@query(_topup_sql(_CLEAR, _EQ, "s"))
def sel_llm_quality(spark, sf_dir):
    df = _clear(spark, sf_dir)
    return selectors.select("llm_quality", df, budget(df.count(), 0.3)).select("id", "label")


@query(_topup_sql(f"with {_LABELLED}, {_NB.format(train='labelled', src='labelled')}, scored as (select id, label, round(p1, 9) s from prob join labelled using (id)), k as (select greatest(1, cast(round_even(count(*) * cast(0.1 as double), 0) as bigint)) k from scored)", _LR.format(g="label", src="scored").removeprefix(", "), "s"))
def sel_stratified_topk(spark, sf_dir):
    return selectors.stratified_frac(_clear(spark, sf_dir), 0.1, "p_clear").select("id", "label")


_KCENTER = """with recursive e as (select vec_id id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
go(step, pick, near) as (
  select 0, 0::bigint, (select list({{'id': e.id, 'v': e.v, 'd': case when e.id = 0 then -1 else list_distance(e.v, s.v) end}} order by e.id) from e, (select v from e where id = 0) s)
  union all
  select step + 1, best.id, list_transform(near, lambda x: {{'id': x.id, 'v': x.v, 'd': case when x.d < 0 or x.id = best.id then -1 else least(x.d, list_distance(x.v, best.v)) end}})
  from (select step, near, list_aggregate(list_filter(near, lambda x: x.d = list_max(list_transform(near, lambda y: y.d))), 'first') best from go where step < {k} - 1))
select pick id, cast(step as int) step from go"""


@query(_KCENTER.replace("{{", "{").replace("}}", "}").replace("{k}", "10"))
def sel_kcenter(spark, sf_dir):
    return greedy.k_center(tables.vectors(spark, sf_dir), 10, start_id=0).select("id", "step")


@query(ORACLE_SQL["sel_kcenter"])
def kcenter_distributed(spark, sf_dir):
    return greedy.k_center(tables.vectors(spark, sf_dir), 10, start_id=0, exact=8_000).select("id", "step")


@query("""with recursive e as (select vec_id id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings),
mean as (select list(m order by i) m from (select i, avg(x) m from (select unnest(v) x, generate_subscripts(v, 1) i from e) group by 1)),
every as (select list({'id': id, 'v': v} order by id) xs from e),
go(step, pick, left_, done) as (
  select 0, b.id, list_transform(list_zip(m, b.v), lambda z: z[1] - z[2]), [b.id] from (select m, list_reduce(list_transform(xs, lambda x: {'id': x.id, 'v': x.v, 's': round(list_dot_product(x.v, m), 12)}), lambda a, x: case when x.s > a.s then x else a end) b from mean, every)
  union all
  select step + 1, b.id, list_transform(list_zip(left_, b.v), lambda z: z[1] - z[2]), list_append(done, b.id)
  from (select step, left_, done, list_reduce(list_transform(list_filter(xs, lambda x: not list_contains(done, x.id)), lambda x: {'id': x.id, 'v': x.v, 's': round(list_dot_product(x.v, left_), 12)}), lambda a, x: case when x.s > a.s then x else a end) b from go, every where step < 9))
select pick id, cast(step as int) step from go""")
def sel_herding(spark, sf_dir):
    return greedy.herding(tables.vectors(spark, sf_dir), 10).select("id", "step")


_TENTH = f"(select {_K10} from embeddings)"


@query(_KCENTER.replace("{{", "{").replace("}}", "}").replace("{k}", _TENTH))
def sel_kcenter_tenth(spark, sf_dir):
    df = tables.vectors(spark, sf_dir)
    return greedy.k_center(df, budget(df.count(), 0.1), start_id=0).select("id", "step")


@query(ORACLE_SQL["sel_herding"].replace("step < 9", f"step < {_TENTH} - 1"))
def sel_herding_tenth(spark, sf_dir):
    df = tables.vectors(spark, sf_dir)
    return greedy.herding(df, budget(df.count(), 0.1)).select("id", "step")


@query(f"with {_SHARE}, r as (select vec_id id, label, row_number() over (partition by label order by md5('42:' || cast(vec_id as varchar)), vec_id) rn from embeddings) select id, label from r join quota using (label) where rn <= quota")
def sel_kmeans_given_clusters(spark, sf_dir):
    df = tables.vectors(spark, sf_dir).select("id", "label")
    return selectors.select("kmeans", df, budget(df.count(), 0.1), cluster="label").select("id", "label")


def _hybrid_rows(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    both = docs.join(tables.vectors(spark, sf_dir).select("id", "label", "v"), "id")
    ppl = scores.unigram_perplexity(docs).withColumn("pppl", F.round("pppl", 6))
    both = both.join(ppl, "id").withColumn("flesch_reading_ease", T.flesch_reading_ease(F.col("text"))).withColumn("cluster", F.col("label"))
    return both.drop("split")


_MM = "coalesce(({x} - min({x}) over ()) / nullif(max({x}) over () - min({x}) over (), 0), 0)"


@query(
    _topup_sql(
        f"""with {_CORPUS}, {_COUNTS}, {_UNI.format(src="corpus")},
rows_ as (select c.id, e.label, ln(1 + round(pppl, 6)) lp, case when words = 0 then 0 else 206.835 - cast(1.015 as double) * (words / cast(sents as double)) - cast(84.6 as double) * (syll / cast(greatest(words, 1) as double)) end fre from counts c join ppl p using (id) join embeddings e on e.vec_id = c.id),
a as (select *, abs(lp - (select quantile_cont(lp, 0.5) from rows_)) dev, 1.0 / count(*) over (partition by label) rare from rows_),
s1 as (select *, 0.7 * (1 - {_MM.format(x="lp")}) + 0.3 * {_MM.format(x="fre")} q0, 1 - {_MM.format(x="dev")} i, {_MM.format(x="cast(rare as double)")} d from a),
s2 as (select *, {_MM.format(x="q0")} q from s1), s3 as (select *, 0.4 * q + 0.4 * i + 0.2 * d z from s2),
s4 as (select id, label, round(q, 12) q, round({_MM.format(x="z")}, 12) s from s3), cut as (select quantile_cont(q, 0.1) c from s4),
k as (select {_K10} k from s4), scored as (select id, label, s from s4, cut where q >= c)""",
        _LR.format(g="label", src="scored").removeprefix(", "),
        "s",
    )
)
def sel_hybrid_given_clusters(spark, sf_dir):
    df = shared.settled(_hybrid_rows(spark, sf_dir).drop("text", "v"))
    return selectors.select("hybrid_qdi", df, budget(df.count(), 0.1)).select("id", "label")


@query(
    _topup_sql(
        f"""with {_LABELLED}, {_COUNTS}, {_UNI.format(src="corpus")}, {_NB.format(train="labelled", src="counts")},
rows_ as (select c.id, e.label, ln(1 + round(pppl, 6)) lp, round({_ENT}, 9) ent, case when c.words = 0 then 0 else 206.835 - cast(1.015 as double) * (c.words / cast(sents as double)) - cast(84.6 as double) * (syll / cast(greatest(c.words, 1) as double)) end fre
  from counts c join ppl p using (id) join embeddings e on e.vec_id = c.id join prob on prob.id = c.id),
a as (select *, 1.0 / count(*) over (partition by label) rare from rows_),
s1 as (select *, 0.7 * (1 - {_MM.format(x="lp")}) + 0.3 * {_MM.format(x="fre")} q0, {_MM.format(x="ent")} i, {_MM.format(x="cast(rare as double)")} d from a),
s2 as (select *, {_MM.format(x="q0")} q from s1), s3 as (select *, 0.4 * q + 0.4 * i + 0.2 * d z from s2),
s4 as (select id, label, round(q, 12) q, round({_MM.format(x="z")}, 12) s from s3), cut as (select quantile_cont(q, 0.1) c from s4),
k as (select {_K10} k from s4), scored as (select id, label, s from s4, cut where q >= c)""",
        _LR.format(g="label", src="scored").removeprefix(", "),
        "s",
    )
)
def sel_hybrid_entropy(spark, sf_dir):
    df = _hybrid_rows(spark, sf_dir)
    labels = tables.labelled(spark, sf_dir)
    p = scores.naive_bayes(labels, df.select("id", "text"))
    df = shared.settled(df.join(p.select("id", F.round(scores.binary_entropy(), 9).alias("entropy")), "id").drop("text", "v"))
    return selectors.select("hybrid_qdi", df, budget(df.count(), 0.1), importance="entropy").select("id", "label")


@query()
def sel_kmeans(spark, sf_dir):
    df = clusters.with_clusters(tables.vectors(spark, sf_dir), 16)
    return selectors.select("kmeans", df, budget(df.count(), 0.1)).select("id", "cluster")


@query()
def sel_hybrid_ml(spark, sf_dir):
    df = clusters.with_clusters(_hybrid_rows(spark, sf_dir).drop("cluster"), 16, max_points=50_000)
    return selectors.select("hybrid_qdi", df, budget(df.count(), 0.1)).select("id", "label", "cluster")


@query(f"with {_LABELLED}, k as (select greatest(1, cast(round_even(count(*) * cast(0.2 as double), 0) as bigint)) k from labelled){_LR.format(g='label', src='labelled')}, r as (select id, label, row_number() over (partition by label order by {_KEY}, id) rn from labelled) select id, label, case when rn <= quota then 'test' else 'train' end part from r join quota on g = label")
def stratified_split(spark, sf_dir):
    return selectors.stratified_split(tables.labelled(spark, sf_dir).select("id", "label"), 0.2)


@query(f"with {_LABELLED} select id, label, text from labelled qualify row_number() over (partition by label order by {_KEY}, id) <= 10")
def examples_per_class(spark, sf_dir):
    return selectors.examples_per_class(tables.labelled(spark, sf_dir).select("id", "label", "text"), 10).select("id", "label", "text")


# ---- vectors and edit distance -----------------------------------------------------------------


@query("select cast(i - 1 as int) pos, round(avg(x), 9) value from (select unnest(embedding) x, generate_subscripts(embedding, 1) i from embeddings) group by 1")
def vector_mean(spark, sf_dir):
    return _rounded(vectors.mean_vector(tables.vectors(spark, sf_dir), "v"), "value", places=9)


@query("select e.vec_id id, round(list_distance(list_transform(e.embedding, lambda x: cast(x as double)), list_transform(s.embedding, lambda x: cast(x as double))), 6) d from embeddings e, (select embedding from embeddings where vec_id = 0) s")
def l2_to_center(spark, sf_dir):
    df = tables.vectors(spark, sf_dir)
    center = df.where("id = 0").select(F.col("v").alias("c"))  # one row
    return _rounded(df.crossJoin(F.broadcast(center)).select("id", vectors.l2(F.col("v"), F.col("c")).alias("d")), "d")


_NAMES = "r as (select c_custkey id, c_mktsegment label, c_name t, row_number() over (partition by c_mktsegment order by md5('42:' || cast(c_custkey as varchar)), c_custkey) rn from customer)"


@query(f"with {_NAMES} select a.id, a.label, cast(min(levenshtein(a.t, b.t)) as int) min_lev_dist from r a join r b on a.label = b.label and b.rn <= 200 and a.id <> b.id group by 1, 2")
def lev_uniqueness(spark, sf_dir):
    return greedy.uniqueness(_names(spark, sf_dir))


def _names(spark, sf_dir):
    return tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("text"))


@query(f"""with {_NAMES}, u as (select a.id, a.label, min(levenshtein(a.t, b.t)) d from r a join r b on a.label = b.label and b.rn <= 200 and a.id <> b.id group by 1, 2),
k as (select label, greatest(1, cast(round_even(count(*) * cast(0.1 as double), 0) as bigint)) k from u group by 1)
select id, u.label, cast(d as int) min_lev_dist from u join k using (label) qualify row_number() over (partition by u.label order by d desc, id) <= k""")
def lev_unique_per_class(spark, sf_dir):
    found = greedy.uniqueness(_names(spark, sf_dir))
    quotas = quota.group_counts(found, "label").select("label", F.greatest(F.lit(1), F.bround(F.col("n") * 0.1, 0).cast("long")).alias("_quota"))
    return topk.top_per_group(found, "label", quotas, F.col("min_lev_dist"), ["id"]).select("id", "label", "min_lev_dist")


#: the distance function counts bytes, so letters beyond ASCII become one byte each
_LEV = "levenshtein({a}, {b}) / cast(greatest(length({a}), length({b}), 1) as double)"


@query(
    f"""with recursive one as (select string_agg(chr(cast(i as int)), '' order by i) bytes from range(1, 32) r(i) where i not in (9, 10, 13)),
e as (select item_id id, translate(coalesce(text, ''), 'ÄÇÈÉÊÑÖÜßàáâäçèéêëíîñóôöùúûü', bytes) t from benchmark, one), size as (select count(*) n, greatest(1, cast(round_even(0.1 * count(*), 0) as bigint)) k from e),
go(step, pick, near) as (
  select 0, s.id, (select list({{'id': e.id, 't': e.t, 'd': {_LEV.format(a='e.t', b='s.t')}}} order by e.id) from e) from (select id, t from e order by {_KEY}, id limit 1) s
  union all
  select step + 1, best.id, list_transform(near, lambda x: {{'id': x.id, 't': x.t, 'd': least(x.d, {_LEV.format(a='x.t', b='best.t')})}})
  from (select step, near, list_aggregate(list_filter(near, lambda x: x.d = list_max(list_transform(near, lambda y: y.d))), 'first') best from go, size where step < k - 1) where best.d > 0)
select pick id, cast(case when n <= k then -1 else step end as int) step from go, size"""
)
def lev_fps(spark, sf_dir):
    df = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return greedy.diverse_texts(df)


# ---- joins and sets ----------------------------------------------------------------------------


@query(f"with {_LABELLED}, {_NB.format(train='labelled', src='labelled')} select id, label, round(p1, 6) p1 from labelled join prob using (id)")
def score_align_join(spark, sf_dir):
    df, p = _probabilities(spark, sf_dir)
    return _rounded(joins.aligned(df.select("id", "label"), p), "p1").select("id", "label", "p1")


@query("select doc_id id, quality label, toxic from documents left join labels using (doc_id)")
def left_feature_join(spark, sf_dir):
    labels = tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic")
    return joins.with_features(tables.documents(spark, sf_dir).select("id"), labels)


@query(f"with {_CORPUS}, r as (select id, row_number() over (order by {_KEY}, id) rn from corpus) select id, rn <= (select {_K10} from corpus) selected from r")
def semi_overlay(spark, sf_dir):
    df = tables.documents(spark, sf_dir).select("id")
    return joins.overlay(df, selectors.random(df, budget(df.count(), 0.1)))


@query(f"with {_CORPUS}, r as (select id, row_number() over (order by {_KEY}, id) rn from corpus) select id from r where rn > (select {_K10} from corpus)")
def anti_remaining(spark, sf_dir):
    df = tables.documents(spark, sf_dir).select("id")
    return joins.remaining(df, selectors.random(df, budget(df.count(), 0.1)))


@query(f"with {_CORPUS} select split, count(*) n from corpus group by 1 union all select 'overall', count(*) from corpus")
def union_splits(spark, sf_dir):
    df = tables.documents(spark, sf_dir).select("id", "split")
    return df.unionByName(df.select("id", F.lit("overall").alias("split"))).groupBy("split").agg(F.count("*").alias("n"))


@query("select min(doc_id) id, arg_min(lang, doc_id) lang, text from documents group by text")
def dedup_first(spark, sf_dir):
    df = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return joins.dedup_first(df, "text")


# ---- judges ------------------------------------------------------------------------------------


@query(f"select doc_id id, '{responses.CLARITY_PROMPT}' || trim(text) || '\nAnswer: ' prompt from documents")
def llm_prompt(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("id", responses.prompt(F.col("text")).alias("prompt"))


@query("select conv_id, turn, coalesce(cast(nullif(regexp_extract(text, '[012]', 0), '') as int), 1) verdict from conversations")
def llm_parse_digit(spark, sf_dir):
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", responses.parse_digit(F.col("text")).alias("verdict"))


_ANSWERS = """case event_id % 5 when 0 then 'no object' when 1 then '{"quality": {"score": 1}}' else 'Sure: {"quality": {"score": ' || (event_id % 10) || ', "explanation": "q"}, "diversity": {"score": ' || (user_id % 7) || ', "explanation": "d"}, "importance": {"score": 3, "explanation": "' || event_type || '"}} done' end"""


@query(f"""with a as (select event_id id, {_ANSWERS} response from events), j as (select id, regexp_extract(response, '(?s)(\\{{.*\\}})', 1) b from a),
p as (select id, case when b = '' then null else json(b) end o from j), s as (select id, cast(o->>'$.quality.score' as int) q, cast(o->>'$.diversity.score' as int) d, cast(o->>'$.importance.score' as int) i, o->>'$.importance.explanation' e from p)
select id, case when q + d + i is not null then q end quality_score, case when q + d + i is not null then d end diversity_score, case when q + d + i is not null then i end importance_score, case when q + d + i is not null then e else '' end importance_expl from s""")
def llm_parse_json(spark, sf_dir):
    answers = tables.table(spark, sf_dir, "events").selectExpr("event_id as id", f"{_ANSWERS} as response")
    out = annotate.annotations(answers.select("id"), answers)
    return out.select("id", "quality_score", "diversity_score", "importance_score", "importance_expl")


@query()
def student_clarity(spark, sf_dir):
    df = tables.vectors(spark, sf_dir)
    taught = selectors.examples_per_class(df, 20).select("id", (F.col("label") % 3).alias("verdict"))
    return _rounded(clusters.student(df, taught), "p0", "p1", "p2")


def _length_judge():
    """Stands in for a judge model: its verdict is the prompt's length modulo 3."""
    return lambda prompts: [f"Answer: {len(p) % 3}" for p in prompts]


def _clarity(spark, sf_dir):
    df = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return pipeline.clarity(df, _length_judge, target_frac=0.5)


@query()
def clarity_chain(spark, sf_dir):
    return _rounded(_clarity(spark, sf_dir)[0], "p0", "p1", "p2")


@query()
def embed_documents(spark, sf_dir):
    return clusters.embed(tables.documents(spark, sf_dir), 8)


# ---- metrics, training, sweeps -------------------------------------------------------------------

_PRED = f"with {_LABELLED}, {_NB.format(train='labelled', src='labelled')}, p as (select label, case when round(p1, 9) >= 0.5 then 1 else 0 end predicted from labelled join prob using (id))"


def _predicted(spark, sf_dir):
    df, p = _probabilities(spark, sf_dir)
    return df.join(p, "id").select("label", F.when(F.round("p1", 9) >= 0.5, 1).otherwise(0).alias("predicted"))


@query(f"""{_PRED}, c as (select count(*) filter (label = 1 and predicted = 1) tp, count(*) filter (label <> 1 and predicted = 1) fp, count(*) filter (label = 1 and predicted <> 1) fn, count(*) filter (label = predicted) ok, count(*) n from p)
select round(coalesce(ok / cast(nullif(n, 0) as double), 0), 9) accuracy, round(coalesce(tp / cast(nullif(tp + fp, 0) as double), 0), 9) "precision", round(coalesce(tp / cast(nullif(tp + fn, 0) as double), 0), 9) recall, round(coalesce(2 * tp / cast(nullif(2 * tp + fp + fn, 0) as double), 0), 9) f1 from c""")
def binary_metrics(spark, sf_dir):
    return _rounded(metrics.binary(_predicted(spark, sf_dir)), "accuracy", "precision", "recall", "f1", places=9)


@query(f"""{_PRED}, cl as (select label c from p union select predicted from p),
m as (select cast(c as varchar) class, count(*) filter (label = c and predicted = c) tp, count(*) filter (predicted = c) np, count(*) filter (label = c) support from cl, p group by c),
r as (select class, coalesce(tp / cast(nullif(np, 0) as double), 0) a, coalesce(tp / cast(nullif(support, 0) as double), 0) b, coalesce(2 * tp / cast(nullif(np + support, 0) as double), 0) f, support, tp from m),
u as (select class, a, b, f, support from r union all select 'macro', avg(a), avg(b), avg(f), sum(support) from r union all select 'weighted', sum(a * support) / sum(support), sum(b * support) / sum(support), sum(f * support) / sum(support), sum(support) from r
union all select 'accuracy', sum(tp) / cast(sum(support) as double), sum(tp) / cast(sum(support) as double), sum(tp) / cast(sum(support) as double), sum(support) from r)
select class, round(a, 9) "precision", round(b, 9) recall, round(f, 9) f1, cast(support as bigint) support from u""")
def classification_report(spark, sf_dir):
    return _rounded(metrics.report(_predicted(spark, sf_dir)), "precision", "recall", "f1", places=9)


@query()
def train_eval(spark, sf_dir):
    df = selectors.stratified_split(tables.labelled(spark, sf_dir), 0.2)
    train, test = df.where("part = 'train'"), df.where("part = 'test'")
    out = pipeline.train_and_evaluate(pipeline.choose(train, pipeline.Selection("random", 0.5)), test)
    return _rounded(out, "accuracy", "precision", "recall", "f1", "loss")


@query()
def pca_overlay(spark, sf_dir):
    df = tables.vectors(spark, sf_dir)
    what = [pipeline.Selection("random"), pipeline.Selection("kcenter", 0.02)]
    return pipeline.overlay(df, clusters.projection(df), what).select("id", "strategy", "selected", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""with {_LABELLED}, r as (select id, label, row_number() over (order by {_KEY}, id) r1, row_number() over (order by md5('7:' || cast(id as varchar)), id) r2, count(*) over () n from labelled)
select 'random' strategy, 'p10' pct, 42 seed, id, label from r where r1 <= cast(floor(n * cast(0.1 as double)) as bigint) union all select 'random', 'p05', 7, id, label from r where r2 <= cast(floor(n * cast(0.05 as double)) as bigint) union all select 'full', 'p10', 42, id, label from r""")
def manifest_sweep(spark, sf_dir):
    what = [pipeline.Selection("random"), pipeline.Selection("random", 0.05, 7), pipeline.Selection("full")]
    return pipeline.sweep(tables.labelled(spark, sf_dir), what)


@query("""select * from (values ('full', 0.819, 0.822, 1280, 0), ('random', 0.747, 0.746, 48, 0), ('wordpiece_ratio', 0.783, 0.787, 48, 13), ('perplexity', 0.749, 0.742, 48, 4700), ('llm_quality', 0.781, 0.778, 48, 4787), ('kcenter', 0.774, 0.768, 48, 560), ('herding', 0.763, 0.768, 48, 120), ('datadiet', 0.642, 0.596, 48, 20), ('hybrid_qdi', 0.792, 0.789, 48, 4920)) t(method, accuracy, f1, train_time_sec, select_time_sec)""")
def results_table(spark, sf_dir):
    return tables.results_table(spark)


# ---- whole stages ------------------------------------------------------------------------------


@query(
    f"with {_LABELLED}, l as (select id, split, label, len(w) n, w from labelled), t as (select unnest(w) token from l), "
    "facts as (select 'rows' name, '' part, cast(count(*) as double) value from l union all select 'rows', split, count(*) from l group by split "
    "union all select 'label', cast(label as varchar), count(*) from l group by label "
    "union all select 'words_mean', '', avg(n) from l union all select 'words_median', '', quantile_cont(n, 0.5) from l union all select 'words_max', '', max(n) from l "
    "union all select 'tokens', '', count(*) from t union all select 'vocabulary', '', count(distinct token) from t "
    "union all select 'token', token, n from (select token, count(*) n from t group by 1 order by n desc, token limit 10)) select name, part, round(value, 6) value from facts"
)
def eda_report(spark, sf_dir):
    return _rounded(pipeline.report(tables.labelled(spark, sf_dir), top=10), "value")


@query(
    f"""with {_LABELLED}, s as (select id, label, len(w) n from labelled), k as (select {_K10} k from s),
p as (select 'long' proxy, id, label, row_number() over (order by n desc, id) rn from s union all select 'short', id, label, row_number() over (order by n, id) from s union all select 'random', id, label, row_number() over (order by {_KEY}, id) from s)
select proxy, count(*) n_train, count(*) filter (label = 1) n_1, count(*) filter (label = 0) n_0 from p, k where rn <= k group by 1"""
)
def proxy_subsets(spark, sf_dir):
    df = shared.settled(profile.with_lengths(tables.labelled(spark, sf_dir)))
    return pipeline.proxy_summary(df, pipeline.proxies(df)).select("proxy", "n_train", "n_1", "n_0")


@query()
def proxy_training(spark, sf_dir):
    parts = selectors.stratified_split(tables.labelled(spark, sf_dir), 0.2)
    df = shared.settled(profile.with_lengths(parts))
    train = df.where("part = 'train'")
    out = pipeline.proxy_summary(train, pipeline.proxies(train), df.where("part = 'test'"))
    return _rounded(out, "accuracy", "precision", "recall", "f1", "loss")


@query(f"with {_LABELLED} select id, label from labelled order by {_KEY}, id limit (select {_K10} from labelled)")
def stage_dispatch(spark, sf_dir):
    made = pipeline.dispatch({"stages": ["choose"], "select": {"name": "random", "frac": 0.1}}, tables.labelled(spark, sf_dir))
    return made["choose"].select("id", "label")


@query(
    f"with {_LABELLED}, r as (select count(*) n from labelled) select 'random' strategy, 'p10' pct, 42 seed, n, greatest(1, cast(floor(n * cast(0.1 as double)) as bigint)) k, true timed from r "
    "union all select 'random', 'p05', 7, n, greatest(1, cast(floor(n * cast(0.05 as double)) as bigint)), true from r union all select 'full', 'p10', 42, n, n, true from r"
)
def selection_timing(spark, sf_dir):
    df = tables.labelled(spark, sf_dir)
    what = [pipeline.Selection("random"), pipeline.Selection("random", 0.05, 7), pipeline.Selection("full")]
    rows = [pipeline.timed_choice(df, w)[1] for w in what]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("strategy", "pct", "seed", "n", "k", (F.col("seconds") > 0).alias("timed"))
