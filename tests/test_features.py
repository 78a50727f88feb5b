"""Text features, scores, profile, metrics, parsers, sources and the pipeline's stages."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sieve.functions import responses, vectors
from sieve.functions import text as T
from sieve.operators import annotate, clusters, metrics, profile, scores, selectors
from sieve.plans import pipeline
from sieve.sources import tables


def texts(spark, *values, schema="id long, text string"):
    return spark.createDataFrame(list(enumerate(values)), schema)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_token_features(spark):
    df = texts(spark, "a bb  a\n", "", None, "one", " \t ")
    t = F.col("text")
    out = df.select("id", T.word_len(t).alias("w"), T.char_len(t).alias("c"), T.ttr(t).alias("ttr"), T.avg_word_len(t).alias("a"), T.flesch_reading_ease(t).alias("f"), T.sentences(t).alias("s"))
    assert column(out, "w") == [3, 0, 0, 1, 0]
    assert column(out, "c") == [8, 0, 0, 3, 3]
    assert column(out, "ttr") == [pytest.approx(2 / 3), 0, 0, 0, 0]
    assert column(out, "a") == [pytest.approx(4 / 3), 0, 0, 3, 0]
    assert column(out, "f")[1:3] == [0, 0] and column(out, "s") == [1] * 5


def test_lexical_diversity(spark):
    words = [f"w{i % 13}" for i in range(60)]
    windows = [words[i : i + 25] for i in range(36)]
    assert T._mattr(words, 25) == pytest.approx(sum(len(set(w)) / 25 for w in windows) / 36)
    assert T._mattr(words[:24], 25) == 0
    assert T._mtld(["a"], 0.72) == 0
    assert T._mtld(["a", "a", "a", "a"], 0.72) == pytest.approx(2.0)
    assert T._mtld([f"w{i}" for i in range(50)], 0.72) == 50
    long, short = " ".join(words), " ".join(words[:10])
    out = T.text_metrics(texts(spark, long, short, None), "id", "text")
    assert column(out, "type_token_ratio")[1:] == [0, 0] and column(out, "mtld")[1:] == [0, 0]
    per = T.text_metrics(texts(spark, long, short, None), "id", "text", short_text_policy="per_metric")
    assert column(per, "type_token_ratio")[1] == 1 and column(per, "mtld")[1] > 0 and column(per, "mattr")[1] == 0
    with pytest.raises(ValueError):
        T.text_metrics(texts(spark, long), "id", "text", short_text_policy="other")


def test_vectors(spark):
    df = spark.createDataFrame([(0, [0.2, 0.8], [3.0, 4.0])], "id long, p array<double>, v array<double>")
    one = df.select(
        vectors.entropy(F.array(F.lit(0.5), F.lit(0.5))).alias("e"),
        vectors.entropy(F.array(F.lit(1.0), F.lit(0.0))).alias("e0"),
        vectors.el2n(F.lit(1), F.col("p"), 2).alias("near"),
        vectors.el2n(F.lit(0), F.col("p"), 2).alias("far"),
        vectors.l2(F.col("v"), F.array(F.lit(0.0), F.lit(0.0))).alias("l2"),
        vectors.dot(F.col("v"), F.col("v")).alias("dot"),
        vectors.argmax(F.col("v")).alias("top"),
        vectors.softmax(F.col("v")).alias("s"),
    ).first()
    assert one.e == pytest.approx(0.693147, abs=1e-6) and one.e0 == pytest.approx(0, abs=1e-9)
    assert one.near == pytest.approx(0.282843, abs=1e-6) and one.far == pytest.approx(1.131371, abs=1e-6)
    assert (one.l2, one.dot, one.top) == (5, 25, 1)
    assert one.s == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])


def test_scores(spark):
    df = spark.createDataFrame([(0, "a a b", 1), (1, "c", 0), (2, "", 1), (3, None, 0)], "id long, text string, label int")
    ppl = column(scores.unigram_perplexity(df), "pppl")
    assert ppl[0] == pytest.approx(math.exp(-(2 * math.log(3 / 7) + math.log(2 / 7)) / 3)) and ppl[2:] == [None, None]
    p = column(scores.naive_bayes(df, df), "p1")
    assert p[0] > 0.5 > p[1] and p[2] == p[3] == 0.5
    wp = column(scores.wordpiece_ratio(df, vocabulary=1), "wp_ratio")
    assert wp[0] == pytest.approx(5 / 3) and wp[2:] == [0, 0]
    assert column(scores.wordpiece_ratio(df, vocabulary=1, max_length=2), "wp_ratio")[0] == pytest.approx(2 / 3)
    el2n = column(scores.el2n_scores(df), "el2n")
    assert all(0 <= x <= math.sqrt(2) for x in el2n)
    assert column(scores.el2n_scores(df, visited=0.0), "el2n") == [0] * 4


def test_scores_of_a_vocabulary_too_large_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 9)) or None, i % 2) for i in range(120)], "id long, text string, label int")

    def all_scores():
        tables_ = (scores.unigram_perplexity(df), scores.naive_bayes(df, df), scores.el2n_scores(df))
        return [sorted((r[0], None if r[1] is None else round(r[1], 9)) for r in t.collect()) for t in tables_]

    plain = all_scores()
    monkeypatch.setattr("sieve.sources.shared.BROADCAST_ROWS", 5)
    monkeypatch.setattr(scores, "COMMON", 3)
    assert all_scores() == plain


def test_profile(spark):
    df = spark.createDataFrame([(0, "a b", 1, "train"), (1, "a", 0, "train"), (2, "c d e", None, "test")], "id long, text string, label int, split string")
    one = profile.lengths(df).first()
    assert (one.n_examples, one.word_len_min, one.word_len_max, one.word_len_mean) == (3, 1, 3, 2)
    by = {r.split: r for r in profile.by_split(df).collect()}
    assert (by["overall"].n_examples, by["overall"].vocab_size, by["train"].vocab_size) == (3, 5, 2)
    assert {r.label: r.n for r in profile.label_balance(df).collect()} == {1: 1, 0: 1, None: 1}
    bins = profile.histogram(profile.with_lengths(df), "word_len", 4).orderBy("bin").collect()
    assert [r.n for r in bins] == [1, 0, 1, 1]
    assert profile.histogram(spark.createDataFrame([(5,), (5,)], "x int"), "x", 3).orderBy("bin").first().n == 2
    wide = {r.split: r for r in profile.summary_table(df, [0, 1]).collect()}
    assert wide["test"].label_frac_0 is None and wide["train"].label_frac_1 == 0.5
    box = profile.boxplot(profile.with_lengths(df), "word_len").where("label is null").first()
    assert (box.n, box.whisker_low, box.whisker_high) == (1, 3, 3)
    assert profile.vocabulary_size(df.where("false")).first().n_tokens == 0


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "label int, predicted int")
    assert tuple(metrics.binary(df).first()) == (0.5, 0.5, 0.5, 0.5)
    assert tuple(metrics.binary(spark.createDataFrame([(1, 0), (0, 0)], "label int, predicted int")).first()) == (0.5, 0, 0, 0)
    rows = {r["class"]: r for r in metrics.report(df).collect()}
    assert rows["macro"].f1 == 0.5 and rows["accuracy"].support == 4 and rows["1"].support == 2


def test_responses(spark):
    df = texts(spark, "2", "Answer: 0.", "none", "3 1", None)
    assert column(df.select("id", responses.parse_digit(F.col("text")).alias("d")), "d") == [2, 0, 1, 1, 1]
    full = '{"quality": {"score": 4, "explanation": "x"}, "diversity": {"score": 2}, "importance": {"score": 5}}'
    df = texts(spark, f"text {full} more", full.replace("importance", "other"), "no braces", "{broken", None)
    got = column(df.select("id", responses.parse_json(F.col("text")).alias("j")), "j")
    assert got[0].quality.score == 4 and got[0].diversity.score == 2 and got[1:] == [None] * 4
    assert texts(spark, " a {b} ").select(responses.prompt(F.col("text"), "P: ", "!")).first()[0] == "P: a {b}!"


def test_clients(spark):
    df = texts(spark, "abc", "", None)
    assert column(annotate.score_rows(df, lambda: lambda batch: [float(len(t)) for t in batch], batch=2), "score") == [3, 0, 0]
    calls, waits = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert annotate.with_retries(flaky, sleep=waits.append)("t") == "ok" and waits == [2, 4]
    assert annotate.with_retries(lambda t: 1 / 0, retries=2, sleep=waits.append)("t") is None
    answers = spark.createDataFrame([(0, "nothing")], "id long, response string")
    out = annotate.annotations(df, answers).orderBy("id").collect()
    assert out[0].quality_score is None and out[0].quality_expl == "" and len(out) == 3


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline, two', 1), (2, "b", 0)], tables.MANIFEST)
    path = tables.write_manifest(df, str(tmp_path), "random", 0.1, 42)
    assert path.endswith("random_p10_seed42")
    assert sorted(tables.read_corpus(spark, path, "csv", tables.MANIFEST).collect()) == sorted(df.collect())
    tables.write_table(df.withColumnRenamed("text", "sentence"), f"{tmp_path}/s")
    assert tables.read_corpus(spark, f"{tmp_path}/s").columns == ["id", "text", "label"]
    with pytest.raises(ValueError):
        tables.resolve_text_col(spark.range(1))
    with pytest.raises(ValueError):
        tables.require_columns(df, "nope")
    tables.write_table(tables.json_document(df), f"{tmp_path}/j", "text")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_pipeline(spark, tmp_path):
    good, bad = "nice fine good great lovely", "awful poor bad sad grim"
    data = [(i, f"{good if i % 2 else bad} w{i % 7} end", i % 2) for i in range(60)]
    df = pipeline.prepare(spark.createDataFrame(data, "id long, sentence string, label int"), f"{tmp_path}/corpus")
    assert df.columns == ["id", "text", "label"]
    scored = pipeline.stored(pipeline.features(df), f"{tmp_path}/features", data="corpus", model="relational")
    assert scored.count() == 60 and pipeline.stored(pipeline.features(df), f"{tmp_path}/features", data="corpus", model="relational").count() == 60
    names = ["random", "full", "entropy", "wordpiece_ratio", "perplexity", "datadiet", "llm_quality"]
    out = pipeline.sweep(scored, [pipeline.Selection(n, 0.2) for n in names])
    sizes = {r.strategy: r["count"] for r in out.groupBy("strategy").count().collect()}
    assert sizes == {n: 60 if n == "full" else 12 for n in names}
    split = selectors.stratified_split(df, 0.2)
    m = pipeline.train_and_evaluate(split.where("part = 'train'"), split.where("part = 'test'")).first()
    assert m.accuracy == 1 and m.n == 12 and m.loss < 0.7
    assert pipeline.Selection("kcenter", 0.05, 7).tag == "kcenter_p05_seed7"


def test_models(spark):
    data = [(i, [float(i % 3), float(i % 3) * 2 + i / 1000], i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "id long, v array<double>, label int")
    out = clusters.with_clusters(df, 3)
    assert out.count() == 60 and out.select("cluster").distinct().count() == 3
    assert clusters.with_clusters(df.limit(2), 3).select("cluster").distinct().count() == 1
    judged = df.where("id < 12").withColumnRenamed("label", "verdict")
    pred = clusters.student(df, judged).join(df, "id")
    assert pred.where("pred = label").count() == 60
    with pytest.raises(ValueError):
        clusters.student(df, judged.where("verdict < 2"))
    assert clusters.projection(df).count() == 60
    assert clusters.embed(texts(spark, *[f"a b{i} c{i % 4}" for i in range(20)]), 2).count() == 20


def test_clusters_are_fitted_on_all_rows_unless_bounded(spark, monkeypatch):
    fitted = []

    class Recorder(clusters.KMeans):
        def fit(self, rows):
            fitted.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(clusters, "KMeans", Recorder)
    df = spark.range(50_500).selectExpr("id", "array(cast(id % 2 as double), 0d) as v")
    assert clusters.with_clusters(df, 2).count() == 50_500
    assert clusters.with_clusters(df, 2, max_points=100).count() == 50_500
    assert fitted == [50_500, 100]


def test_wordpiece_ratio_without_a_cap(spark):
    df = texts(spark, "a " * 1000)
    assert column(scores.wordpiece_ratio(df, vocabulary=1), "wp_ratio")[0] == pytest.approx(0.512)
    assert column(scores.wordpiece_ratio(df, vocabulary=1, max_length=None), "wp_ratio")[0] == pytest.approx(1.002)


def test_dispatch(spark):
    df = spark.createDataFrame([(i, f"word{i % 5} and word{i % 3} " * (1 + i % 4), i % 2, "train") for i in range(60)], "id long, text string, label int, split string")
    made = pipeline.dispatch({"stages": ["train", "features", "choose", "report"], "select": {"name": "datadiet", "frac": 0.5}}, df, df)
    assert list(made) == ["report", "features", "choose", "train"]
    assert made["choose"].count() == 30 and made["train"].first()["n"] == 60
    assert {r["name"] for r in made["report"].collect()} == {"rows", "label", "words_mean", "words_median", "words_max", "tokens", "vocabulary", "token"}
    assert pipeline.dispatch({}, df) == {}
    with pytest.raises(ValueError):
        pipeline.dispatch({"stages": ["evaluate"]}, df)
    with pytest.raises(ValueError):
        pipeline.dispatch({"stages": ["train"]}, df)


def test_stored_model_and_metrics_document(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{'good nice' if i % 2 else 'bad sad'} w{i % 5}", i % 2) for i in range(40)], "id long, text string, label int")
    rows, took = pipeline.timed_choice(df, pipeline.Selection("random", 0.5))
    assert rows.count() == 20 and took.first().asDict().items() >= {"strategy": "random", "pct": "p50", "seed": 42, "n": 40, "k": 20}.items()
    assert took.first().seconds > 0
    path = f"file://{tmp_path}/model"
    for _ in range(2):  # the second replaces the first
        model = pipeline.train(rows, path)
    stored = pipeline.evaluate(path, df).first()
    assert stored == pipeline.evaluate(model, df).first() and stored.accuracy == 1
    text = pipeline.metrics_document(pipeline.evaluate(path, df), pipeline.Selection("random", 0.5), f"file://{tmp_path}/metrics").first().value
    assert json.loads(text)["selection"]["tag"] == "random_p50_seed42" and json.loads(text)["metrics"]["n"] == 40
    assert spark.read.text(f"file://{tmp_path}/metrics").first().value == text


def test_configuration(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"stages": ["choose"], "select": {"name": "full"}}, indent=2))
    got = pipeline.configuration(spark, f"file://{path}", "select.name=random", "select.frac=0.5", "select.params.seed=3")
    assert got == {"stages": ["choose"], "select": {"name": "random", "frac": 0.5, "params": {"seed": 3}}}
    df = spark.createDataFrame([(i, "t", 1) for i in range(10)], "id long, text string, label int")
    assert pipeline.dispatch(got, df)["choose"].count() == 5
    with pytest.raises(ValueError):
        pipeline.configuration(spark, f"file://{path}", "select.name")


def test_clarity_chain(spark, tmp_path):
    words = ["alpha beta", "gamma delta", "omega sigma"]
    df = spark.createDataFrame([(i, f"{words[i % 3]} n{i}") for i in range(60)], "id long, text string")
    vectors = spark.createDataFrame([(i, [float(i % 3 == j) for j in range(3)]) for i in range(60)], "id long, v array<double>")
    asked = str(tmp_path / "asked")

    def judge():
        def answers(prompts):
            with open(asked, "a") as f:
                f.writelines("x\n" for _ in prompts)
            return [f"I say {next(k for k, w in enumerate(words) if w in p)}." for p in prompts]

        return answers

    scored, report = pipeline.clarity(df, judge, target_frac=0.4, vectors=vectors)
    assert {r.id: r.pred for r in scored.collect()} == {i: i % 3 for i in range(60)}
    assert all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 for r in scored.collect())
    rows = {r["class"]: r for r in report.collect()}
    assert rows["accuracy"].f1 == 1 and rows["accuracy"].support == 5
    with open(asked) as f:
        assert len(f.readlines()) == 24  # each row of the subset once
    with pytest.raises(ValueError):
        pipeline.clarity(df, lambda: lambda prompts: ["1"] * len(prompts), vectors=vectors)


def test_embedding_keeps_the_distances_of_the_weighted_counts(spark):
    import numpy as np

    rows = ["a b c", "a a d", "b c d d", "e", ""]
    df = texts(spark, *rows)
    got = np.array(column(clusters.embed(df, 5, features=1 << 10), "v"))
    types = sorted(set(" ".join(rows).split()))
    counts = np.array([[t.split().count(w) for w in types] for t in rows], float)
    weighted = counts * np.log((len(rows) + 1) / ((counts > 0).sum(0) + 1))

    def apart(x):
        return ((x[:, None] - x[None]) ** 2).sum(2)

    assert np.allclose(apart(got), apart(weighted), atol=1e-9)
