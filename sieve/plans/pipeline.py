"""Stages of an experiment: prepare a corpus, choose rows, train on them, evaluate, and sweep over strategies and budgets."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses
from ..functions import text as T
from ..functions.hashing import budget, pct_tag
from ..operators import annotate, clusters, greedy, metrics, profile, scale, scores, selectors
from ..sources import shared, tables


@dataclass(frozen=True)
class Selection:
    """What to choose: strategy, share of rows, seed and the strategy's parameters."""

    name: str = "random"
    frac: float = 0.1
    seed: int = 42
    params: dict = field(default_factory=dict)

    @property
    def tag(self) -> str:
        return f"{self.name}_{pct_tag(self.frac)}_seed{self.seed}"


def fingerprint(**parts) -> str:
    """Name of a stored feature table: whatever it depends on, hashed."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def stored(df: DataFrame, root: str, **parts) -> DataFrame:
    """The table from the store if one of that fingerprint is there whole, else written there first."""
    spark = df.sparkSession
    path = f"{root}/{fingerprint(schema=df.schema.simpleString(), **parts)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prepare(df: DataFrame, path: str) -> DataFrame:
    """Store a corpus as (id, text, label)."""
    text = tables.resolve_text_col(df)
    tables.write_table(tables.require_columns(df, "id", "label").select("id", F.col(text).alias("text"), "label"), path)
    return df.sparkSession.read.parquet(path)


def features(df: DataFrame) -> DataFrame:
    """The corpus with the relational scores that the strategies ask for."""
    t = F.col("text")
    p = scores.naive_bayes(df, df).select("id", F.col("p1").alias("p_clear"), scores.binary_entropy().alias("entropy"))
    short = T.word_len(t) < 25
    out = df.withColumn("token_count", T.word_len(t)).withColumn("type_token_ratio", F.when(short, 0.0).otherwise(T.ttr(t))).withColumn("flesch_reading_ease", T.flesch_reading_ease(t))
    for table in (scores.unigram_perplexity(df), p, scores.wordpiece_ratio(df), scores.el2n_scores(df)):
        out = out.join(table, "id", "left")
    return out


def choose(df: DataFrame, what: Selection) -> DataFrame:
    """The rows of one selection; its k is the floor of the share, at least 1."""
    name = selectors.ALIASES.get(what.name, what.name)
    params = dict(what.params)
    if name in ("random", "kmeans", "predictive_entropy", "wordpiece_ratio", "kcenter"):
        params.setdefault("seed", what.seed)
    return selectors.select(name, df, budget(df.count(), what.frac), **params)


def sweep(df: DataFrame, what: list[Selection]) -> DataFrame:
    """All manifests in one table (strategy, pct, seed, id, label)."""
    parts = [choose(df, w).select(F.lit(w.name).alias("strategy"), F.lit(pct_tag(w.frac)).alias("pct"), F.lit(w.seed).alias("seed"), "id", "label") for w in what]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timed_choice(df: DataFrame, what: Selection) -> tuple[DataFrame, DataFrame]:
    """The rows of one selection, settled, and one row (strategy, pct, seed, n, k, seconds) of what it took."""
    began = time.perf_counter()
    rows = shared.settled(choose(df, what))
    seconds = time.perf_counter() - began
    facts = [(what.name, pct_tag(what.frac), what.seed, df.count(), rows.count(), seconds)]
    return rows, df.sparkSession.createDataFrame(facts, "strategy string, pct string, seed int, n long, k long, seconds double")


def train(chosen: DataFrame, path: str | None = None) -> PipelineModel:
    """A classifier trained on the chosen rows, stored under ``path`` if one is given; a model already there is replaced."""
    model = clusters.text_pipeline().fit(chosen.select("text", F.col("label").cast("double").alias("label")))
    if path:
        model.write().overwrite().save(path)
    return model


def evaluate(model: PipelineModel | str, test: DataFrame) -> DataFrame:
    """Metrics on ``test`` of a classifier, or of the one stored under a path, with the mean log loss."""
    if isinstance(model, str):
        model = PipelineModel.load(model)
    out = model.transform(test.select("id", "text", F.col("label").cast("double").alias("label")))
    p1 = vector_to_array("probability")[1]
    rows = out.select(F.col("label").cast("int").alias("label"), F.col("_p").cast("int").alias("predicted"), p1.alias("p"))
    eps = F.lit(1e-12)
    loss = -F.avg(F.when(F.col("label") == 1, F.log(F.col("p") + eps)).otherwise(F.log(1 - F.col("p") + eps)))
    return metrics.binary(rows).crossJoin(F.broadcast(rows.agg(loss.alias("loss"), F.count("*").alias("n"))))  # one row each


def train_and_evaluate(chosen: DataFrame, test: DataFrame) -> DataFrame:
    """Metrics on ``test`` of a classifier trained on ``chosen``, with the mean log loss."""
    return evaluate(train(chosen), test)


def metrics_document(rows: DataFrame, what: Selection, path: str | None = None) -> DataFrame:
    """One JSON text for each row of metrics, with the selection it belongs to; written under ``path`` if one is given."""
    about = F.struct(F.lit(what.name).alias("strategy"), F.lit(what.frac).alias("frac"), F.lit(what.seed).alias("seed"), F.lit(what.tag).alias("tag"))
    out = tables.json_document(rows.select(about.alias("selection"), F.struct("*").alias("metrics")))
    if path:
        tables.write_table(out, path, "text")
    return out


def clarity(
    df: DataFrame, judge: Callable[[], Callable], target_frac: float = 0.1, max_pool: int = 5000, vectors: DataFrame | None = None, held_out: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """A judge's verdicts (0, 1, 2) on a diverse subset, learned by a student that scores all rows: (scores, report).

    ``judge`` is a client as in ``annotate``, from prompts to answers; it sees each row of the subset once, at most ``max_pool`` rows.  ``vectors``
    (id, v) come from an encoder, or else from ``clusters.embed``.  Scores: (id, p0, p1, p2, pred) of every row.  Report: ``metrics.report`` of the
    student on the share of the verdicts that it didn't learn from.  Fewer than three different verdicts to learn from are an error.
    """
    subset = greedy.diverse_texts(df, target_frac, max_pool, seed=seed).select("id")
    asked = df.join(F.broadcast(subset), "id", "left_semi").select("id", responses.prompt(F.col("text")).alias("text"))
    answers = shared.settled(annotate.score_rows(asked, judge, "response string"))
    judged = answers.select("id", responses.parse_digit(F.col("response")).alias("verdict"))
    parts = shared.settled(selectors.stratified_split(judged, held_out, "verdict", seed=seed))
    vectors = shared.settled(clusters.embed(df)) if vectors is None else vectors
    scored = shared.settled(clusters.student(vectors, parts.where("part = 'train'")))
    test = parts.where("part = 'test'").join(scored, "id")
    return scored, metrics.report(test, "verdict", "pred")


def overlay(df: DataFrame, points: DataFrame, what: list[Selection]) -> DataFrame:
    """(id, x, y, strategy, selected) for every strategy: the data of a picture."""
    parts = []
    for w in what:
        marks = choose(df, w).select("id", F.lit(True).alias("_m"))
        parts.append(points.join(marks, "id", "left").select("id", "x", "y", F.lit(w.name).alias("strategy"), F.coalesce("_m", F.lit(False)).alias("selected")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(df: DataFrame, top: int = 30) -> DataFrame:
    """(name, part, value): the facts of a corpus (id, text, label, split) in one table: rows, labels, words, vocabulary, commonest tokens."""
    rows = shared.settled(profile.with_lengths(df).select("split", "label", "word_len"))
    words = shared.settled(scores.occurrences(df, "text").groupBy("token").agg(F.count("*").alias("n")))

    def fact(frame: DataFrame, name: str, value, part=None) -> DataFrame:
        return frame.select(F.lit(name).alias("name"), (F.lit("") if part is None else part.cast("string")).alias("part"), value.cast("double").alias("value"))

    lengths = rows.agg(F.count("*").alias("n"), F.avg("word_len").alias("mean"), F.max("word_len").alias("most"))
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types"))
    parts = [
        fact(lengths, "rows", F.col("n")),
        fact(rows.groupBy("split").count(), "rows", F.col("count"), F.col("split")),
        fact(rows.groupBy("label").count(), "label", F.col("count"), F.col("label")),
        fact(lengths, "words_mean", F.col("mean")),
        fact(scale.median(rows, "word_len"), "words_median", F.col("median")),
        fact(lengths, "words_max", F.col("most")),
        fact(size, "tokens", F.col("n")),
        fact(size, "vocabulary", F.col("types")),
        fact(words.orderBy(F.desc("n"), "token").limit(top), "token", F.col("n"), F.col("token")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def proxies(df: DataFrame, frac: float = 0.1, score: str = "word_len", seed: int = 42) -> dict[str, DataFrame]:
    """Three subsets of a share of the rows: the greatest scores, the least, and random rows."""
    k = budget(df.count(), frac)
    return {
        "long": selectors.by_score(df, k, score, "high"),
        "short": selectors.by_score(df, k, score, "low"),
        "random": selectors.random(df, k, seed=seed),
    }


def proxy_summary(df: DataFrame, subsets: dict[str, DataFrame], test: DataFrame | None = None) -> DataFrame:
    """One row a subset: its name, rows and labels, and with ``test`` the metrics of a classifier trained on it."""
    out = None
    for name, rows in subsets.items():
        row = rows.agg(F.lit(name).alias("proxy"), F.count("*").alias("n_train"), F.count_if(F.col("label") == 1).alias("n_1"), F.count_if(F.col("label") == 0).alias("n_0"))
        if test is not None:
            row = row.crossJoin(F.broadcast(train_and_evaluate(rows, test)))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def configuration(spark: SparkSession, path: str, *changes: str) -> dict:
    """A configuration for ``dispatch`` from a JSON file, with changes such as ``select.frac=0.05``; values are JSON, or else plain text."""
    config = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    for change in changes:
        name, sep, value = change.partition("=")
        if not sep:
            raise ValueError(f"a change is name=value, not {change}")
        *outer, last = name.split(".")
        place = config
        for part in outer:
            place = place.setdefault(part, {})
        try:
            place[last] = json.loads(value)
        except json.JSONDecodeError:
            place[last] = value
    return config


def dispatch(config: dict, df: DataFrame, test: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run the stages that a configuration names, in this order, and give their tables by name.

    ``stages``: of report, features, choose, train; ``select``: fields of ``Selection``; each stage works on what the one before made.
    """
    known = ("report", "features", "choose", "train")
    wanted = config.get("stages", [])
    if unknown := [s for s in wanted if s not in known]:
        raise ValueError(f"unknown stages {unknown}; there are {known}")
    made: dict[str, DataFrame] = {}
    for stage in [s for s in known if s in wanted]:
        if stage == "report":
            made[stage] = report(df)
        elif stage == "features":
            made[stage] = df = shared.settled(features(df))
        elif stage == "choose":
            made[stage] = df = choose(df, Selection(**config.get("select", {})))
        elif test is None:
            raise ValueError("the stage train needs a test table")
        else:
            made[stage] = train_and_evaluate(df, test)
    return made
