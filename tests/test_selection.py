"""Selection operators on small tables with results worked out by hand, and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.functions import hashing
from sieve.operators import greedy, joins, quota, scale, selectors, topk


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


@pytest.mark.parametrize("n,frac,mode,want", [(67349, 0.1, "floor", 6734), (67349, 0.1, "half_even", 6735), (3, 0.1, "floor", 1), (0, 0.1, "floor", 0), (10, 2.0, "floor", 10)])
def test_budget(n, frac, mode, want):
    assert hashing.budget(n, frac, mode) == want


def test_budget_mode():
    with pytest.raises(ValueError):
        hashing.budget(5, 0.5, "up")
    assert hashing.pct_tag(0.05) == "p05" and hashing.pct_tag(1.0) == "p100"


def quotas(df):
    return [r["_quota"] for r in df.orderBy("g").collect()]


def counts(spark, *n):
    return rows(spark, list(enumerate(n)), "g int, n long")


def test_quotas(spark):
    assert quotas(quota.equal_quota(counts(spark, 9, 9, 9), "g", 8)) == [3, 3, 2]
    assert quotas(quota.largest_remainder_quota(counts(spark, 5, 3, 2), "g", 7)) == [4, 2, 1]
    assert quotas(quota.share_quota(counts(spark, 5, 3, 2), "g", 5)) == [2, 2, 1]
    assert quotas(quota.share_quota(counts(spark, 25, 25), "g", 5)) == [2, 2]
    assert sum(quotas(quota.share_quota(counts(spark, 25, 25), "g", 5, fill=True))) == 5
    assert quotas(quota.share_quota(counts(spark, 50, 1, 1, 1), "g", 2)) == [2, 0, 0, 0]


def test_quota_topped_up(spark):
    df = rows(spark, [(0, 0, 0.5)] + [(i, 1, i / 10) for i in range(1, 10)], "id long, label int, p_clear double")
    assert ids(selectors.llm_quality(df, 6)) == [0, 5, 6, 7, 8, 9]


def test_band_includes_its_ends(spark):
    df = rows(spark, [(float(i),) for i in range(1, 6)], "x double")
    assert ids(scale.quantile_band(df, "x", 0.75, 0.25), "x") == [2, 3, 4]


def test_floor_only_for_cuts_under_a_half(spark):
    df = rows(spark, [(float(i),) for i in range(10)], "x double")
    for cut, left in ((0, 10), (0.5, 10), (0.9, 10), (0.25, 7)):
        assert scale.quantile_floor(df, "x", cut).count() == left


def test_minmax(spark):
    out = scale.minmax(rows(spark, [(3.0, 1.0), (3.0, None), (3.0, 5.0)], "a double, b double"), x="a", y="b").orderBy("b").collect()
    assert [r.x for r in out] == [0, 0, 0]
    assert [r.y for r in out] == [None, 0, 1]
    assert scale.minmax(rows(spark, [], "a double"), x="a").count() == 0


def test_top_k_ties_nulls_and_bounds(spark):
    df = rows(spark, [(3, 1.0), (1, 1.0), (2, None), (4, 0.5)], "id long, s double")
    assert ids(topk.top_k(df, 2, F.col("s"), ["id"])) == [1, 3]
    assert ids(topk.top_k(df, 3, F.col("s"), ["id"])) == [1, 3, 4]
    assert ids(topk.top_k(df, 1, F.col("s"), ["id"], descending=False)) == [4]
    assert topk.top_k(df, 0, F.col("s"), ["id"]).count() == 0
    assert topk.top_k(df, 9, F.col("s"), ["id"]).count() == 4


@pytest.mark.parametrize("descending", [True, False])
def test_bracketed_top_k_equals_the_sorted_one(spark, monkeypatch, descending):
    r = np.random.default_rng(3)
    data = [(int(i), int(i % 3), None if i % 17 == 0 else float(v)) for i, v in enumerate(r.integers(0, 40, 900))]
    df = rows(spark, data, "id long, g int, s double").repartition(7)
    score = F.col("s")
    plain = {k: ids(topk.top_k(df, k, score, ["id"], descending)) for k in (1, 60, 450, 899)}
    want = quota.group_counts(df, "g").select("g", (F.col("g") * 100 + 5).cast("long").alias("_quota"))
    grouped = ids(topk.top_per_group(df, "g", want, score, ["id"], descending))
    monkeypatch.setattr(topk, "SMALL", 10)
    for k, chosen in plain.items():
        assert ids(topk.top_k(df, k, score, ["id"], descending)) == chosen
    assert ids(topk.top_per_group(df, "g", want, score, ["id"], descending)) == grouped


def test_equal_scores_are_bracketed_by_what_breaks_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "SMALL", 300)
    seen = []
    monkeypatch.setattr(topk.shared, "settled", lambda df, f=topk.shared.settled: seen.append(f(df)) or seen[-1])
    df = spark.range(20_000).selectExpr("id", "0.5d as s", "1 as g").repartition(6)
    assert ids(topk.top_k(df, 2_000, F.col("s"), ["id"])) == list(range(2_000))
    assert seen[-2].count() <= 300  # the rows left to rank


def test_exact_quantiles_of_large_columns(spark, monkeypatch):
    r = np.random.default_rng(7)
    values = [*r.normal(size=3000).tolist(), *[0.25] * 2000, None, None]
    df = rows(spark, [(x,) for x in values], "s double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.63, 0.9999, 1.0]
    plain = scale.quantiles(df, "s", shares)
    monkeypatch.setattr(scale, "SMALL", 200)
    assert scale.quantiles(df, "s", shares) == pytest.approx(plain, abs=1e-12)
    assert scale.quantiles(df.where("s is null"), "s", [0.5]) == [None]


def test_random_ignores_the_layout(spark):
    df = spark.range(500)
    a, b = ids(selectors.random(df.repartition(1), 50)), ids(selectors.random(df.repartition(9), 50))
    assert a == b and len(set(a)) == 50
    assert ids(selectors.random(df, 50, seed=7)) != a


def test_selections_by_score(spark):
    df = rows(spark, [(i, float(i)) for i in range(11)], "id long, s double")
    assert ids(selectors.by_score(df, 2, "s", "high")) == [9, 10]
    assert ids(selectors.by_score(df, 2, "s", "low")) == [0, 1]
    assert ids(selectors.by_score(df, 99, "s", "middle")) == list(range(2, 9))
    with pytest.raises(ValueError):
        selectors.by_score(df, 2, "s", "best")


def test_registry(spark):
    df = rows(spark, [(i, i / 7, i % 2) for i in range(7)], "id long, entropy double, label int")
    assert selectors.select("entropy", df, 2, keep="high").count() == 2
    assert selectors.select("full", df, 2).count() == 7
    with pytest.raises(KeyError):
        selectors.select("nothing", df, 2)
    with pytest.raises(TypeError):
        selectors.select("full", df, 2, wrong=1)


def test_perplexity(spark):
    data = [(i, float(i), 10 + i, 0.5) for i in range(11)]
    df = rows(spark, data, "id long, pppl double, token_count int, type_token_ratio double")
    assert ids(selectors.perplexity(df, 2)) == [3, 4]  # shortest of the band 3..7
    assert ids(selectors.perplexity(df, 2, use_quality=False)) == [3, 4]
    assert ids(selectors.perplexity(df, 99)) == [3, 4, 5, 6, 7]
    assert ids(selectors.perplexity(df, 1, length_weight=0.0, ttr_weight=0.0, readability_col="pppl")) == [7]


def test_hybrid(spark):
    data = [(i, i % 2, i % 3, 10.0 + i, 50.0) for i in range(20)]
    df = rows(spark, data, "id long, label int, cluster int, pppl double, flesch_reading_ease double")
    out = selectors.hybrid_scores(df).collect()
    assert all(0 <= r[c] <= 1 for r in out for c in ("q", "i", "d", "qdi"))
    chosen = selectors.hybrid(df, 6)
    assert chosen.count() == 6 and chosen.select("id").distinct().count() == 6
    assert selectors.hybrid(df, 100).count() == 18  # the lowest tenth in quality is gone
    with pytest.raises(ValueError):
        selectors.hybrid(df, 6, importance="other")


def test_stratified_split_and_examples(spark):
    df = rows(spark, [(i, int(i < 80)) for i in range(100)], "id long, label int")
    parts = {(r.label, r.part): r["count"] for r in selectors.stratified_split(df, 0.1).groupBy("label", "part").count().collect()}
    assert parts == {(1, "test"): 8, (0, "test"): 2, (1, "train"): 72, (0, "train"): 18}
    assert selectors.examples_per_class(df, 30).groupBy("label").count().orderBy("label").collect()[0]["count"] == 20


def vectors(spark, points):
    return rows(spark, [(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")


def steps(df):
    return [r.id for r in df.orderBy("step").collect()]


def test_k_center(spark):
    assert steps(greedy.k_center(vectors(spark, [[0], [1], [10]]), 2, start_id=0)) == [0, 2]
    assert sorted(steps(greedy.k_center(vectors(spark, [[1], [1], [1]]), 3))) == [0, 1, 2]
    assert greedy.k_center(vectors(spark, [[1]]), 0).count() == 0
    assert len(steps(greedy.k_center(vectors(spark, [[1], [2]]), 9))) == 2


def test_k_center_in_parts_covers_nearly_as_well(spark):
    x = np.random.default_rng(1).normal(size=(300, 3))
    df = vectors(spark, x)

    def radius(picks):
        return max(min(np.linalg.norm(p - x[c]) for c in picks) for p in x)

    exact, parts = steps(greedy.k_center(df, 12, start_id=0)), steps(greedy.k_center(df, 12, start_id=0, exact=300))
    assert len(set(parts)) == 12
    assert radius(parts) <= 3 * radius(exact)
    assert steps(greedy.k_center(df.repartition(5), 12, start_id=0, exact=300)) == parts


@pytest.mark.parametrize("pool", [1, 7, 4096])
def test_k_center_is_the_same_at_every_size(spark, pool, monkeypatch):
    monkeypatch.setattr(greedy, "POOL", pool)
    x = np.random.default_rng(4).integers(0, 4, size=(90, 3)).astype(float)  # many ties and equal rows
    df = vectors(spark, x).repartition(5)
    for k, start_id in ((12, 0), (12, None), (12, 1000)):
        exact = greedy.k_center(df, k, start_id=start_id).orderBy("step").collect()
        assert greedy.k_center(df, k, start_id=start_id, exact=10).orderBy("step").collect() == exact
    if pool > 1:
        assert greedy.k_center(df, 100, exact=10).orderBy("step").collect() == greedy.k_center(df, 100).orderBy("step").collect()


def test_herding(spark):
    df = vectors(spark, [[1, 0], [0, 1], [1, 1]])
    assert steps(greedy.herding(df, 3)) == [2, 0, 1]
    x = np.random.default_rng(2).normal(size=(60, 4))
    df = vectors(spark, x)
    for variant in ("residual", "classic"):
        assert steps(greedy.herding(df, 6, variant=variant)) == steps(greedy.herding(df, 6, variant=variant, exact=10))
    assert greedy.herding(df, 0).count() == 0


def test_edit_distances(spark):
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    texts = ["kitten", "sitting", "", "é", "e", "abcdef", "fedcba", "中文中"]
    codes, lengths = greedy._codes(texts)
    for t in texts:
        assert greedy.edit_distances(t, codes, lengths).tolist() == [plain(t, u) for u in texts]


def test_diverse_texts(spark):
    df = rows(spark, [(i, t) for i, t in enumerate(["aaaa", "aaab", "zzzz", "zzzy", "mmmm", "aaaa", None, "", "qqqq", "aaac"])], "id long, text string")
    assert greedy.diverse_texts(df, 0.1, max_pool=1).count() == 1  # the pool as it is
    chosen = greedy.diverse_texts(df, 0.4)
    assert chosen.count() == 4 and chosen.select("id").distinct().count() == 4
    same = rows(spark, [(i, "same") for i in range(10)], "id long, text string")
    assert greedy.diverse_texts(same, 0.5).count() == 1  # nothing is farther


def test_uniqueness(spark):
    df = rows(spark, [(0, 0, "kitten"), (1, 0, "sitting"), (2, 0, "kitten"), (3, 1, "alone"), (4, 2, None), (5, 2, "ab")], "id long, label int, text string")
    assert [(r.id, r.min_lev_dist) for r in greedy.uniqueness(df).orderBy("id").collect()] == [(0, 0), (1, 3), (2, 0), (3, 0), (4, 2), (5, 2)]


def test_uniqueness_with_more_peers_than_may_be_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" if i % 3 else f"l{i % 2}", f"t{i * 7 % 50}" * (1 + i % 3)) for i in range(90)] + [(90, None, "n"), (91, "x", None)], "id long, label string, text string")
    want = sorted(map(tuple, greedy.uniqueness(df, 5).collect()), key=lambda r: r[0])
    monkeypatch.setattr(greedy.shared, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, greedy.uniqueness(df, 5).collect()), key=lambda r: r[0]) == want and len(want) == 92


def test_joins(spark):
    df = rows(spark, [(1, "a"), (2, "b"), (3, "a")], "id long, t string")
    score = rows(spark, [(1, 0.1), (2, 0.2)], "id long, s double")
    assert joins.with_features(df, score).where("s is null").count() == 1
    with pytest.raises(KeyError):
        joins.aligned(df, score)
    assert joins.aligned(df.where("id < 3"), score).count() == 2
    assert ids(joins.overlay(df, score).where("selected")) == [1, 2]
    assert ids(joins.remaining(df, score)) == [3]
    assert ids(joins.dedup_first(df, "t")) == [1, 2]
    assert joins.dedup_first(df, "t").columns == ["id", "t"]
