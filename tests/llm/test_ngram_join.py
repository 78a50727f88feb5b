"""Components of the n-gram join, against brute force over all pairs."""

import random

import numpy as np
import pytest

from sieve.llm import ngram_join


def shingles(text, size):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def sample(seed, families=14):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ünï", "THE", "the"]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    passage = prose(80)
    texts = [None, "", " \n", "one", "One", "two words", "TWO  words", "a b c", "a b c d", "a b c d e"]
    for f in range(families):
        base = prose(r.choice([4, 8, 30, 100, 300]))
        if f % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(r.randint(1, 14)):
            t = list(base)
            for _ in range(r.randint(0, 1 + len(t) // 60)):
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 1)] = prose(r.randint(0, 2))
            texts.append(r.choice([" ", "\n"]).join(t))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,size,percent,part,few,weight", [(1, 4, 85, 4096, 16, 1 << 22), (2, 5, 80, 4096, -1, 1 << 22), (3, 4, 85, 3, 16, 900), (4, 3, 60, 2, -1, 500)])
def test_components(spark, seed, size, percent, part, few, weight, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "FEW", few)  # below 0: every group brings sets
    monkeypatch.setattr(ngram_join, "PART_SHINGLES", weight)
    texts = sample(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, size=size, percent=percent).collect()}
    want = brute(texts, size, percent)
    assert len(got) == len(texts)
    assert [got[i] for i in range(len(texts))] == want
    kept = {r.doc_id for r in ngram_join.keep_one(df, size=size, percent=percent).collect()}
    assert kept == {i for i, (_, c) in enumerate(want) if c == i}


def test_copies_in_descending_order_in_files_of_different_sizes(spark, tmp_path):
    texts = sample(6, 6) * 3
    rows = [(i, t) for i, t in enumerate(texts)][::-1]
    for a, b in ((0, 7), (7, len(rows) // 2), (len(rows) // 2, len(rows))):
        spark.createDataFrame(rows[a:b], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    want = brute(texts, 5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id for r in ngram_join.keep_one(df).collect()} == {i for i, (_, c) in enumerate(want) if c == i}


@pytest.mark.parametrize("ids", ["descending", "shuffled"])
def test_ids_out_of_order_in_one_partition(spark, ids):
    texts = sample(8, 6) * 2
    order = list(range(len(texts)))[::-1]
    if ids == "shuffled":
        random.Random(3).shuffle(order)
    df = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 5, 80)


def test_spanning_links_join_what_all_links_join():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([base[r.random(40) < 0.93], r.integers(0, 1 << 63, r.integers(0, 5)).astype(np.uint64)])) for _ in range(80)]
    comp = np.arange(80) // 3
    links = ngram_join.spanning_links(np.full(80, -1), comp, np.concatenate(sets), np.array([len(s) for s in sets]), 80)
    assert len(links) < 80
    root = {c: c for c in comp.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(b)] = find(a)
    got = {c: find(c) for c in root}
    root = {c: c for c in root}
    for i in range(80):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[find(int(comp[i]))] = find(int(comp[j]))
    want = {c: find(c) for c in root}
    assert {(a, b) for a in got for b in got if got[a] == got[b]} == {(a, b) for a in want for b in want if want[a] == want[b]}


def test_null_and_repeated_ids(spark):
    texts = sample(5, 5)
    ids = [None if i % 4 == 0 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    out = ngram_join.ngram_components(df).collect()
    assert len(out) == len(texts)
    groups = {}
    for i, (_, c) in enumerate(brute(texts, 5, 80)):
        groups.setdefault(c, []).append(ids[i])
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None))) for g in groups.values() for i in g)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == want
    assert ngram_join.keep_one(df).count() == len(groups)
    assert ngram_join.ngram_components(df.where("false")).count() == 0


def test_tree_loses_no_pair():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2)
    sets = []
    for _ in range(300):
        keep = r.random(60) < r.choice([0.2, 0.6, 0.95])
        extra = r.integers(0, 1 << 63, r.integers(1, 20)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([base[keep], extra])))
    sizes = np.array([len(s) for s in sets])
    points = ngram_join.count_vectors(np.concatenate(sets), sizes, 16)
    tree = ngram_join.CountTree(points, sizes, 70)
    for i, s in enumerate(sets):
        near = set(tree.query(points[i], int(sizes[i])).tolist())
        for j, t in enumerate(sets):
            common = len(np.intersect1d(s, t))
            if 100 * common >= 70 * (len(s) + len(t) - common):
                assert j in near
        assert len(near) < 300
