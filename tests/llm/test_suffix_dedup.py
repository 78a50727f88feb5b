"""Removal of repeated byte strings, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sieve.llm import _text, suffix_dedup


def brute(texts):
    """texts in order -> (n_bytes, n_removed, n_spans, sha) each."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (12, 20, 30, 60, 200)]
    line = prose(9)  # a common line that is too short by itself
    texts = [None, "", "a" * 99, "a" * 100, "a" * 350, "ab" * 200, shared[4], shared[4]]
    for _ in range(60):
        parts = [prose(r.randint(1, 40)) if r.random() < 0.5 else r.choice([*shared, line]) for _ in range(r.randint(1, 8))]
        texts.append(r.choice([" ", "\n", ""]).join(parts))
    for _ in range(12):  # near copies
        t = list(texts[20] + shared[3])
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("xyz")
        texts.append("".join(t))
    texts.append(texts[9])
    return texts


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 3)])
def test_removed_bytes(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = sample(seed)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, anchor int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_bytes(df).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, (i, texts[i])


def test_repeated_and_null_ids(spark):
    texts = sample(3)[:30]
    ids = [i // 2 if i % 5 else None for i in range(30)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    out = suffix_dedup.removed_bytes(df).collect()
    assert len(out) == 30
    # whatever the order among equal ids, the strings left are the same number of distinct ones
    assert sum(r.n_bytes for r in out) == sum(len((t or "").encode()) for t in texts)
    assert suffix_dedup.removed_bytes(df.where("false")).count() == 0


def test_remove_repeats_keeps_whole_characters(spark):
    texts = sample(4)
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    for i, (n, removed, _, sha) in enumerate(brute(texts)):
        if n and removed == n:
            assert i not in out
        elif texts[i] is None:
            assert out[i].text is None
        else:
            assert out[i].n_chars == len(out[i].text)
            assert n - removed <= len(out[i].text.encode()) <= n - removed + 20
            if removed == 0:
                assert out[i].text == texts[i]


def brute_factors(raw, starts, depth):
    def shared(i, j):
        k = 0
        while k < depth and raw[i + k] == raw[j + k]:
            k += 1
        return k

    return [max((shared(i, j) for j in starts[:k]), default=0) for k, i in enumerate(starts)]


@pytest.mark.parametrize("letters,depth,step", [(2, 10, 1), (1, 20, 1), (2, 40, 3), (3, 100, 1), (26, 9, 1)])
def test_longest_previous_factors_against_brute_force(letters, depth, step):
    r = np.random.default_rng(letters)
    data = r.integers(97, 97 + letters, 500).astype(np.uint8)
    data[300:420] = data[100:220]
    data[60:75] = data[300:315]
    starts = np.arange(0, 500 - depth + 1, step)
    assert suffix_dedup.longest_previous(data, starts, depth).tolist() == brute_factors(data.tobytes(), starts.tolist(), depth)


@pytest.mark.parametrize("values", [range(300), range(300, 0, -1), [*range(1, 300), 0], [5, 3, 4, 1, 2, 9, 8, 7, 6, 0]])
def test_previous_smaller(values):
    v = np.array(values)
    want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
    assert suffix_dedup.previous_smaller(v).tolist() == want


def removed_by_kernels(batches):
    """(key, byte) removed, from the kernels run one after another on Arrow batches (key, text)."""
    order = [("anchor", "ascending"), ("context", "ascending"), ("key", "ascending"), ("place", "ascending")]
    rows = pa.Table.from_batches(suffix_dedup._anchors(batches)).sort_by(order)
    marks = pa.Table.from_batches(suffix_dedup._classify(rows.to_batches(max_chunksize=7))).to_pylist()
    gone = [m for m in marks if m["anchor"] is None]
    wanted = {}
    for m in marks:
        if m["anchor"] is not None:
            wanted.setdefault(m["key"], []).append({"start": m["start"], "end": m["end"], "anchor": m["anchor"], "hot": False})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("anchor", pa.int64()), ("hot", pa.bool_())]))
    texts = {k: t for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    picked = [pa.record_batch({"key": pa.array([k]), "text": pa.array([texts[k]], pa.string()), "open": pa.array([w], kind)}) for k, w in wanted.items()]
    pieces = pa.Table.from_batches(suffix_dedup._extract(picked)).sort_by([("anchor", "ascending"), ("key", "ascending"), ("start", "ascending")])
    gone += pa.Table.from_batches(suffix_dedup._factors(pieces.to_batches())).to_pylist()
    return {(g["key"], i) for g in gone for i in range(g["start"], g["end"])}


def brute_removed(texts):
    seen, out = set(), set()
    for k, t in enumerate(texts):
        b = (t or "").encode()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                out |= {(k, j) for j in range(i, i + 100)}
            seen.add(b[i : i + 100])
    return out


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 150)
    texts = sample(5)
    texts += ["".join(t or "" for t in texts[20:40]), texts[8] * 5, "".join(t or "" for t in texts[30:50])]  # far longer than four blocks
    alone = [pa.record_batch({"key": pa.array([k]), "text": pa.array([t], pa.string())}) for k, t in enumerate(texts)]
    assert max(len(list(suffix_dedup._pieces(b))) for b in alone) > 4
    assert removed_by_kernels(alone) == brute_removed(texts)


def test_contexts_with_one_hash_in_a_batch(monkeypatch):
    monkeypatch.setattr(_text.Loads, "hash", lambda self, start, end: (end - start).astype(np.uint64))
    texts = sample(6)
    batch = pa.record_batch({"key": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    assert removed_by_kernels([batch]) == brute_removed(texts)


def test_repeated_and_null_ids_against_brute_force(spark):
    texts = sample(7)[:40]
    ids = [i // 2 if i % 5 else None for i in range(40)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    # rows stand in the order of (id, hash of the text), null ids last; the hash is Spark's
    from pyspark.sql import functions as F

    order = [tuple(r) for r in df.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text").collect()]
    want = sorted((str(i), *x) for (i, _), x in zip(order, brute([t for _, t in order])))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in suffix_dedup.removed_bytes(df).collect()) == want
