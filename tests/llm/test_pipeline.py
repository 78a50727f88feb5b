"""The pipeline against a brute-force version on a small corpus."""

import hashlib
import random

import pytest

from sieve.llm import quality_rules
from sieve.llm._text import column_bytes
from sieve.llm.queries import tokenizer
from test_ngram_join import brute as brute_components
from test_suffix_dedup import brute as brute_removed
from test_text_operators import brute_hits


def corpus():
    r = random.Random(8)
    syllables = "an er th on re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de".split()
    vocab = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, prose(r.choice([12, 20, 4]))) for i in range(6)] + [(6, None), (7, "")]
    passage = prose(70)
    texts = [None, "", "too short", "x " * 200, prose(60).replace(" ", "%%% "), "###"]
    for i in range(25):
        t = prose(r.randint(60, 200))
        if i % 5 == 0:
            t += "\n" + passage
        if i % 6 == 0:
            t += "\n" + items[i % 4][1]
        texts.append(t)
        for _ in range(i % 3):
            w = t.split(" ")
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [texts[8], texts[8]]
    r.shuffle(texts)
    return texts, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer

    import corpus_pipeline

    texts, items = corpus()
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    block = pa.record_batch({"lang": ["en"] * len(texts)})
    kept = quality_rules.judge(block, *column_bytes(pa.array(texts, pa.string())), quality_rules.Fertility(tokenizer("piece_bpe_32k.model")), "lang", 50, 50, quality_rules.BANDS)["kept"]
    docs = [(i, t) for (i, t), k in zip(enumerate(texts), kept) if k]
    assert 10 < len(docs) < len(texts)
    first = brute_components([t for _, t in docs], 5, 80)
    docs = [d for j, d in enumerate(docs) if first[j][1] == j]
    cut = []
    seen = set()
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(b[j : j + 100])
        left = bytes(x for x, g in zip(b, gone) if not g).decode()  # this corpus is ASCII
        if left:
            cut.append((i, left))
    assert any(n for _, n, _, _ in brute_removed([t for _, t in docs]))
    docs = [(i, t) for i, t in cut if not brute_hits(t, items)[1]]
    assert 5 < len(docs) < len(cut)
    model = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = {}
    for i, t in docs:
        ids = model.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, k, tmp_path):
    import corpus_pipeline

    texts, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), "own", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, key string, _key int, component int")
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.dtypes == docs.dtypes
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert corpus_pipeline.STAGES[k][1](spark, docs.where("false"), str(tmp_path)).count() == 0
