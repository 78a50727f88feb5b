"""Different words with one hash: the polynomial hash's known clash, and hashes made to clash."""

import hashlib
import re

import numpy as np
import pytest

from sieve.llm import _text, bpe, decontaminate, ngram_join, quality_rules, token_counts, token_files
from sieve.llm.queries import tokenizer


def thue_morse():
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


ONE, TWO = thue_morse()
TEXTS = [ONE, TWO, f"{ONE} {TWO}", f"{TWO}\n{ONE}", f"{ONE}\n{TWO}\n{ONE}", "ab cd ef gh ab cd ef", "cd ab gh ef", "x1 y2 x1 z3"]


@pytest.fixture(params=["as it is", "one hash a length"])
def hashes(request, monkeypatch):
    if request.param == "one hash a length":
        monkeypatch.setattr(_text.Loads, "hash", lambda self, start, end: _text.mix((end - start).astype(np.uint64)))
    return request.param


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_the_two_words_clash_in_the_polynomial_hash():
    data, offsets = arrays([ONE, TWO])
    h = _text.Prefix(data).hash(offsets[:-1], offsets[1:])
    assert h[0] == h[1]
    h = _text.Loads(data).hash(offsets[:-1], offsets[1:])
    assert h[0] != h[1]


def test_distinct(hashes):
    data, offsets = arrays(["ab", "cd", "ab", "", "abcdefghij", "abcdefghik", "abcdefghij", ONE, TWO, ONE, "cd", ""])
    found = _text.distinct(data, offsets[:-1], offsets[1:])
    got = [data[s : s + z].tobytes().decode() for s, z in zip(found.start, found.size)]
    assert sorted(got) == sorted({"", "ab", "cd", "abcdefghij", "abcdefghik", ONE, TWO})
    assert [got[e] for e in found.entry] == ["ab", "cd", "ab", "", "abcdefghij", "abcdefghik", "abcdefghij", ONE, TWO, ONE, "cd", ""]


def test_byte_bpe(hashes):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    model = bpe.ByteBpe(tokenizer("byte_bpe_50k.json"))
    for _ in range(2):  # the second time from the cache
        for batch in (TEXTS, TEXTS[::-1]):
            ids, n = model.encode(*arrays(batch))
            for text, own in zip(batch, np.split(ids, np.cumsum(n)[:-1])):
                assert own.tolist() == library.encode(text, add_special_tokens=False).ids
                assert model.decode(own) == text


def test_word_encoder(hashes):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    model = token_files.WordEncoder(tokenizer("word_bpe_49k.json"))
    for _ in range(2):
        ids, n = model.encode(*arrays(TEXTS))
        for text, own in zip(TEXTS, np.split(ids, np.cumsum(n)[:-1])):
            assert own.tolist() == library.encode(text, add_special_tokens=False).ids


def test_quality_counts(hashes):
    c = quality_rules.base_counts(*arrays(TEXTS))
    for i, text in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        hit = {k for j, x in enumerate(windows) if windows.count(x) > 1 for k in range(j, j + 3)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert (c["n_words"][i], c["n_repeat_words"][i], c["n_dup_lines"][i]) == (len(w), len(hit), len(lines) - len(set(lines)))


def test_rows_with_one_hash(monkeypatch):
    monkeypatch.setattr(quality_rules, "mix", lambda h: h * np.uint64(0))
    doc, value = np.array([0, 0, 0, 1, 1, 1]), np.array([5, 6, 5, 5, 7, 7])
    twice, later = quality_rules._again(doc, value)
    assert twice.tolist() == [True, False, True, False, True, True]
    assert later.tolist() == [False, False, True, False, False, True]


def test_fertility(hashes):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    data, offsets = arrays(TEXTS)
    n, _, _ = quality_rules.fertility(quality_rules.base_counts(data, offsets), data, quality_rules.Fertility(tokenizer("piece_bpe_32k.model")))
    assert n.tolist() == [sum(len(model.encode(w)) for w in t.split()) for t in TEXTS]


def test_sections(hashes):
    model = bpe.ByteBpe(tokenizer("byte_bpe_50k.json"))
    data, offsets = arrays(TEXTS)
    n, tokens, _, _ = token_counts.attribute(model, data, offsets, token_counts._line_starts(data, offsets), "start")
    assert n.sum() == tokens.sum() == len(model.encode(data, offsets)[0])


def test_shingles_of_the_two_words():
    one, two = ngram_join.shingle_sets(*arrays([ONE, TWO]), 4)
    assert len(one) == len(two) == 1 and one[0] != two[0]


@pytest.mark.parametrize("limit", [1 << 28, -1])
def test_decontamination(spark, limit):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    items = spark.createDataFrame([("one", ONE), ("few", "ab cd")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items, limit=limit).collect()}
    assert got == {0: (1, ["one"]), 1: (0, []), 2: (1, ["one"]), 3: (1, ["one"]), 4: (2, ["one"]), 5: (4, ["few"]), 6: (0, []), 7: (0, [])}
    assert hashlib.sha256(b"one").hexdigest() in {r.items_sha256 for r in decontaminate.contamination(docs, items, limit=limit).collect()}


def test_windows_with_one_hash(monkeypatch):
    import pyarrow as pa

    texts = ["a b c d", "b c d e f", "x y", "e", "a b c d", "q a b c z e x y x"]
    items = ["a b c", "b c d e", "x y", "zz", "c d e"]
    usual = [x[3:] for x in (decontaminate.Windows(list("ABCDE"), pa.array(items), 3).scan(*arrays(texts)),)][0]
    monkeypatch.setattr(decontaminate, "window_hash", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    hit, pairs = decontaminate.Windows(list("ABCDE"), pa.array(items), 3).scan(*arrays(texts))[3:]
    assert hit.tolist() == usual[0].tolist() and pairs.tolist() == usual[1].tolist()
    assert pairs.tolist() == [[0, 0], [0, 1], [1, 1], [1, 4], [2, 2], [4, 0], [4, 1], [5, 0], [5, 2]]


def test_windows_found_by_a_wrong_hash():
    import pyarrow as pa

    found = [[{"at": 0, "n": 2, "item": "A", "gram": b"a b"}, {"at": 1, "n": 2, "item": "B", "gram": b"b d"}], None, [{"at": 0, "n": 1, "item": None, "gram": b"q"}]]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("item", pa.string()), ("gram", pa.binary())]))
    block = pa.record_batch({"text": ["A, b c", "b d", "Q"], "found": pa.array(found, kind)})
    data, offsets = arrays(["A, b c", "b d", "Q"])
    hit, lists = decontaminate._compared(block, 1, data, offsets)[3:]
    assert hit.tolist() == [True, True, False, False, False, True] and lists == [["A"], [], [None]]
