"""Operators that judge or encode one text at a time, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from sieve.llm import bpe, decontaminate, quality_rules, token_counts, token_files, url_filter
from sieve.llm.queries import tokenizer

RNG = random.Random(11)
PARTS = ["the ", "of\t", "Straße ", "niño\n", "ab", " ", "\n", "\n\n", "x'd ", "##", "it's ", "中文 ", "é", "12 ", "🙂 ", "line one\n", "\x0b", "\xa0", "<|endoftext|>"]
TEXTS = [None, "", " ", "\n", "a", "the the the the", "a" * 3000, ("word " * 3000), "x y z\n" * 60, *("".join(RNG.choice(PARTS) for _ in range(RNG.randint(1, 200))) for _ in range(120))]
TEXTS += TEXTS[5:9]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, RNG.choice(["en", None, "zz"]), "src", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string, ids long").repartition(3)


def empty(docs):
    return docs.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(docs):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, tokenizer("piece_bpe_32k.model")).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        w = words(text)
        windows = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        hit = {k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
        lines, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)
        r = got[i]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty(docs), tokenizer("piece_bpe_32k.model")).count() == 0


def test_fertility_figures(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    for r in quality_rules.quality_rules(docs, tokenizer("piece_bpe_32k.model"), lang_col=None).collect():
        ids = [i for w in words(TEXTS[r.doc_id]) for i in model.encode(w)]
        assert r.n_tokens == len(ids)
        if len(ids) > 1:
            assert r.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
            n = collections.Counter(ids).values()
            entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in n)
            assert r.evenness == pytest.approx(entropy / math.log2(min(len(ids), 400)), abs=1e-9)
            assert r.chars_per_token == pytest.approx(r.word_chars / len(ids))


def test_keep_good_hands_on_whole_rows(docs):
    model = tokenizer("piece_bpe_32k.model")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, model, min_words=2).where("kept").collect()}
    rows = quality_rules.keep_good(docs, model, min_words=2)
    assert rows.columns == docs.columns
    assert {r.doc_id for r in rows.collect()} == kept


def test_bpe_equals_library(docs, spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    want = [model.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    encoded = bpe.encode(docs, path)
    assert {r.doc_id: r.ids for r in encoded.collect()} == dict(enumerate(want))
    assert {r.doc_id: r.text for r in bpe.decode(encoded, path).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    for r in bpe.round_trip(docs, path).collect():
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty(docs), path).count() == 0
    assert bpe.load(path).decode([0, 200, 201]) == model.decode([0, 200, 201], skip_special_tokens=False)


def test_bpe_pretokens_of_all_characters():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.load(path)
    texts = ["".join(f"a{chr(i)}b{chr(i)} '{chr(i)}" for i in range(s, s + 64) if not 0xD800 <= i < 0xE000) for s in range(0, 0x30000, 64)]
    data, offsets = bpe_block(texts)
    ids, n = own.encode(data, offsets)
    assert ids.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def bpe_block(texts):
    from sieve.llm._text import column_bytes

    return column_bytes(pa.array(texts))


def test_token_files(docs, spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    model, at = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in token_files.token_files(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(raw)), t
        at += len(ids)
    assert len(got) == len(TEXTS)
    assert token_files.token_files(empty(docs), path).count() == 0


def test_token_files_in_many_shards_with_null_and_repeated_keys(spark):
    path = tokenizer("word_bpe_49k.json")
    rows = [(None, "null key"), (-5, "minus"), *[(i, f"text {i} " * (i % 7)) for i in range(300)], (17, "again"), (17, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = token_files.shared_folder(spark) + "/many"
    shards = token_files.write_token_files(df, path, folder, shard_bytes=400)
    assert shards.count() > 5 and shards.agg({"documents": "sum"}).first()[0] == len(rows)
    out = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0) if k is not None else (False, 0))
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]
    model = token_files._encoder(path).model
    reader = token_files.Reader(token_files.qualified(spark, folder), keep=3)
    asked = [299, None, -5, 0, 300, 17, *range(0, 300, 11), -6, 2**40]
    texts = dict(reversed(rows)) | {None: "null key"}
    for key, ids in zip(asked, reader.get(asked)):
        if key not in texts:
            assert ids is None
        elif key == 17:
            assert ids.tolist() in [[*model.encode(t, add_special_tokens=False).ids, 1] for t in ("again", "text 17 " * 3)]
        else:
            assert ids.tolist() == [*model.encode(texts[key], add_special_tokens=False).ids, 1]


def test_many_rows_of_one_key_are_many_shards(spark):
    path = tokenizer("word_bpe_49k.json")
    rows = [(7 if i % 3 else i, f"number {i} " * 5, "x") for i in range(400)] + [(None, f"null {i}", "y") for i in range(200)] + [(7, "same", "z")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    folder = token_files.shared_folder(spark) + "/one"
    shards = token_files.write_token_files(df, path, folder, shard_bytes=1500).orderBy("shard").collect()
    assert sum(r.first_key == 7 for r in shards) > 2 and sum(r.first_key is None for r in shards) > 1
    out = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0) for r in out)) == [(r.doc_id is not None, r.doc_id or 0) for r in out] and len(out) == len(rows)
    reader = token_files.Reader(token_files.qualified(spark, folder))
    first = next(r for r in out if r.doc_id == 7)
    assert zlib.crc32(reader.get([7])[0].astype("<u4").tobytes()) == first.ids_crc32
    assert reader.get([8, 6, None])[0] is None and reader.get([6])[0] is not None and reader.get([None])[0] is not None


def test_perfect_hash():
    import numpy as np

    keys = [*range(0, 5000, 3), None, -1, 2**62]
    shard = token_files.Shard(token_files.pack(keys, [np.array([i], np.uint32) for i in range(len(keys))]))
    assert shard.find(keys).tolist() == list(range(len(keys)))
    assert sorted(shard.slots.tolist()) == list(range(len(keys)))
    assert (shard.find([1, 2, -2, 5000, 2**61]) == -1).all()


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    for rule in token_counts.RULES:
        got = {r.doc_id: r for r in token_counts.count_sections(docs, path, rule=rule).collect()}
        assert len(got) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            lines = re.findall(r"[^\n]*\n|[^\n]+$", t or "")
            bounds, at = [], 0
            for line in lines:
                bounds.append((at, at + len(line)))
                at += len(line)
            e = model.encode(t or "", add_special_tokens=False)
            counts, crossing = [0] * len(lines), 0
            for a, b in e.offsets:
                over = [max(0, min(b, y) - max(a, x)) for x, y in bounds]
                mine = [k for k, o in enumerate(over) if o]
                crossing += len(mine) > 1
                counts[mine[0] if rule == "start" else mine[-1] if rule == "end" else over.index(max(over))] += 1
            r = got[i]
            assert (r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) == (len(e.ids), len(lines), crossing, counts), (rule, t)
            assert r.section_chars == [len(x) for x in lines]


def test_token_counts_of_fields(docs):
    path = tokenizer("byte_bpe_50k.json")
    rows = token_counts.count_fields(docs, path, ["lang", "text", "n_tokens"]).collect()
    assert len(rows) == len(TEXTS) and all(sum(r.field_tokens) == r.n_tokens and len(r.field_tokens) == 3 for r in rows)


def brute_hits(text, items):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, names = cut(text), set(), set()
    for name, t in items:
        v = cut(t)
        n = min(10, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in grams:
                names.add(str(name))
                hit |= set(range(j, j + n))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("limit", [1 << 20, 0])  # broadcast, and dealt by hash
def test_contamination(spark, limit):
    r = random.Random(3)
    vocab = ["Alpha", "beta", "the", "of", "ñandú", "x1", "中", "Z"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(12, None), (13, ""), (14, "only once here")]
    texts = [None, "", "alpha", "ONLY-once; here!", *[" , ".join(r.choice(vocab) for _ in range(r.randint(1, 60))) for _ in range(80)]]
    for k in range(20):
        texts.append("noise " * k + (items[k % 12][1] or "") + " tail")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for out in decontaminate.contamination(docs, bench, limit=limit).collect():
        n, hit, names = brute_hits(texts[out.doc_id], items)
        assert (out.n_words, out.n_hit, out["items"], out.contaminated) == (n, hit, names, hit > 0), texts[out.doc_id]
        assert out.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, limit=limit).collect()}
    assert clean == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, limit=limit).collect()}
    assert len(cut) == len(texts) and cut[0] is None
    for i, t in enumerate(texts):
        n, hit, _ = brute_hits(t, items)
        assert brute_hits(cut[i], [])[0] == n - hit
        if not hit:
            assert cut[i] == t
    assert decontaminate.contamination(docs, bench.where("false"), limit=limit).where("contaminated").count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "://", "http://ORG/", "https://a.example.org/es/x", "http://example.org/en/1?x#y", "http://notexample.org/es/", "ftp://x.com/fr/", "x://com/de/1", "http://a.com:80/de/", "http://b.net?u=://org/", "http://org", "http://bad.net/p"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, listed=["bad.net/p"]).orderBy("page_id").collect()]
    assert got[:4] == [("", "", None, "allow")] * 4
    assert got[4:] == [
        ("org", "/", "org/", "allow"),
        ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/1", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("x.com", "/fr/", "com/fr/", "allow"),
        ("com", "/de/1", "com/de/", "block"),
        ("a.com:80", "/de/", None, "allow"),
        ("b.net", "", None, "allow"),
        ("org", "", None, "allow"),
        ("bad.net", "/p", None, "block"),
    ]


def judged_by_hand(url, rules, listed):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    m = re.match(r"(?s)(?:(?!://).)*://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(low), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[3], max(fit)[4]
    entries = {(x.partition("/")[0].translate(low) + x[len(x.partition("/")[0]) :]) for x in listed if x}
    return host, path, None, "block" if host and (host in entries or host + path in entries) else "allow"


LISTED = ["bad.net/p", "ORG", None, "", "Ärger.com", "b.a/X/y", "B.a", "com/x", "n.et", "n.et/1", "é.org/ß"]


@pytest.mark.parametrize("kind,limit", [("list", 1 << 20), ("list", -1), ("table", 1 << 20), ("table", -1)])
def test_urls_against_a_list_of_any_size(spark, kind, limit, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_BYTES", 64)
    r = random.Random(5)
    hosts = ["bad.net", "org", "Ärger.com", "ärger.com", "B.A", "b.a", "a.b.a", "n.et", "x.example.org", "com", "é.org", "", "a..com", "q.r.fr."]
    urls = [f"{r.choice(['http', 'x', ''])}{r.choice(['://', '://', '://', ':/', ''])}{r.choice(hosts)}{r.choice(['', '/', '/p', '/X/y', '/x', '/1', '/es/', '/en/1/2', '/ß'])}{r.choice(['', '?q=://b.a/', '#z', '?'])}" for _ in range(300)]
    urls += [None, "", "://", "http:///x", "http://b.a/" + "y" * 5000, "://bad.net/p\nq", "HTTP://BAD.NET/p"] + urls[:20]
    rules = [*url_filter.RULES, ("allow", "b.a", "/X/"), ("block", "b.a", "/X/"), ("allow", "a.b.a", ""), ("block", "é.org", "/ß")]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string").repartition(3)
    extra = [f"filler{i}.net/{i}" for i in range(50)]
    listed = LISTED + extra if kind == "list" else spark.createDataFrame([(x,) for x in LISTED + extra + LISTED], "entry string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(df, rules=rules, listed=listed, limit=limit).collect()}
    want = {i: judged_by_hand(u, rules, LISTED) for i, u in enumerate(urls)}
    assert got == want
    assert len({w[2] for w in want.values()}) > 5 and sum(w[2] is None and w[3] == "block" for w in want.values()) > 20
    assert url_filter.filter_urls(df.where("false"), listed=listed, limit=limit).count() == 0
    empty = [] if kind == "list" else listed.where("false")
    assert {x.page_id: x.verdict for x in url_filter.filter_urls(df, rules=[], listed=empty, limit=limit).collect()} == dict.fromkeys(range(len(urls)), "allow")


def test_digest_index_confirms_strings():
    index = url_filter.DigestIndex(url_filter.build_index([b"a", b"b", b"c"]))
    import numpy as np

    same = np.full(2, index.digests[0])  # both probes claim the digest of one stored string
    stored = index.string(0)
    assert index.place([stored, b"zz"], same).tolist() == [0, -1]
    assert url_filter.DigestIndex(url_filter.build_index([])).place([b"x"]).tolist() == [-1]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contamination_by_items_without_an_id(spark, limit):
    docs = spark.createDataFrame([(0, "so one two three it is"), (1, "four five, one two three"), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (None, "One Two"), (7, "four five")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontaminate.contamination(docs, bench, limit=limit).collect()}
    assert got == {0: (3, 1, [], True), 1: (5, 2, ["7"], True), 2: (0, 0, [], False)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench, limit=limit).collect()] == [2]
    assert decontaminate.remove_spans(docs, bench, limit=limit).where("doc_id = 0").first().text == "so  it is"
