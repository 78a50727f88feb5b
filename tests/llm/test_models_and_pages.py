"""Quality classifier by held-out accuracy, HTML extraction by pages of known text."""

import itertools
import random
import time
import zlib

import numpy as np
import pytest

from sieve.llm import html_extract, quality_classifier


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    good = [f"word{i}" for i in range(300)]
    rows, labels = [(None, "null id", 1), (9001, None, 1), (9002, "", 1), (9003, " \n", 1), (9004, "x" * 50_000, 1)], []
    for i in range(700):
        quality = int(r.random() < 0.7)
        text = " ".join(r.choice(good) for _ in range(r.randint(5, 80)))
        if not quality:
            text = r.choice([text.replace(" ", "%%% "), text.upper() + "!!", " ".join([r.choice(good)] * 60)])
        rows.append((i, text, 5))
        if i % 5:
            labels += [(i, quality)] * (1 + (i % 7 == 0))
    labels += [(None, 0), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score long").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_classifier(spark, corpus):
    docs, labels, truth = corpus
    weights = quality_classifier.fit(docs, labels, max_rows=400)
    out = {r.doc_id: r for r in quality_classifier.classify(docs, weights).collect()}
    assert len(out) == 705 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [i for i in range(700) if i in truth and zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in range(700) if out[i].held_out} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([out[i].predicted == truth[i] for i in held if truth[i] is not None]) > 0.95
    assert out[9001].score == out[9002].score == out[9003].score and out[None].held_out is False
    assert quality_classifier.classify(docs.where("false"), weights).count() == 0


def test_held_out_labels_are_never_used(spark, corpus):
    docs, labels, _ = corpus
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    assert (quality_classifier.fit(docs, labels, max_rows=200) == quality_classifier.fit(docs, flipped, max_rows=200)).all()


def test_classifier_without_labels(spark, corpus):
    docs, labels, _ = corpus
    assert {r.score for r in quality_classifier.classify(docs, quality_classifier.fit(docs, labels.where("false"))).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="x">
<header><a href=/>Site</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies, accept.</p><button>ok</button></div>
<!-- ad --><div class="ad">Buy now, cheap things.</div>
<article><h1>A  title &amp; more</h1><p><b>First &lt;para&gt;,<br>with a break and &#233;t&eacute; in it, long enough to read.<br><p>Second one:
spread over   lines, with <a href=x>a link</a>, and so on. It goes on for a while.</p><ul><li>item one here<li>item two here</ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=q>Something else</a></ul></aside><form class="newsletter"><label>Mail</label><input><p>Subscribe to us</p></form>
<section id="comments"><h3>Comments</h3><div class="comment">I like it, thanks.</div></section><footer>&copy; 2024 Site</footer></body></html>"""


def test_main_text(spark):
    pages = [(0, "u", PAGE), (1, "u", None), (2, None, ""), (3, "u", "just &amp; text"), (4, "u", "<p>open <b>tags <p>two"), (5, "u", "<div><<>></div"), (6, "u", "<script>only"), (7, "u", PAGE)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.main_text(df).collect()}
    assert len(out) == len(pages)
    assert out[0].text == "A title & more\nFirst <para>, with a break and été in it, long enough to read.\nSecond one: spread over lines, with a link, and so on. It goes on for a while.\nitem one here\nitem two here"
    assert out[7].text == out[0].text
    assert [out[i].text for i in (1, 2, 6)] == ["", "", ""]
    assert out[3].text == "just & text"
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert html_extract.main_text(df.where("false")).count() == 0


def test_unseen_training_pages():
    trees, right = html_extract.model(), 0
    pages = list(html_extract.training_pages(150, seed=77))
    for html in pages:
        want = "\n".join(t.replace(html_extract._MARK, "") for _, t, _ in html_extract.Page(html).blocks if html_extract._MARK in t)
        right += html_extract.extract([html.replace(html_extract._MARK, "")], trees)[0] == want
    assert right > 0.9 * len(pages)


def total(parent, odds, label):
    """Value of a choice, None if it contradicts itself."""
    out = 0.0
    for i, x in enumerate(label):
        up = label[parent[i]] if i else html_extract._MIXED
        if up != html_extract._MIXED and x != up:
            return None
        out += {html_extract._MAIN: odds[i], html_extract._REST: -odds[i], html_extract._MIXED: abs(odds[i]) - html_extract._MIX_COST}[x]
    return out


def test_choice_is_the_best_that_does_not_contradict():
    r = random.Random(1)
    for n in (1, 2, 4, 6, 7, 7, 7):
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        odds = np.array([r.gauss(0, 3) for _ in range(n)])
        label = html_extract.choose(parent, odds)
        best = max(x for y in itertools.product(range(3), repeat=n - 1) if (x := total(parent, odds, (html_extract._MIXED, *y))) is not None)
        assert total(parent, odds, label) == pytest.approx(best)
    for html in html_extract.training_pages(30, seed=3):
        page = html_extract.Page(html)
        odds = np.array([r.gauss(0, 3) for _ in page.tags])
        assert total(page.parent, odds, html_extract.choose(page.parent, odds)) is not None


def test_deep_and_long_pages():
    deep, words, unclosed, signs = html_extract.extract(
        ["<div>" * 3000 + "deep" + "</div>" * 10, "<p>" + "x " * 200_000, "<a href='unclosed " + "y" * 10_000, "<" * 20_000], html_extract.model()
    )
    assert deep in ("", "deep")
    assert words == " ".join(["x"] * 200_000) or words == ""
    assert unclosed == "" or unclosed.endswith("y" * 10_000)
    assert signs == "<" * 20_000


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 16_000 + "</section>" * 16_000,
        "<b><div>" + "<i>" * 16_000 + "</b>" * 16_000,
        "<li><ul>" + "<div>" * 16_000 + "<li>x</li>" * 16_000,
        "<td>" + "<div>" * 16_000 + "<dd>x" * 16_000,
        "<a '" * 40_000 + '"',
        '<a "' * 40_001,
        "<h1>" + "<div>" * 16_000 + "</h2>" * 16_000,
    ],
)
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.Page(page)
    assert time.process_time() - began < 3


def blocks_of(html):
    page = html_extract.Page(html)
    return [t for _, t, _ in page.blocks]


def test_blocks_of_broken_and_implied_markup():
    assert blocks_of("<p>a<p>b<div>c</p>d</div>e") == ["a", "b", "cd", "e"]
    assert blocks_of("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>f") == ["a", "b", "c", "d", "e", "f"]
    assert blocks_of("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert blocks_of("<h2>a</h3>b") == ["a", "b"]
    assert blocks_of("<b>a<div>b</b>c</div>d") == ["a", "bc", "d"]
    assert blocks_of("a < b &lt; c <1> <math>x</math> <object>y</object><script>z</script>") == ["a < b < c <1> x y"]
    assert blocks_of("x<a title='>'>y</a><!-- <p>no --> z") == ["xy z"]


def hand_pages(n, seed):
    """(html, main text) of pages put together here, apart from the module's own generator."""
    r = random.Random(seed)
    nouns = "river market council teacher winter engine harvest bridge library village season letter history station garden doctor".split()
    verbs = "opened closed reached followed measured changed repaired described found carried".split()

    def sentence():
        return f"The {r.choice(nouns)} near the {r.choice(nouns)} {r.choice(verbs)} {r.randint(2, 90)} of the {r.choice(nouns)}s, and the {r.choice(nouns)} {r.choice(verbs)} it again."

    for _ in range(n):
        head = f"The {r.choice(nouns)} and the {r.choice(nouns)}"
        paragraphs = [" ".join(sentence() for _ in range(r.randint(2, 6))) for _ in range(r.randint(3, 7))]
        body = "".join(f"<p>{p}</p>\n" for p in paragraphs)
        menu = "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in r.sample(nouns, 5))
        around = {
            "top": f'<header class="site-header"><a href="/">Daily {r.choice(nouns).title()}</a></header><nav class="main-nav"><ul>{menu}</ul></nav>',
            "notice": '<div class="cookie-banner"><p>This site uses cookies to work. You can refuse them.</p><button>Accept</button></div>' if r.random() < 0.5 else "",
            "side": f'<aside class="sidebar"><h3>Most read</h3><ul>{menu}</ul></aside>' if r.random() < 0.6 else "",
            "comments": '<section class="comments"><h3>2 comments</h3><div class="comment"><p>Thank you, that was good to read.</p></div><div class="comment"><p>I was there and saw it.</p></div></section>' if r.random() < 0.5 else "",
            "mail": '<form class="newsletter-form"><label>E-mail</label><input name="m"><button>Sign up</button></form>' if r.random() < 0.5 else "",
        }
        yield (
            f"<!DOCTYPE html><html><head><title>{head} - Daily</title></head><body>{around['top']}{around['notice']}<main><article><h1>{head}</h1>{body}</article>{around['side']}</main>"
            f"{around['comments']}{around['mail']}<footer><p>&copy; 2023 Daily. All rights reserved.</p></footer></body></html>"
        ), "\n".join([head, *paragraphs])


def test_pages_of_known_main_text():
    pages = list(hand_pages(200, 4))
    got = html_extract.extract([h for h, _ in pages], html_extract.model())
    assert sum(g == t for g, (_, t) in zip(got, pages)) >= 196


def test_classifier_learns_from_up_to_6000_rows(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality_classifier, "train", lambda texts, labels: sizes.append(len(labels)))
    docs = spark.range(10_000).selectExpr("id as doc_id", "'a text' as text", "cast(id % 2 as int) as quality")
    quality_classifier.fit(docs, docs)
    assert sizes == [6000]
