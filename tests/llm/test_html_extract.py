import html
import re
import time

import duckdb
import numpy as np
import pytest

from parcelwise.llm import html_extract as X
from parcelwise.llm.boosting import fit
from parcelwise.llm.html_pages import labelled_pages
from parcelwise.llm.html_tree import RUN, parse


@pytest.fixture(scope="module")
def model():
    return X.train()


def runs(text):
    page = parse(text)
    return [t for t, tag in zip(page.text, page.tag) if tag == RUN]


@pytest.mark.parametrize("markup, blocks", [
    ("<p>a<p>b</p>c", ["a", "b", "c"]), ("<p><b>one<br>two\n three</b> &amp;amp; x&nbsp;y</p>", ["one two three &amp; x y"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("a < b <3 <> </> x", ["a < b <3 <> x"]), ("<!-- <p>no</p> --><P CLASS=x>yes</P><!doctype q>", ["yes"]), ("<script>if (a</b) '</p>'</script><style>p{}</style><title>t</title>z", ["z"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<noscript><p>no</p></noscript>x<svg><text>no</text></svg>y", ["xy"]), ("x<!-- never ends", ["x"]), ("x<a href='never ends", ["x"]),
    ("x<script>never ends", ["x"]), ("<div title='a > b'>in</div>out", ["in", "out"]), ("</div></p>a</body></html>b", ["a", "b"]), ("&#x41;&#66;&copy;&bogus; &am<i>p;</i>", ["AB©&bogus; &amp;"]), ("", []), (" \n&nbsp;", []),
])
def test_blocks(markup, blocks):
    assert runs(markup) == blocks


def test_any_markup_is_read_in_linear_time():
    for text in ['<a href="', "<", "<!--", "<div>", "<li>", "<a b=", "<p ", "<td>", "</p>", "&amp", "<a b ", "x<br>", "<ul><li>", "<script></script>"]:
        started = time.time()
        parse(text * 60_000)
        assert time.time() - started < 4, text


def accuracy(model, seed, count=200):
    right = kept = wanted = exact = 0
    for marked in labelled_pages(count, seed):
        page, labels = X.labelled(marked)
        keep = X.decode(page, model.trees.log_odds(X.features(page, model.names)))
        sizes = [(k, bool(w), len(t)) for k, w, t in zip(keep, labels, page.text) if t]
        right += sum(n for k, w, n in sizes if k and w)
        kept += sum(n for k, _, n in sizes if k)
        wanted += sum(n for _, w, n in sizes if w)
        exact += all(k == w for k, w, _ in sizes)
    return right / kept, right / wanted, exact / count


def test_held_out_pages(model):
    precision, recall, exact = accuracy(model, seed=4711)
    assert precision > 0.98 and recall > 0.98 and exact > 0.85


def test_given_pages(model):
    """Pages whose article carries its element: the text is all of it and nothing else."""
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    wanted = []
    for (page,) in rows:
        inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<b>", "", re.sub("<br>", " ", b))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        wanted.append("\n\n".join(b for b in blocks if b))
    assert np.mean([a == b for a, b in zip(model.texts([r[0] for r in rows]), wanted)]) > 0.99


PAGE = """<html><body><div class="cookie-banner"><p>We store cookies on your device to improve it.</p><button>Fine</button></div>
<header class="site-header"><h1>The Daily</h1><nav><a href="/">Home</a> <a href="/w">World</a></nav></header>
<div class="layout"><div class="post-content"><h1>A title &amp; more</h1><p>First <a href="#x">paragraph</a> of the
story, with several words in it.</p><div class="ad-slot">Buy now, it is cheap this week.</div><p>Second paragraph, also of the story and long enough.</p><ul><li>one point</li><li>another point</li></ul></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">Other story</a></li><li><a href="/2">More of it</a></li></ul></aside></div>
<section id="comments" class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this story very much, thank you for it.</p></div><div class="comment"><p>Me too, a fine one.</p></div></section>
<form class="search"><label>Search</label><input><button>Go</button></form><footer>&copy; 2020 The Daily, all rights reserved.</footer></body></html>"""


def test_a_page_with_everything(model):
    assert model.texts([PAGE]) == ["A title & more\n\nFirst paragraph of the story, with several words in it.\n\nSecond paragraph, also of the story and long enough.\n\none point\n\nanother point"]


def likeliest(page, odds):
    """Over all labellings: an element is open exactly if one of its runs is."""
    leaves = [i for i, t in enumerate(page.tag) if t == RUN]
    best = None
    for bits in range(1 << len(leaves)):
        open_ = [any(bits >> n & 1 and i <= leaf < page.end[i] for n, leaf in enumerate(leaves)) for i in range(len(page.tag))]
        cost = sum(np.logaddexp(0, -o if k else o) for o, k in zip(odds, open_))
        if best is None or cost < best[0] - 1e-12:
            best = (cost, open_)
    return best[1]


def test_decoding_is_the_likeliest_consistent_labelling():
    page = parse("<div><p>a</p><ul><li>b<li>c</ul></div>d<nav><div>e</div></nav><hr><section></section>")
    rng = np.random.default_rng(5)
    for _ in range(300):
        odds = rng.normal(0, 2, len(page.tag))
        assert X.decode(page, odds) == likeliest(page, odds)


def test_boosted_trees_learn_a_rule_of_two_columns():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(4000, 5))
    labels = ((rows[:, 1] > 0.3) ^ (rows[:, 3] > -0.2)).astype(float)
    trees = fit(rows[:3000], labels[:3000])
    assert np.mean((trees.log_odds(rows[3000:]) > 0) == labels[3000:]) > 0.95


def test_table(spark, model):
    long = "<article><h1>t</h1>" + "<p>some words of a long story, again and again</p>" * 40_000 + "</article>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "x"), (3, "w", long, "x"), (4, "w", "no markup at all, only a sentence of words that goes on for a while.", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in X.extract(frame, model).collect()), key=str)
    texts = model.texts([r[2] for r in rows])
    assert got == sorted([(r[0], r[1], t) for r, t in zip(rows, texts)], key=str)
    assert texts[2] == texts[3] == "" and texts[4].count("\n\n") == 40_000
    assert X.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).collect() == []
