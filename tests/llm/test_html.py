import os
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from veilspark.llm import html_main
from veilspark.llm.html_nodes import read

MODEL = html_main.trained()
ARTICLE = "<article><h1>Head &amp; more</h1><p><b>First\n  words here, with some more text.<br><p>Second &lt;b&gt; block, also a sentence.</p></article>"
EXPECTED = "Head & more\nFirst words here, with some more text.\nSecond <b> block, also a sentence."
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FURNITURE = [
    NAV, '<div class="ad">Buy this thing now. It is good.</div>', "<footer>&copy; site 2024</footer>", '<div class="cookie-notice"><p>We use cookies on this site. Accept them.</p></div>',
    "<aside><h3>Related</h3><ul><li><a href='/x'>One more story</a></li></ul></aside>", '<section class="comments"><h2>Comments</h2><div class="comment"><p>Nice text, thank you.</p></div></section>',
    '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>', "<script>if (a < b) { x = '</p>'; }</script>", "<style>p{margin:0}</style>", "<!-- <p>hidden</p> -->",
]


def text(source):
    return html_main.main_texts([source], MODEL)[0]


@pytest.mark.parametrize("extra", FURNITURE)
def test_article_without_furniture(extra):
    assert text(f"<html><body>{NAV}{ARTICLE}{extra}<footer>end</footer></body></html>") == EXPECTED
    assert text(f"<html><body>{extra}{ARTICLE}<footer>end</footer></body></html>") == EXPECTED


def test_generated_pages():
    layouts = html_main._Layouts(123)
    good = total = 0
    for _ in range(150):
        source, labels = layouts.page()
        page = read(source)
        kept = html_main.decode(page, MODEL.probability(html_main.node_features([page])))
        good += sum(a == b for a, b in zip(kept, labels, strict=True))
        total += len(labels)
    assert good / total > 0.98


S = "The council met on Monday to discuss the new bridge. Members spoke for two hours, and the public asked questions about the cost."
T = "A decision is expected in spring, the mayor said. Until then the old road stays open for cars, but lorries must take the northern route."
#: Pages written by hand and their stories. The generator's layouts were widened with these in view: no estimate for sites unseen.
HELD_OUT = [
    (f"<body><div>{S}</div><div>{T}</div></body>", f"{S}\n{T}"),
    (f'<body><nav><a href="/">Home</a><a href="/n">News</a></nav><div>{S}</div><div>{T}</div></body>', f"{S}\n{T}"),
    (f'<body><article class="post share"><p>{S}<p>{T}</article></body>', f"{S}\n{T}"),
    (f'<article><h1>A bridge</h1><p>{S}</p><p hidden>old text, not shown any more</p><p>{T} <span style="display: none">gone</span></p></article>', f"A bridge\n{S}\n{T}"),
    (
        f'<html><body class="home"><div id="top-bar"><a href="/login">Log in</a> | <a href="/join">Join</a></div><div class="grid"><div class="grid-main"><h1>New bridge planned</h1><div class="dateline"><p>{S}</p></div>'
        f'<p>{T}</p><blockquote>We need it, said one of them.</blockquote><p>{S}</p></div><div class="grid-rail sidebar"><h4>Most read</h4><ul><li><a href="/1">Rain all week</a></li><li><a href="/2">Team wins again</a></li></ul></div></div>'
        '<div class="site-footer"><p>Copyright 2024 The Paper. <a href="/terms">Terms</a> <a href="/privacy">Privacy</a></p></div></body></html>',
        f"New bridge planned\n{S}\n{T}\nWe need it, said one of them.\n{S}",
    ),
    (
        f'<body><table width="100%"><tr><td class="menu" width="120"><a href="a.html">Start</a><br><a href="b.html">Archive</a><br><a href="c.html">Links</a></td><td><h2>Diary</h2><p>{S}</p><p>{T}</p><p>{S}</p></td></tr></table></body>',
        f"Diary\n{S}\n{T}\n{S}",
    ),
    (
        f'<main role="main"><section class="hero"><h1>Bridge vote delayed</h1></section><section class="c-content__body"><p>{S}</p><aside class="ad-slot">Buy one, get one free.</aside><p>{T}</p><ul><li>First, the cost of the piers.</li><li>Second, the height over the water.</li></ul></section></main>'
        '<section id="comments"><h3>2 comments</h3><div class="comment"><p>I think it is far too late for that.</p></div><div class="comment"><p>Agreed, they should have begun last year.</p></div></section><footer><p>Contact us</p></footer>',
        f"Bridge vote delayed\n{S}\n{T}\nFirst, the cost of the piers.\nSecond, the height over the water.",
    ),
    (
        f'<div class="cookie-banner">This site uses cookies. <button>Accept</button></div><header><h1>The Paper</h1><form><input name="q"><button>Search</button></form></header><div class="story"><h2>Vote on the bridge</h2><div>{S}</div><div>{T}</div><div>{S}</div></div>'
        '<div class="newsletter"><p>Get our letter every morning.</p><form><label>Mail</label><input><button>Sign up</button></form></div>',
        f"Vote on the bridge\n{S}\n{T}\n{S}",
    ),
    (
        f'<body><div class="banner"><a href="/"><img src="l.png"></a></div><ul id="mainnav"><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Arts</a></li></ul><div id="content"><h1>Bridge</h1><p>{S}</p><figure><img src="x.jpg"><figcaption>The old bridge in May.</figcaption></figure><p>{T}</p></div><div id="footer"><p>All rights reserved. The Paper Ltd.</p></div></body>',
        f"Bridge\n{S}\nThe old bridge in May.\n{T}",
    ),
    (f'<body><div id="app"><div class="x1"><div class="x2"><h1>Bridge</h1><span>{S}</span><div><span>{T}</span></div><div>{S}</div></div></div><div class="x9"><a href="/1">One</a><a href="/2">Two</a><a href="/3">Three</a></div></div></body>', f"Bridge\n{S}\n{T}\n{S}"),
    (f"<body><p>{S}</p><p>{T}</p><p>{S}</p></body>", f"{S}\n{T}\n{S}"),
    (f'<body><center><h2>My page</h2></center>{S}<br><br>{T}<hr><a href="index.html">Back</a> | <a href="top.html">Top</a></body>', f"My page\n{S} {T}"),
    (
        f'<article><header><h1>Bridge</h1></header><div class="entry-content"><p>{S}</p><pre>cost = piers * height</pre><p>{T}</p><h3>What next</h3><p>{S}</p></div><footer class="entry-footer"><a href="/tag/x">x</a> <a href="/tag/y">y</a></footer></article><div class="related-posts"><h3>Related</h3><div><a href="/z">Another bridge falls</a></div></div><div id="disqus_thread"><p>Nice text! I liked it.</p></div>',
        f"Bridge\n{S}\ncost = piers * height\n{T}\nWhat next\n{S}",
    ),
]


def f1(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def test_pages_written_by_hand():
    scores = [f1(text(source), story) for source, story in HELD_OUT]
    assert min(scores) >= 0.95 and scores[:4] == [1] * 4, scores


MEG = 1 << 20
HOSTILE = {
    "open tags": "<a" * (MEG // 2), "open quotes": '<a "x ' * (MEG // 6), "open values": '<a x="' * (MEG // 6), "signs in values": '<a x=">" ' * (MEG // 9), "declarations": "<p><!" * (MEG // 5),
    "nested quotes": "<a x='<b y=\"" * (MEG // 12), "open divs": "<div>" * 100_000, "divs in a table": "<p><table>" + "<div>" * 100_000, "items": "<li><ul>" + "<div>" * 50_000 + "<li>x" * 50_000,
    "signs": "<" * MEG, "scripts": "<script>" + "</script " * (MEG // 9), "attributes": "<p class=' class=\"" * (MEG // 18), "bold": "<b><p>" * 50_000 + "</b>" * 50_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_reading_is_linear(kind):
    began = time.process_time()
    read(HOSTILE[kind])
    assert time.process_time() - began < 2


def test_numbers_of_any_length():
    assert text(f"<article><p>One, two. &#{'1' * 9000}; three &#{'0' * 6000}65; four.</p></article>") == "One, two. \ufffd three A four."


class _Article(HTMLParser):
    """The text of the article element, block by block: what the tables' pages hold as their story."""

    BLOCKS = frozenset("h1 h2 h3 p li ul ol blockquote pre div section table tr td".split())

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = False, [""]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in self.BLOCKS:
            self.out.append("")
        elif tag == "br":
            self.out[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in self.BLOCKS:
            self.out.append("")

    def handle_data(self, data):
        if self.inside:
            self.out[-1] += data

    def story(self):
        return "\n".join(x for x in (re.sub(r"\s+", " ", x).strip() for x in self.out) if x)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_pages_are_their_articles(spark):
    rows = html_main.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    sources = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert all(r.text == _Article(sources[r.page_id] or "").story() and r.n_chars == len(r.text) for r in rows) and len(rows) == len(sources)


def test_no_kept_node_below_a_dropped_one():
    layouts = html_main._Layouts(7)
    for _ in range(30):
        page = read(layouts.page()[0])
        kept = html_main.decode(page, MODEL.probability(html_main.node_features([page])))
        assert all(not k or page.parents[i] < 0 or kept[page.parents[i]] for i, k in enumerate(kept))


@pytest.mark.parametrize("source", [None, "", "plain words", "<p>", "</p></div>", "<div" * 50, "<div>" * 5000 + "x", "<b><i></b></i>", "<table><tr><td>a<td>b", "&#x110000; &bogus; &#0;", "<script>never closed", "<!-- never closed", "<p>a<li>b<p>c", "\x00<a href='x>y"])
def test_odd_pages(source):
    assert isinstance(text(source), str)


def test_table(spark):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, None, "x"), (2, "v", "", "x")]
    from veilspark.llm.html_main import extract_pages

    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in got] == [EXPECTED, EXPECTED, "", ""] and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
