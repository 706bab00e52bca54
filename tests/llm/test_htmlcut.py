import html as h
import itertools
import os
import random
import re

import pytest

from graphloom.llm import htmlcut

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div id="cookie-notice">We use cookies. Accept.</div><div class="layout"><div class="sidebar"><h3>Links</h3><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>
<div class="content"><h1>Big &amp; title</h1><p>First   paragraph of the
story, long enough to be content, really it is.<p>Short one.<script>var p = "</p><p>no</p>";</script><p>Another long paragraph that is <b>certainly</b> part of the article itself.
<form><input><label>Mail</label><button>Go</button></form></div><section id="comments"><h3>Comments</h3><p>Great article! I liked it very much, thanks for sharing all this.</p></section></div><footer>&copy; x</footer></body></html>"""


def test_parts_of_a_page():
    assert htmlcut.main_text(PAGE).split("\n\n") == ["Big & title", "First paragraph of the story, long enough to be content, really it is.", "Short one.", "Another long paragraph that is certainly part of the article itself."]


STORY = ["Title of it", "First paragraph of the story, long enough to be content, really it is so.", "Yes.", "Another long paragraph that is certainly part of the article itself, too."]
ARTICLE = f"<h1>{STORY[0]}</h1><p>{STORY[1]}</p><p>{STORY[2]}</p><p>{STORY[3]}</p>"
AROUND = '<div class="sidebar"><h3>Links</h3><p>Some words of a sidebar stand here.</p></div><section id="comments"><h3>Comments</h3><article><p>Great article! I liked it very much, thanks for sharing.</p></article></section>'
WRAPPERS = ['<div class="page has-sidebar">', '<div class="layout sidebar-right">', '<div class="post comments-open">', '<main class="no-sidebar">', '<div class="with-ads">', '<div class="popup-enabled">', '<form id="aspnetForm">']


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article>%s</article>", "<div class=content>%s</div>", "%s"])
def test_wrappers_decide_nothing(wrapper, inner):
    tag = re.match(r"<(\w+)", wrapper)[1]
    page = f"<html><head><title>x</title><body><nav><a href=1>Home</a></nav>{wrapper}{inner % ARTICLE}{AROUND}</{tag}><footer>&copy; me</footer></body></html>"
    assert htmlcut.main_text(page).split("\n\n") == STORY


#: Pages and their main text, by hand.
PAGES = [
    # no landmark at all, tables for the layout, a menu of links, a notice below
    ("<html><body><table><tr><td><a href=1>Home</a> <a href=2>News</a> <a href=3>About us</a></td></tr><tr><td><h2>On bees</h2><p>Bees are flying insects closely related to wasps and ants.</p><p>Why?</p><p>They are known for their role in pollination, and for producing honey.</p></td></tr><tr><td>&copy; 2001 Bee Club. All rights reserved.</td></tr></table></body></html>", ["On bees", "Bees are flying insects closely related to wasps and ants.", "Why?", "They are known for their role in pollination, and for producing honey."]),
    # a formula, an object and text without scripts inside the article
    ("<body><main><h1>Circles</h1><p>The area is <math><mi>A</mi><mo>=</mo><mi>π</mi><msup><mi>r</mi><mn>2</mn></msup></math> for every circle of that radius.</p><object data=x><p>A picture of a circle with its radius drawn in red.</p></object></main></body>", ["Circles", "The area is A=πr2 for every circle of that radius.", "A picture of a circle with its radius drawn in red."]),
    # a head that is never closed, no body
    ("<html><head><title>t</title><meta charset=utf-8><h1>Rain</h1><p>It rained for three days, and the river rose to the bridge.</p><p>Nobody was hurt.</p>", ["Rain", "It rained for three days, and the river rose to the bridge.", "Nobody was hurt."]),
    # a forum: the post stays, replies go
    ("<body><div id=header><a href=/>Forum</a></div><div class='post'><h1>How do I sort?</h1><p>I have a list of names and want to sort it by the last letter of each.</p><pre>sorted(names)</pre></div><div class='replies'><p>Use a key function, as the manual says on its second page.</p><p>That worked well for me, thank you very much.</p></div></body>", ["How do I sort?", "I have a list of names and want to sort it by the last letter of each.", "sorted(names)"]),
    # lists and quotes inside an article, advert in the middle, header of the article
    ("<body><header><a href=/>Daily</a></header><article><header><h1>Soup</h1><p>By A. Cook, who cooks.</p></header><ul><li>2 onions</li><li>1 litre of water</li></ul><div class='ad'>Buy our new pan today, it is the very best pan.</div><blockquote>Soup is best on the second day, my mother always said.</blockquote></article><aside><p>More recipes of this week can be found in our book.</p></aside></body>", ["Soup", "By A. Cook, who cooks.", "2 onions", "1 litre of water", "Soup is best on the second day, my mother always said."]),
    # consent and hidden boxes first, newsletter form last
    ("<body><div class='cookie-consent'><p>We value your privacy and use cookies to make this site better.</p></div><div style='display:none'><p>This text is not to be seen by any reader of the page.</p></div><div id='main'><h1>Trains</h1><p>The first train left the station at five in the morning.</p><p>It was late.</p></div><form><p>Sign up for our newsletter and never miss a story again.</p><input></form></body>", ["Trains", "The first train left the station at five in the morning.", "It was late."]),
]


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_pages_by_hand(number):
    page, want = PAGES[number]
    assert htmlcut.main_text(page).split("\n\n") == want


def test_the_cut_changes_labels():
    pages = [p for p, _ in PAGES] + [f"<body><div>{ARTICLE}</div>{AROUND}</body>"]
    found = [(b.text, cost > 0, keep) for p in pages for b, cost, keep in htmlcut.labelled(p)]
    turned = [text for text, own, keep in found if own != keep]
    assert {"On bees", "Rain", "Title of it"} <= set(turned), turned
    # and it is a flow that finds some of them
    seen = []
    flow, htmlcut.max_flow = htmlcut.max_flow, lambda *a: seen.append(a) or flow(*a)
    try:
        for p in pages:
            htmlcut.labelled(p)
    finally:
        htmlcut.max_flow = flow
    assert seen


def test_fit_stays_near_the_given_weights(spark):
    rows, labels = htmlcut.features(f"<body><nav><a href=1>Home page</a></nav><article>{ARTICLE}</article><p>Outside of it.</p></body>")[2:]
    w = htmlcut.fitted(rows, labels)
    assert (abs(w - htmlcut.GIVEN) <= htmlcut.NEAR + 1e-9).all() and (w != htmlcut.GIVEN).any() and (w == htmlcut.GIVEN)[~htmlcut.FITTED].all()
    df = spark.createDataFrame([("<body><p>No landmark here at all.</p>",)], "html string")
    assert (htmlcut.fit(df) == htmlcut.GIVEN).all()


def test_cut_is_the_minimum():
    rnd = random.Random(0)
    for _ in range(200):
        n = rnd.randint(1, 8)
        costs = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): rnd.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5}

        def cost(labels, costs=costs, edges=edges):
            return sum(abs(c) for c, k in zip(costs, labels, strict=True) if (c > 0) != bool(k)) + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])

        assert cost(htmlcut.cut(costs, edges)) - min(map(cost, itertools.product([0, 1], repeat=n))) < 0.02


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_test_pages(spark):
    for r in htmlcut.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(h.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(w for w in want if w) and r.n_chars == len(r.text)


def test_edges(spark):
    long = "<article>" + "<p>" + "words and words, " * 30_000 + "</article>"
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<<<>>> </p", "x"), (4, "u", long, "x"), (4, "u", long, "x")], "page_id long, url string, html string, text string")
    got = sorted(htmlcut.extract(df).collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in got] == [1, 2, 3, 4, 4] and got[0].text == "" and got[1].n_chars == 0
    assert got[3].text == ("words and words, " * 30_000).strip()
    assert htmlcut.extract(df.limit(0)).count() == 0
    named = htmlcut.extract(df.selectExpr("page_id", "html", "1 AS page", "2 AS n_chars", "3 AS row"))
    assert named.columns == ["page_id", "page", "row", "text", "n_chars"] and named.count() == 5
