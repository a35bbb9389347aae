"""Page extraction: labels by brute force on pages without an article, text that must stay, odd and deep pages."""

import itertools
import random
import time

import pytest

from evidenceframe.llm import html_extract as h


def page_of(rnd):
    """A page of a few blocks without article or main."""
    prose = lambda n: " ".join(rnd.choice(["grain", "river", "of", "the", "walks", "tall"]) for _ in range(n)) + rnd.choice([".", "", ", so it is"])
    parts = []
    for _ in range(rnd.randrange(2, 7)):
        kind = rnd.randrange(7)
        link = f"<a href=x>{prose(rnd.randrange(1, 4))}</a>"
        parts.append([
            f"<p>{prose(rnd.randrange(2, 60))}</p>", f"<p>{prose(2)} {link}</p>", f"<ul><li>{link}</li><li>{rnd.choice([link, prose(2)])}</li></ul>", f"<div class='{rnd.choice(['ad', 'related-work', 'social', 'x', 'text-ad', 'post'])}'>{prose(rnd.randrange(2, 40))}</div>",
            f"<div><h2>{prose(3)}</h2><p>{prose(20)}</p></div>", f"<nav>{link}</nav>", f"© {prose(2)}<hr>",
        ][kind])
    return "<html><body>" + "".join(parts) + "</body></html>"


def ways(e):
    out = []
    while e.number:
        out.append(e.number)
        e = e.up
    return out[::-1]


def labelled(blocks, with_edges):
    """The best labelling of all, each priced from the classifier's scores and the tree."""
    odds = [h.log_odds(b, any(x.within.good for x in blocks)) for b in blocks]
    edges = []
    for i, j in itertools.combinations(range(len(blocks)), 2):
        x, y = ways(blocks[i].within)[:-1], ways(blocks[j].within)[:-1]
        if j == i + 1:
            same = len([1 for p, q in zip(x, y, strict=False) if p == q])
            edges.append((i, j, h.CLOSE * (1 + same) / (1 + max(len(x), len(y)))))
        elif x[-1:] == y[-1:] and not any(ways(b.within)[:-1][-1:] == x[-1:] for b in blocks[i + 1 : j]):
            edges.append((i, j, h.SIBLING))
    price = lambda keep: sum(max(0.0, -x if k else x) for x, k in zip(odds, keep, strict=True)) + with_edges * sum(w for i, j, w in edges if keep[i] != keep[j])
    best = min(itertools.product([True, False], repeat=len(blocks)), key=price)
    return "\n\n".join(b.text for b, k in zip(blocks, best, strict=True) if k)


def test_labels_equal_brute_force_and_edges_decide():
    rnd, changed, seen = random.Random(7), 0, 0
    while seen < 250:
        page = page_of(rnd)
        blocks = h.blocks_of(page)
        if not 1 < len(blocks) < 11:
            continue
        seen += 1
        want = labelled(blocks, 1)
        assert h.main_text(page) == want
        changed += want != labelled(blocks, 0)
    assert changed >= 25


@pytest.mark.parametrize(("page", "want"), [
    ("Plain words only.", "Plain words only."),
    ("<div class='x'>Short body text.</div>", "Short body text."),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.", "Let x=2 be."),
    ("<article><p>Press <button>Start</button> now.</p></article>", "Press Start now."),
    ("<article><p>One is here.</p><section id='related-work'><p>Others did that.</p></section><p>Two.</p></article>", "One is here.\n\nOthers did that.\n\nTwo."),
    ("<article><p class='share-price'>It fell to 3.</p><p>A <span class='social'>social</span> life.</p></article>", "It fell to 3.\n\nA social life."),
    ("<article><header><h1>Name</h1></header><p>One.</p><aside>More of us</aside><div class='ad'>Buy shoes.</div><section class='comments'><p>Nice, thanks a lot!</p><p>So say I.</p></section><p>Two.</p></article>", "Name\n\nOne.\n\nTwo."),
    ("<div class='cookie-notice'>We use cookies.</div><form>Name <input></form><p>Here is the text of the page, all of it.</p><footer>Imprint</footer>", "Here is the text of the page, all of it."),
    ("<nav><a href=a>Home</a></nav><header>Site</header><main><p>Words.</p></main><div id=sidebar>Other news</div>", "Words."),
    ("<p>a &lt;b&gt; &eacute;<script>if (a < b) x()</script> c<style>p{}</style></p>", "a <b> é c"),
    ("", ""), (" \n ", ""), ("<p", ""), ("<!-- only", ""), ("a < b", "a < b"), ("</div></p>x", "x"),
])
def test_pages(page, want):
    assert h.main_text(page) == want


ONE = "The first paragraph of the article is long enough to be prose, with commas, and it ends here."
TWO = "The second paragraph of the article says more of the same thing, at some length, and ends too."
BODY = f"<h1>Name of it</h1><p>{ONE}</p><p>{TWO}</p>"
WANT = f"Name of it\n\n{ONE}\n\n{TWO}"


@pytest.mark.parametrize("page", [
    *[f"<div class='{name}'><article>{BODY}</article></div>" for name in ("has-sidebar", "sidebar-right", "with-cookie-notice", "newsletter", "comments", "ad-container")],
    f"<div class='content-sidebar-wrap'><main><article>{BODY}</article></main><div class='sidebar'><p>Other news of today, which is short.</p></div></div>",
    f"<div class='newsletter-article'>{BODY}</div>", f"<form id='aspnetForm'><article>{BODY}</article></form>", f"<form id='aspnetForm'><nav><a href=x>Home</a></nav><div>{BODY}</div><input name=q></form>",
    f"<div role='form'><div>{BODY}</div></div>", f"<div id='page' class='has-cookie-notice has-sidebar'><div class='post'>{BODY}</div><div class='cookie-notice'>We use cookies.</div></div>",
    f"<article>{BODY}<section class='responses'><p>Nice article, thanks a lot for it, it made my day and more.</p></section></article>",
    f"<main>{BODY}<div class='more'><article><h2>Teaser</h2><p>Another story of ours, read it soon, it is good.</p></article></div></main>",
    f"<article>{BODY}</article><div>Copyright 2020 The Company, Inc. All rights reserved.</div>", f"<div>{BODY}</div><p>All rights reserved by the publisher.</p>",
    f"<div>{BODY}</div><div class='comments'>" + "<p>A reader wrote this comment, and it is quite long, as they have much to say of it.</p>" * 9 + "</div>",
    f"<article>{BODY}</article><div class='sidebar-news'>" + "<article><p>A teaser of another article, which is rather long, and ends with a stop.</p></article>" * 9 + "</div>",
])
def test_wrappers_lose_no_article_and_boilerplate_goes(page):
    assert h.main_text(f"<html><body>{page}</body></html>") == WANT


@pytest.mark.parametrize("bit", ["<svg>", "<iframe src=x>", "<annotation>", "<video>x", "<object ", "<!-- ", "<select><option>a"])
def test_unclosed_elements_are_linear(bit):
    began = time.time()
    h.main_text("<p>Here it begins. " + bit * (1_000_000 // len(bit)))
    assert time.time() - began < 8


def test_long_and_deep_pages():
    began = time.time()
    deep = "<div>word " * 6_000
    assert h.main_text(deep).count("word") == 6_000
    assert h.main_text("<p>" + "many words. " * 200_000).count("many") == 200_000
    assert h.main_text("<p>x</div></b>" * 20_000).count("x") == 20_000
    assert time.time() - began < 30


def test_rows(spark):
    rows = [(1, "u", b"<p>caf\xe9 ol\xc3\xa9 is open.</p>"), (2, None, None), (None, "v", b"<p>Words.</p>"), (None, "v", b"<p>Words.</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, raw binary").selectExpr("page_id", "url", "cast(raw as string) as html", "1 as text", "2 as n_chars")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in h.extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "u", "caf� olé is open.", 17), (2, None, "", 0), (None, "v", "Words.", 6), (None, "v", "Words.", 6)], key=str)
    assert h.extract_pages(pages.limit(0)).count() == 0
