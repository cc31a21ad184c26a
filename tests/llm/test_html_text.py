import html as entities
import itertools
import re

import numpy as np
import pytest

from plumbline.llm import html_text, queries
from tests.llm.conftest import DATA


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_least(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 10))
    scores = rng.normal(0, 1.5, n).tolist()
    edges = {(i, j): float(rng.random()) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5}

    def cost(labels):
        return sum(-s for s, x in zip(scores, labels, strict=True) if x) + sum(
            w for (i, j), w in edges.items() if labels[i] != labels[j])

    best = min(cost(x) for x in itertools.product([False, True], repeat=n))
    assert cost(html_text.minimum_cut(scores, edges)) == pytest.approx(best)


def test_given_pages(spark):
    """All pages of the table: the text inside the article element, block by block."""
    wanted = {}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [re.sub(r"<[^>]+>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        wanted[r["page_id"]] = "\n\n".join(t for b in blocks if (t := " ".join(entities.unescape(b).split())))
    found = queries.op3_html_text(spark, DATA).collect()
    assert {r["page_id"]: r["text"] for r in found} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_page_without_article_element():
    page = """<html><body class="has-sidebar"><div id="cookie-notice"><p>We use cookies to improve your visit.</p></div>
    <header><h1>Site name</h1><nav><a href=/>Home</a></nav></header><div class="wrapper">
    <div class="main-content"><h2>Title &amp; more</h2><p>First paragraph of the text,   with a <a href=x>link</a> inside.
    <div class="ad-slot">Buy this now and save a lot of money today!</div><p>Second one&nbsp;here<br>goes on.
    <ul><li>item one<li>item two</ul><form><label>Your name</label><input><button>Send</button></form></div>
    <div class="sidebar"><p>Some other stories that you may like to read, all of them long.</p></div>
    <section id="comments"><div class="comment"><p>Nice text, I liked to read it very much, thanks.</p></div></section>
    <script>document.write("<p>no</p>")</script><style>p{}</style></div><footer>Copyright 2024</footer></body></html>"""
    assert html_text.main_blocks(page) == [
        "Title & more", "First paragraph of the text, with a link inside.", "Second one here goes on.", "item one", "item two",
    ]


def test_comments_that_are_articles_go():
    page = "<article><p>The text that counts.</p><footer>By me</footer></article><div id=comments><article class=comment><p>I say no.</p></article></div>"
    assert html_text.main_blocks(page) == ["The text that counts."]


@pytest.mark.parametrize("page", [None, "", " ", "<", "</p></div>", "<p>", "<!-- x", "<script>", "<p" * 1000, "<div>" * 3000])
def test_pages_without_text(page):
    assert html_text.main_blocks(page) == []


def test_long_page_and_clashing_names(spark):
    many = "<article>" + "".join(f"<p>Paragraph number {k} with a few words.</p>" for k in range(3000)) + "</article>"
    df = spark.createDataFrame([(1, many, "a"), (1, many, "a"), (None, None, None)], "page_id long, html string, main_text string")
    found, name = html_text.with_main_text(df)
    rows = found.collect()
    assert name == "_main_text" and sorted(len(r[name].split("\n\n")) for r in rows) == [1, 3000, 3000]
    assert html_text.with_main_text(df.limit(0))[0].count() == 0


@pytest.mark.parametrize(("page", "wanted"), [
    ("<html><head><title>x</title><h1>Title of it</h1><p>One paragraph of the text.</p>", ["Title of it", "One paragraph of the text."]),
    ("<html><head><title>x</title><meta a=b><script>s</script>Text that simply begins.<p>And goes on.", ["Text that simply begins.", "And goes on."]),
    ("<title>x</title><p>No head at all, only some text.", ["No head at all, only some text."]),
    ("<article><h2 id='related-work'>Related work</h2><p>Others have done things before.</p></article>",
     ["Related work", "Others have done things before."]),
    ("<article><p>The first part of the text.</p><section id='social-impact'><h2>Impact</h2><p>It changes how people live.</p></section></article>",
     ["The first part of the text.", "Impact", "It changes how people live."]),
    ("<article><p>The first part of the text.</p><div id='share-buttons'><p>Send this to all of your friends.</p></div></article>",
     ["The first part of the text."]),
    ("<article><p>The first part of the text.</p><div id='related-posts-2'><p>Another story that you may like.</p></div></article>",
     ["The first part of the text."]),
])
def test_left_out_tags_and_anchors(page, wanted):
    assert html_text.main_blocks(page) == wanted


def test_distance_is_that_of_the_nearest_common_element():
    reader = html_text.Blocks()
    reader.feed("<div>" * 60 + "<ul><li>a<li>b</ul>" + "<div>" * 9 + "c" + "</div>" * 69 + "d")
    reader.close()
    a, b, c, d = reader.blocks
    assert [html_text._distance(a, x) for x in (a, b, c, d)] == [0, 2, 11, 62]
    assert html_text._distance(c, d) == html_text.FAR  # 69 steps


def test_the_cut_overrules_the_classifier():
    """A doubtful line between two sure neighbours of the same parent goes with them; without edges it would not."""
    page = "<article><div><p>A long first paragraph with many words in it, of the story.</p><p>x: 1</p><p>A long last paragraph with many words in it.</p></div></article>"
    reader = html_text.Blocks()
    reader.feed(page)
    reader.close()
    scores = [3.0, -0.4, 3.0]
    edges = html_text.smoothness(reader.blocks)
    assert html_text.minimum_cut(scores, {}) == [True, False, True]
    assert html_text.minimum_cut(scores, edges) == [True, True, True]
