"""Main text of pages: texts put into layouts of many kinds, odd markup, the scan against all regions."""

from __future__ import annotations

import html
import random
import time

import pytest

from quiresmith.llm import html_text

SYLLABLES = "the of and to in is ti on er re st nd ou ea ha th es en".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def weights():
    return html_text.fit(*html_text.known_pages())


#: Layouts that are none of the labelled pages'; {} stands for the article's blocks.
LAYOUTS = {
    "article": "<!DOCTYPE html><html><head><title>A title</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav><!-- ad 1 --><div class='ad'>Buy one now for the price of two.</div><article>{}</article><footer>&copy; someone &middot; All rights are reserved by us.</footer>",
    "blog": "<html><body><div id='header'><h2>My site</h2><p>Just another site of mine.</p></div><div id='content' class='hentry'><div class='entry-content'>{}</div><div id='comments'><h3>2 comments</h3><ol><li><p>I do not agree with you at all.</p></li><li><p>Nor do I, to be fair.</p></li></ol><form><label>Your name</label><textarea>x</textarea><input><button>Send</button></form></div></div><div id='sidebar'><h3>Archive</h3><ul><li><a href='/1'>May</a></li><li><a href='/2'>June</a></li></ul></div><div id='footer'>Copyright by me. Powered by words.</div></body></html>",
    "news": "<HTML><BODY><HEADER class=masthead><A HREF='/'>The Paper</A></HEADER><DIV CLASS=cookie-notice>We use cookies. <BUTTON>Accept</BUTTON></DIV><MAIN>{}<ASIDE><H4>More</H4><A HREF='/x'>Another story of the day</A></ASIDE><DIV CLASS='share-buttons'><A>Tweet</A> <A>Post</A></DIV></MAIN><FOOTER>Imprint</FOOTER></BODY></HTML>",
    "body": "<html><body itemscope><div class='newsletter signup'>Get our letter every week.<form><input name=q></form></div><div itemprop='articleBody'>{}</div><div class='related-posts'><p>Read also what others have read before.</p></div></body></html>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_articles_in_layouts(weights, layout):
    rng = random.Random(7)
    for k in range(40):
        blocks = [prose(rng, rng.choice((1, 2, 5, 30, 90))) for _ in range(rng.randint(1, 9))]
        marked = [f"<p>{html.escape(b)}</p>" for b in blocks]
        title = prose(rng, rng.randint(2, 8))[:-1]
        if k % 3 == 1:
            marked[-1] = marked[-1].replace("<p>", "<p><b>").replace("</p>", "<br>")
        page = LAYOUTS[layout].format(f"<h1>{title}</h1>" + ("", "\n  ")[k % 2].join(marked))
        assert html_text.main_text(page, weights) == "\n".join([title, *blocks]), (layout, k)


def test_what_stands_inside_an_article(weights):
    page = """<article><header><h1>On
      x &lt; y</h1></header><p>Some &amp;amp; words&nbsp;of <i>in</i>line <b>mark</b>up &#233;&#x20AC;.</p>
      <aside><p>An aside that nobody reads, of some length, with a full stop.</p></aside><p>One<br>two, and the rest of this line.</p>
      <div class="advertisement"><p>Buy this thing right now, it is a really good one.</p></div><script>if (a < b) document.write("<p>no</p>")</script>
      <ul><li>First of the list.</li><li>Second of the list.</li></ul><p hidden>Not to be seen by anyone here.</p><noscript>Turn it on.</noscript>
      <p title="a > b">Last of all the paragraphs.</p><section class="comments"><article><p>I am a reader and have an opinion.</p></article></section></article>"""
    assert html_text.main_text(page, weights).split("\n") == ["On x < y", "Some &amp; words of inline markup é€.", "One two, and the rest of this line.", "First of the list.", "Second of the list.", "Last of all the paragraphs."]


def test_odd_markup(weights):
    def text(page):
        return html_text.main_text(page, weights)

    assert text("") == "" and text("<nav><a>x</a></nav>") == "" and text("<script>var a = 1;") == "" and text("<!-- never closed <p>x</p>") == ""
    assert text("Only words, no markup at all: 1 < 2 and more of them.") == "Only words, no markup at all: 1 < 2 and more of them."
    assert text("<article><p>Never <b>closed, and then it goes on <p>and on to the end of it") == "Never closed, and then it goes on\nand on to the end of it"
    assert text('<article><p title="x>A quote that is not closed.</p><p>Some more words here.</p></article>').endswith("Some more words here.")
    assert text("<article></div></p></b><p>End tags without a start are nothing to us.</p></article>") == "End tags without a start are nothing to us."
    assert text("<article><p>Some words &amp more &bogus; &am</p></article>") == "Some words & more &bogus; &am"
    assert text("<article><!-- <nav> --><p>A comment opens no element here.</p><![CDATA[ x ]]></article>") == "A comment opens no element here."


def test_time_grows_in_proportion(weights):
    for piece in ("<div class='a b'>", "<a \"", "<p>some words</p>", "</b>", "<", "<!--", "<b><i>x</b>", "&amp;", "<script>", "<li>"):
        began = time.perf_counter()
        html_text.main_text("<article>" + piece * (400_000 // len(piece)), weights)
        assert time.perf_counter() - began < 8, piece


def test_best_region_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice((-3.0, -1.0, -0.5, 0.0, 1.0, 2.0)) for _ in range(rng.randint(0, 14))]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        a, b = html_text.best_region(scores)
        most = max(sums.values(), default=0.0)
        assert ((a, b) == (0, 0) and most <= 0) or sums[a, b] == most
        assert most <= 0 or b == min(j for (i, j), x in sums.items() if x == most)


def test_labelled_pages_are_learned(weights):
    words, tags = html_text.known_pages()
    right = sum(n for (features, main), n in words.items() if (weights[html_text.BIAS] + sum(weights[f] for f in features) > 0) == main)
    assert right / sum(words.values()) > 0.98
    assert all(v < 0 for f, v in weights.items() if f.startswith("tag "))
    assert weights["<article>"] > 0 > max(weights["<nav>"], weights["<footer>"], weights["ad"], weights["comments"])


def test_extract(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(60):
        blocks = [prose(rng, rng.randint(1, 40)) for _ in range(4)]
        rows.append((k, f"http://x/{k}", LAYOUTS["article"].format("".join(f"<p>{b}</p>" for b in blocks)), "t", 1))
        want[k] = "\n".join(blocks)
    rows += [(70, "u", None, "t", 1), (71, None, "", "t", 1), (None, "v", "<article><p>No id, but some words in here.</p></article>", "t", 1), (0, "http://x/0", rows[0][2], "t", 1)]
    long = [prose(rng, 50) for _ in range(3000)]
    rows.append((72, "w", "<main>" + "".join(f"<p>{b}</p>" for b in long) + "</main>", "t", 1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    text = {r["page_id"]: r["text"] for r in found}
    assert {k: text[k] for k in want} == want and text[70] == text[71] == "" and text[None] == "No id, but some words in here." and text[72] == "\n".join(long)
    assert html_text.extract(df.where("false")).count() == 0
    assert html_text.learn(df, sample=10) == html_text.learn(df.repartition(5), sample=10)
