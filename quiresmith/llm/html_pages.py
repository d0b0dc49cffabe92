"""Labelled pages from which the extraction learns, made by rule from the names that web pages use.

A page is HTML whose main text stands in elements with the attribute
``data-main``; what stands in ``data-other`` inside them is not part of it.
"""

from __future__ import annotations

import random

#: Words in classes and ids, of what belongs to an article and of what does not.
CONTENT_WORDS = ("article", "content", "post", "entry", "story", "body", "main", "text", "blog", "news", "paragraph", "prose", "page")
OTHER_WORDS = (
    "nav", "navbar", "menu", "header", "masthead", "banner", "topbar", "footer", "bottom", "sidebar", "side", "widget", "related", "recommended", "more", "popular", "share", "sharing", "social", "follow",
    "comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "outbrain", "taboola", "cookie", "cookies", "consent",
    "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "breadcrumb", "breadcrumbs", "pagination", "pager", "tags",
    "toolbar", "skip", "copyright", "legal", "disclaimer", "rating", "survey", "poll", "teaser", "trending", "print", "feedback",
)
#: Words that say nothing: they stand around either.
GENERIC_WORDS = ("inner", "box", "wrap", "container", "row", "col", "site", "wrapper", "left", "right", "section", "block", "area")
#: Elements that hold no part of an article, with what usually stands in them.
OTHER_ELEMENTS = ("nav", "footer", "aside", "form", "header", "menu", "dialog")


def _words(n: int, seed: int, end: str = ".") -> str:
    stock = "one of these is what a page may say in its own way when there are words to be read by all".split()
    return " ".join(stock[(seed + 3 * k) % len(stock)] for k in range(n)).capitalize() + end


def _links(n: int, seed: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_words(1 + k % 2, seed + k, "")}</a></li>' for k in range(n)) + "</ul>"


def _other(word: str, k: int) -> str:
    """A block that is no part of an article, in one of several forms."""
    suffix = ("", f"-{CONTENT_WORDS[k % len(CONTENT_WORDS)]}", "-inner", "-box", f" {word}-wrap")[k % 5]
    inside = (_links(5, k), f"<p>{_words(5 + 7 * k % 41, k)}</p>", _words(7, k), f"<h3>{_words(2, k, '')}</h3><p>{_words(14, k)}</p>", f"<ol><li><p>{_words(11, k)}</p></li><li>{_words(5, k)}</li></ol>", f"<div><span>{_words(4, k, '')}</span> {_words(25, k)}</div>")[k % 6]
    name = ("div", "section", "div", "ul", "div")[(k // 3) % 5]
    return f'<{name} {("class", "id")[k % 2]}="{word}{suffix}">{inside}</{name}>'


def _element(name: str, k: int) -> str:
    inside = (_links(6, k), f"<p>{_words(5 + 11 * k % 37, k)}</p>", f"&copy; {_words(6, k)} <ul><li>{_words(7, k)}</li></ul>", f"<h2>{_words(2, k, '')}</h2>{_words(20, k)}")[k % 4]
    return f"<{name}>{inside}</{name}>"


def _article(k: int, inner: str = "") -> str:
    """The blocks of an article, with ``inner`` somewhere among them."""
    parts = [f"<p>{_words(4 + (7 * j + 5 * k) % 60, k + j)}</p>" for j in range(2 + k % 5)]
    parts.insert(1 + k % 2, f"<p>{_words(1 + k % 4, k, ('.', '')[k % 2])}</p>")
    parts[k % len(parts)] += inner
    parts.append((f"<p>{_words(5, k)} <a href='/x'>{_words(3, k, '')}</a> {_words(9, k)}</p>", f"<section class='{GENERIC_WORDS[k % 13]}'><ul><li>{_words(6, k)}</li><li>{_words(3, k, '')}</li><li><a href='/y'>{_words(2, k, '')}</a></li></ul></section><div><span>{_words(7, k)}</span> {_words(9, k)}</div>", f"<blockquote>{_words(12, k)}</blockquote><ol><li>{_words(8, k)}</li><li><p>{_words(13, k)}</p></li></ol>", f"<h2>{_words(3, k, '')}</h2><p><b>{_words(1, k)}</b><br>{_words(2, k)}</p>")[k % 4])
    title = f"<h1>{_words(1 + k % 7, k, '')}</h1>"
    return (title, f"<header>{title}</header>", f'<div class="entry-header">{title}</div>', f'<div class="post-header">{title}<p>{_words(8, k)}</p></div>')[k % 4] + "".join(parts)


def labelled_pages() -> list[str]:
    """Pages that hold every word several times, around articles of all forms, within them and after them; always the same."""
    rng = random.Random(13)
    some = lambda: rng.randrange(1 << 30)
    pages = []
    for word in OTHER_WORDS * 6:
        inner = "".join(f"<div data-other>{x}</div>" for x in (_other(rng.choice(OTHER_WORDS), some()), _element(rng.choice(OTHER_ELEMENTS[:4]), some())) if rng.random() < 0.6)
        after = f"<div data-other>{_other(word, some())}</div>" if rng.random() < 0.5 else ""
        body, holder, also = _article(some(), inner) + after, rng.choice(CONTENT_WORDS), rng.choice(CONTENT_WORDS)
        main = rng.choice(("<article data-main>{}</article>", f'<div class="{holder}" data-main>{{}}</div>', "<main data-main>{}</main>", f'<div id="{holder}-{also}" data-main>{{}}</div>', "<div data-main>{}</div>", '<div itemprop="articleBody" data-main>{}</div>')).format(body)
        around = [_element(rng.choice(OTHER_ELEMENTS), some()), _other(word, some()), f'<div class="{rng.choice(GENERIC_WORDS)}">{main}</div>', _other(rng.choice(OTHER_WORDS), some()), _element(rng.choice(OTHER_ELEMENTS), some())]
        pages.append(f'<html><body><div class="{rng.choice(GENERIC_WORDS)}">{"".join(around)}</div></body></html>')
    # Pages of hardly any markup.
    pages += [f"<{name} data-main>{_words(4 + 6 * k, k, '.' if k % 3 else '')}</{name}>" for k in range(12) for name in ("div", "p", "x")]
    return pages
