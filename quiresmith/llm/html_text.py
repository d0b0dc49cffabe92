"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. A word's score is the log odds, by the
elements that it stands in, their classes and the run of words around it, that
it is part of an article; a tag's score is negative, the more so the rarer it
is within articles. Both are learned from labelled pages: those of
``html_pages`` and those of the corpus whose markup names its article. One
linear scan finds the contiguous region with the highest sum, and within it
what stands in menus, adverts or comments is left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import in_small_batches, rows_of
from quiresmith.llm.html_pages import CONTENT_WORDS, OTHER_WORDS, labelled_pages

#: Elements without an end, elements whose text is no markup, and elements that show no text of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title textarea xmp iframe noembed noframes noscript template object svg canvas math select option button head audio video map datalist".split())
#: Elements that are blocks, those among them that end an open paragraph, and what an element ends, up to what.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li tbody tfoot thead tr".split())
IMPLIED = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"]))}
#: Elements and classes by which a page names its article.
NAMED = re.compile(r"<(?:article|main)[\s>]|articleBody", re.IGNORECASE)
#: Pages of the corpus that are learned from, about, and contexts of them at most.
SAMPLE_PAGES, CONTEXTS = 4096, 2000
#: Log odds above which a run within the region stays; the least and most that a word scores and that a tag costs.
KEEP, WORD_LEAST, WORD_MOST, TAG_COST = -1.0, -1.0, 3.0, (0.02, 0.5)

#: The name of the weight that every word has; no class has a blank.
BIAS = "any word"

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s>/]*)")
_QUOTES = re.compile(r"[^\"'>]*+(?:\"[^\"]*+\"[^\"'>]*+|'[^']*+'[^\"'>]*+)*+")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden|data-main|data-other)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![\w-])", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?。！？]\W*$")


@lru_cache(maxsize=65_536)
def _opened(tag: str) -> tuple[str, tuple[str, ...], frozenset[str]]:
    """Name, features and marks (hidden, data-main, data-other) of a start tag."""
    name = _TAG.match(tag)[2].lower()
    words, marks = {f"<{name}>"}, set()
    for m in _ATTRIBUTE.finditer(tag, len(name) + 1):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key.startswith("data-"):
            marks.add(key)
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            marks.add("hidden")
        elif key != "style" and key != "aria-hidden":
            words.update(w for w in re.split(r"[^a-z]+", _CAMEL.sub("-", value).lower()) if w)
    # What words of a kind have in common is learned from all of them.
    kinds = {kind for kind, known in (("of no article", OTHER_WORDS), ("of an article", CONTENT_WORDS)) if not words.isdisjoint(known)}
    return name, tuple(sorted(words | kinds)), frozenset(marks)


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """Markup of a page in order: ("<", start tag), (">", name of an end tag), ("", text). Comments and raw elements' texts are left out."""
    at, n, strict, look = 0, len(page), True, 0
    while at < n:
        lt = page.find("<", max(at, look))
        if lt < 0:
            yield "", page[at:]
            return
        m = _TAG.match(page, lt)
        if not m and not page.startswith(("<!", "<?", "</"), lt):
            look = lt + 1  # a sign like any other
            continue
        if lt > at:
            yield "", page[at:lt]
        if m:
            end = _QUOTES.match(page, m.end()).end() if strict else page.find(">", m.end())
            if strict and (end >= n or page[end] != ">"):
                strict = False  # a quote is not closed: from here on tags end at the next sign
                end = page.find(">", m.end())
            if end < 0:
                yield "", page[lt:]
                return
            name = m[2].lower()
            yield (">", name) if m[1] else ("<", page[lt : end + 1])
            at = end + 1
            if not m[1] and name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = close.start() if close else n
        elif page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        else:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1


class Page:
    """The elements that are open while a page is read, with the features of all of them."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.stack = weights, []
        self.features: Counter[str] = Counter()
        self.score, self.unseen, self.marking = 0.0, 0, 0
        self.marked: Counter[str] = Counter()

    def _push(self, tag: str) -> None:
        name, words, marks = _opened(tag)
        # A header, footer or form of an article is not that of a page.
        own = (*words, f"in <{name}>") if self.features["<article>"] or self.features["<main>"] else words
        before = self.score
        for w in own:
            self.features[w] += 1
            if self.features[w] == 1:
                self.score += self.weights.get(w, 0.0)
        unseen, marking = name in UNSEEN or "hidden" in marks, name in ("article", "main") or self.score - before >= 1.0
        self.unseen, self.marking = self.unseen + unseen, self.marking + marking
        self.marked.update(marks)
        self.stack.append((name, own, unseen, marking, marks, before))

    def _pop(self) -> None:
        _, own, unseen, marking, marks, self.score = self.stack.pop()
        for w in own:
            self.features[w] -= 1
            if not self.features[w]:
                del self.features[w]
        self.unseen, self.marking = self.unseen - unseen, self.marking - marking
        self.marked.subtract(marks)

    def _close(self, names: frozenset[str], within: frozenset[str]) -> None:
        """Ends the nearest open element of ``names``, if none of ``within`` is nearer."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in names:
                while len(self.stack) > k:
                    self._pop()
                return
            if name in within:
                return

    def start(self, tag: str) -> str:
        name = _opened(tag)[0]
        if name in ENDS_P and self.features["<p>"]:
            self._close(frozenset(["p"]), frozenset(["table", "td", "th", "button", "object", "caption"]))
        if name in IMPLIED:
            self._close(*IMPLIED[name])
        if name not in VOID:
            self._push(tag)
        return name

    def end(self, name: str) -> None:
        if self.features[f"<{name}>"]:
            self._close(frozenset([name]), frozenset())


def run_features(text: str, n: int) -> tuple[str, ...]:
    """What the run itself tells: its length, and whether it ends like a sentence."""
    return (f"words {min(3, n // 5)}", *(("sentence",) if _SENTENCE.search(text) else ()))


def count_words(text: str) -> int:
    """Words of a run, and of scripts without blanks about as many."""
    return max(len(text.split()), len(text) // 24 if not text.isspace() else 0)


def contexts(page: str) -> tuple[Counter, Counter]:
    """Words by (features, is main text), and tags by (name, is main text), of a labelled page: one with ``data-main`` or, where there is none, ``article``, ``main`` or articleBody."""
    words, tags = Counter(), Counter()
    by_mark = "data-main" in page
    doc = Page({})

    def main() -> bool:
        if by_mark:
            return doc.marked["data-main"] > 0 and not doc.marked["data-other"]
        return any(doc.features[x] for x in ("<article>", "<main>", "article-body")) or (doc.features["article"] > 0 and doc.features["body"] > 0)

    for kind, value in tokens(page):
        if kind == "<":
            tags[doc.start(value), main()] += 1
        elif kind == ">":
            tags[value, main()] += 1
            doc.end(value)
        elif not doc.unseen and (n := count_words(value)):
            words[tuple(sorted({*doc.features, *run_features(value, n)})), main()] += n
    return words, tags


def fit(words: Counter, tags: Counter, rounds: int = 4000, ridge: float = 1e-6) -> dict[str, float]:
    """Weights of features (log odds of main text, by ridge logistic regression over contexts) and of tags ("tag <name>", below zero)."""
    sets = sorted({features for features, _ in words})
    names = sorted({f for s in sets for f in s})
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(sets), len(names) + 1))
    x[:, -1] = 1.0
    for k, s in enumerate(sets):
        x[k, [place[f] for f in s]] = 1.0
    main, other = (np.array([words[s, side] for s in sets], float) for side in (True, False))
    size = np.sqrt(main + other)  # long articles do not outweigh all else
    share, size = main / (main + other), size / size.sum()
    beta, ahead, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    step = 1.0 / (0.25 * float((size * (x**2).sum(1)).sum()) + ridge)
    for _ in range(rounds):  # accelerated gradient descent
        slope = x.T @ (size * (1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40))) - share)) + ridge * ahead
        new, t_new = ahead - step * slope, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, beta, t = new + (t - 1) / t_new * (new - beta), new, t_new
    weights = dict(zip([*names, BIAS], beta.tolist()))
    for name in {name for name, _ in tags}:
        odds = np.log((tags[name, False] + 1) / (tags[name, True] + 1))
        weights[f"tag {name}"] = -float(np.clip(odds, *TAG_COST))
    return weights


@lru_cache(maxsize=1)
def known_pages() -> tuple[Counter, Counter]:
    """Contexts of the labelled pages that are at hand."""
    words, tags = Counter(), Counter()
    for page in labelled_pages():
        w, t = contexts(page)
        words.update(w)
        tags.update(t)
    return words, tags


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and past-last place of the contiguous region with the highest sum, in one pass; (0, 0) if no sum is above zero, of equals the one that ends first."""
    best, total, since, region = 0.0, 0.0, 0, (0, 0)
    for k, score in enumerate(scores):
        if total <= 0:
            total, since = 0.0, k
        total += score
        if total > best:
            best, region = total, (since, k + 1)
    return region


def main_text(page: str, weights: dict[str, float]) -> str:
    """Main text of a page: blocks in page order, joined by a line feed."""
    doc, bias = Page(weights), weights.get(BIAS, 0.0)
    scores: list[float] = []
    runs: list[tuple[int, int, str]] = []  # place among the scores, block, text
    block = 0
    for kind, value in tokens(page):
        unseen = doc.unseen
        if not kind:
            if unseen:
                continue
            n = count_words(value)
            odds = bias + doc.score + sum(weights.get(f, 0.0) for f in run_features(value, n))
            if not n or odds > KEEP:
                runs.append((len(scores), block, value))
            # What is left out wherever the region lies, inside an element that marks an article, cuts nothing off.
            scores.append(0.0 if not n or (odds <= KEEP and doc.marking) else n * min(WORD_MOST, max(WORD_LEAST, odds)))
            continue
        name = doc.start(value) if kind == "<" else value
        if kind == ">":
            doc.end(name)
        if name in BLOCK:
            block += 1
        elif name in ("br", "td", "th") and not doc.unseen:
            runs.append((len(scores), block, " "))
        if not (unseen or doc.unseen or (doc.marking and bias + doc.score <= KEEP)):
            scores.append(weights.get(f"tag {name}", -TAG_COST[0]))
        else:
            scores.append(0.0)
    first, last = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for place, number, text in runs:
        if first <= place < last:
            blocks.setdefault(number, []).append(html.unescape(text) if "&" in text else text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from the labelled pages at hand and about ``sample`` of pages(page_id, url, html) whose markup names the article.

    The sample goes by a hash of id and address; of its contexts the
    ``CONTEXTS`` with the most words count, in all as much as the pages at hand.
    """
    n = pages.count()
    some = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(max(1, n // sample))) == 0).where(F.col("html").rlike("(?i)<(?:article|main)[\\s>]|articleBody"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tags = Counter(), Counter()
        for batch in rows_of(batches):
            for page in batch.column(0):
                w, t = contexts(page.as_py().replace("data-main", ""))
                words.update(w)
                tags.update(t)
        rows = [("words", list(of), main, n) for (of, main), n in words.items()] + [("tag", [name], main, n) for (name, main), n in tags.items()]
        kinds = {"kind": pa.string(), "features": pa.list_(pa.string()), "main": pa.bool_(), "n": pa.int64()}
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    seen = in_small_batches(some.select("html")).mapInArrow(run, "kind string, features array<string>, main boolean, n long").groupBy("kind", "features", "main").agg(F.sum("n").alias("n"))
    rows = seen.orderBy(F.col("n").desc(), "kind", "features", "main").limit(CONTEXTS).collect()
    words, tags = (Counter(x) for x in known_pages())
    for kind, mine in (("words", words), ("tag", tags)):
        found = {(tuple(r["features"]) if kind == "words" else r["features"][0], r["main"]): r["n"] for r in rows if r["kind"] == kind}
        scale = sum(mine.values()) / max(1, sum(found.values()))
        for key, count in found.items():
            mine[key] += max(1, round(count * scale))
    return fit(words, tags)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for pages(page_id, url, html): the main text of each page and its code points.

    The whole page is read, whatever its length; time and memory grow in
    proportion. Null and empty pages, and those without main text, have an
    empty text; a text without markup is all main text. Character references
    are decoded, white space inside a block is one space, blocks are joined by
    a line feed. Null ids and repeated rows stay as they are, and rows alike
    have texts alike; an empty table has no rows. Without ``weights`` they are
    learned, see ``learn``.
    """
    weights = learn(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = [main_text(page.as_py() or "", weights) for page in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return in_small_batches(pages.select("page_id", "url", "html")).mapInArrow(run, kind)
