"""Ranked search against brute force, and its blocks against all cuts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quiresmith.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(lexical.UPPER, lexical.LOWER)
SYLLABLES = "the of and to in is ti on er re st nd ou ea ha th es en".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def brute(docs, items, k=10):
    counts = [Counter(TERM.findall((r[1] or "").translate(FOLD))) for r in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = Counter()
    for item_id, text in items:
        terms = set(TERM.findall((text or "").translate(FOLD)))
        scored = []
        for (doc_id, *_), c, n in zip(docs, counts, sizes):
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms))) for t in terms if t in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        out.update((item_id, rank, x[2], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    docs = [(k, prose(rng, rng.randint(1, 150)), "x", 1) for k in range(400)]
    docs += [(500 + k, docs[k % 3][1], "x", 1) for k in range(60)]  # copies: ties beyond the tenth
    docs += [(600, None, "x", 1), (601, "", "x", 1), (602, " -- !! ", "x", 1), (603, prose(rng, 30_000), "x", 1), (None, docs[5][1], "x", 1), (None, "ÀÉ Über naïve 日本語", "x", 1), (604, "ÀÉ ÜBER Naïve 日本語 x\u0085y", "x", 1), (604, "THE the_of-And", "x", 1), (604, "THE the_of-And", "x", 1)]
    rng.shuffle(docs)
    items = [(k, " ".join(docs[k * 7][1].split()[:20]) if docs[k * 7][1] else "the of and") for k in range(30)]
    items += [(40, None), (41, ""), (42, "..."), (43, "nowhere-to-be-found zzzz"), (44, "the The THE of"), (44, "naïve Über"), (None, "日本語 and"), (45, prose(rng, 600))]
    return docs, items


@pytest.mark.parametrize("small", [True, False])
def test_ranked_search(spark, tables, monkeypatch, small):
    docs, items = tables
    if small:
        for name, size in (("SHARD_DOCS", 50), ("PIECE", 64), ("VOCABULARY", 100), ("QUERY_TERMS", 200), ("CELL", 2), ("FIRST_DOCS", 3)):
            monkeypatch.setattr(lexical, name, size)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, rank int").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, query int")
    got = Counter(tuple(r) for r in lexical.rank(df, asked).collect())
    want = brute(docs, items)
    assert got == want and len(want) > 250
    assert lexical.rank(df.where("false"), asked).count() == 0 and lexical.rank(df, asked.where("false")).count() == 0


def test_terms_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcXYZ019 .,-_é日 \u0085\t\n") for _ in range(5000))
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert [t.decode() for piece in lexical.terms_of(text.encode()) for t in piece] == TERM.findall(text.translate(FOLD))


def test_block_boundaries_are_the_best_ones():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(2, 11))
        impacts = rng.integers(1, 100, n)
        cost = float(rng.choice([0.0, 0.5, 2.0]))

        def price(ends):
            starts = [0, *ends[:-1]]
            return sum(impacts[a:b].max() * (b - a) for a, b in zip(starts, ends)) + cost * impacts.mean() * len(ends)

        every = [(*inner, n) for r in range(n) for inner in combinations(range(1, n), r) if all(b - a <= 4 for a, b in zip((0, *inner), (*inner, n)))]
        found = tuple(lexical.block_ends(impacts, cell=1, longest=4, cost=cost).tolist())
        assert found in every and math.isclose(price(found), min(map(price, every)))


def test_blocks_below_the_tenth_score_are_skipped():
    places = np.arange(4096, dtype=np.int32)
    impacts = np.full(4096, 10)
    impacts[100:110] = 1000
    one = lexical._Postings(places, impacts)
    assert len(one.end) > 2
    seen = []
    full = lexical._ranges
    lexical._ranges, top = (lambda a, b: seen.append(int((b - a).sum())) or full(a, b)), np.zeros((0, 3), np.int64)
    try:
        top = lexical.best_in_shard([(3, one)], 4096, np.arange(4096), np.ones(4096, np.int64), top, 10)
    finally:
        lexical._ranges = full
    assert top[:, 0].tolist() == [3000] * 10 and top[:, 1].tolist() == list(range(100, 110))
    assert max(seen) <= 512
