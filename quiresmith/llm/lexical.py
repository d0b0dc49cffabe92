"""Ranked lexical search with variable-size posting blocks.

Documents become shards, each one row: posting lists of its terms, with the
documents' lengths. Before a shard is searched, every list is cut into blocks
of postings, where dynamic programming puts the boundaries: those that make the
sum of the blocks' maxima, each times its postings, least. A query's block
maxima add up to a bound for every run of documents between two boundaries of
its lists. As in WAND, a run whose bound is below the k-th score so far cannot
hold a result: its blocks are skipped. What is left is scored in full, the
highest bounds first. Lists of results are carried on from shard to shard of a
task and merged across tasks.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.llm.common import rows_of
from quiresmith.session import discard, materialize

#: Fixed value: what terms consist of; ASCII letters and digits and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for bytes of UTF-8: what is no term becomes a blank.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Documents and postings of a shard, about; terms that are told to all tasks, and terms of the queries that are searched at once.
SHARD_DOCS, SHARD_POSTINGS, VOCABULARY, QUERY_TERMS = 32_768, 1 << 22, 1 << 20, 1 << 20
#: Postings that stay together, cells that a block may have, and what a block costs, in mean impacts of its list.
CELL, BLOCK_CELLS, BLOCK_COST = 8, 32, 8.0
#: Documents that a search scores first, and how many times as many each time after.
FIRST_DOCS, GROWTH = 128, 8
#: Fixed values of the score: 1000 tf + 8 m below, m = 10 + 90 n N / L.
_SCALE, _TF, _M, _BASE, _SLOPE = 1_000_000_000, 1000, 8, 10, 90

_SHARD = "shard long, held long, words long, ids binary, named binary, lengths binary, terms array<binary>, frequencies array<int>, places binary, counts binary"


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces, so that a text of any length takes a bounded list."""
    data, at = data.translate(_FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Shard:
    """A shard as it grows."""

    def __init__(self, known: dict[bytes, int] | None):
        self.known, self.fixed = ({}, False) if known is None else (known, True)
        self.ids, self.named, self.lengths = array("q"), array("b"), array("q")
        self.term, self.place, self.count = array("i"), array("i"), array("i")
        self.held = self.words = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found, n = Counter(), 0
        for piece in terms_of(text):
            n += len(piece)
            found.update(piece)
        self.held += n > 0
        self.words += n
        mine = [t for t in found if t in self.known] if self.fixed else list(found)
        if mine:
            place = len(self.ids)
            self.ids.append(0 if doc_id is None else doc_id)
            self.named.append(doc_id is not None)
            self.lengths.append(n)
            self.term.extend(self.known[t] if self.fixed else self.known.setdefault(t, len(self.known)) for t in mine)
            self.place.extend([place] * len(mine))
            self.count.extend(found[t] for t in mine)

    def row(self, shard: int) -> pa.RecordBatch:
        term, place, count = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (self.term, self.place, self.count))
        order = np.argsort(term, kind="stable")
        which, frequency = np.unique(term, return_counts=True)
        names = list(self.known)  # in the order of their numbers
        values = [shard, self.held, self.words, self.ids.tobytes(), self.named.tobytes(), self.lengths.tobytes(), [names[k] for k in which.tolist()], frequency.tolist(), place[order].tobytes(), count[order].tobytes()]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.list_(pa.binary()), pa.list_(pa.int32())] + [pa.binary()] * 2
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], [x.split()[0] for x in _SHARD.split(", ")])


def index(docs: DataFrame, vocabulary: Iterable[bytes] | None = None) -> DataFrame:
    """A row per shard of docs(doc_id, text): posting lists, in order of place, of all terms or those of a bounded ``vocabulary``.

    ``held`` and ``words`` count all documents with terms and all their terms.
    Shards are made where the documents are read; nothing is shuffled.
    """
    known = None if vocabulary is None else {t: k for k, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, docs_in = TaskContext.get().partitionId() << 32, _Shard(known), 0
        for batch in rows_of(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                shard.add(doc_id, text.as_py() or b"")
                docs_in += 1
                if docs_in >= SHARD_DOCS or len(shard.term) >= SHARD_POSTINGS:
                    yield shard.row(number)
                    number, shard, docs_in = number + 1, _Shard(known), 0
        if docs_in:
            yield shard.row(number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SHARD)


def block_ends(impacts: np.ndarray, cell: int = CELL, longest: int = BLOCK_CELLS, cost: float = BLOCK_COST) -> np.ndarray:
    """Past-last places of a list's blocks: of all cuts between cells the one with the least sum of maxima times sizes and costs of blocks."""
    n = len(impacts)
    if n <= cell:
        return np.array([n])
    starts = np.arange(0, n, cell)
    ends = np.append(starts[1:], n)
    maxima = np.maximum.reduceat(impacts, starts).astype(float)
    cost = cost * float(impacts.mean())
    best, back = np.zeros(len(starts) + 1), np.zeros(len(starts) + 1, int)
    for i in range(1, len(starts) + 1):
        low = max(0, i - longest)
        # Blocks that end with cell i - 1 and begin ever earlier.
        total = best[low:i][::-1] + np.maximum.accumulate(maxima[low:i][::-1]) * (ends[i - 1] - starts[low:i][::-1])
        k = int(total.argmin())
        best[i], back[i] = total[k] + cost, i - 1 - k
    cuts, at = [], len(starts)
    while at:
        cuts.append(ends[at - 1])
        at = back[at]
    return np.array(cuts[::-1])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All whole numbers of ranges that do not overlap."""
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class _Postings:
    """One term's list in a shard: places, impacts and blocks."""

    def __init__(self, places: np.ndarray, impacts: np.ndarray):
        self.places, self.impacts = places, impacts
        self.end = block_ends(impacts)
        self.start = np.append(0, self.end[:-1])
        self.first, self.past = places[self.start], places[self.end - 1] + 1
        self.most = np.maximum.reduceat(impacts, self.start)


def impacts_of(counts: np.ndarray, lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a term adds to a document's score, but for its weight."""
    if int(lengths.max(initial=0)) * _SLOPE * documents < 1 << 63:
        m = _BASE + lengths * (_SLOPE * documents) // words
    else:
        m = np.array([_BASE + int(n) * _SLOPE * documents // words for n in lengths], np.int64)
    return _SCALE * counts.astype(np.int64) // (_TF * counts.astype(np.int64) + _M * m)


def best_in_shard(lists: list[tuple[int, _Postings]], docs: int, ids: np.ndarray, named: np.ndarray, top: np.ndarray, k: int) -> np.ndarray:
    """The k best of ``top`` and a shard: rows (score, id, named), higher scores first, then smaller ids, then those without.

    ``lists`` are weights and postings of a query's terms in the shard.
    """
    lists = [(w, p) for w, p in lists if w > 0]
    if not lists:
        return top
    edges = np.unique(np.concatenate([x for _, p in lists for x in (p.first, p.past)]))
    rise = np.zeros(len(edges), np.int64)
    spans = []
    for w, p in lists:
        a, b = np.searchsorted(edges, p.first), np.searchsorted(edges, p.past)
        # Blocks of one list may touch, not overlap, so that no edge is a start twice.
        rise[a] += w * p.most
        rise[b] -= w * p.most
        spans.append((a, b))
    bound = np.cumsum(rise)[:-1]
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    size = np.cumsum((edges[1:] - edges[:-1])[order])
    at, limit, score = 0, FIRST_DOCS, np.zeros(docs, np.int64)
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(size, limit)))
        runs = np.sort(order[at:end])
        if len(top) >= k:
            runs = runs[bound[runs] >= top[-1, 0]]
            if not len(runs):
                break
        taken = np.zeros(len(edges), np.int64)
        taken[runs + 1] = 1
        taken = np.cumsum(taken)  # runs taken before an edge
        for (w, p), (a, b) in zip(lists, spans):
            visit = taken[b] > taken[a]
            if visit.all():
                score[p.places] += w * p.impacts
            elif visit.any():
                some = _ranges(p.start[visit], p.end[visit])
                score[p.places[some]] += w * p.impacts[some]
        places = _ranges(edges[runs], edges[runs + 1])
        hits = places[score[places] > 0]
        if len(top) >= k:
            hits = hits[score[hits] >= top[-1, 0]]
        score_of = score[hits]
        top = np.concatenate((top, np.stack((score_of, ids[hits], named[hits]), 1)))
        top = top[np.lexsort((top[:, 1], -top[:, 2], -top[:, 0]))][:k]
        score[:] = 0  # blocks that reach beyond the runs have left parts of scores
        at, limit = end, limit * GROWTH
    return top


def _search(queries: list[tuple[int, list[bytes]]], weights: dict[bytes, int], documents: int, words: int, k: int):
    """Kernel over shards: each query's k best of all that the task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [np.zeros((0, 3), np.int64) for _ in queries]
        for batch in rows_of(batches, 1):
            shard = batch.to_pylist()[0]
            ids, lengths = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["lengths"], np.int64)
            named = np.frombuffer(shard["named"], np.int8).astype(np.int64)
            places, counts = np.frombuffer(shard["places"], np.int32), np.frombuffer(shard["counts"], np.int32)
            ends = np.cumsum(shard["frequencies"])
            lists = {}
            for term, n, end in zip(shard["terms"], shard["frequencies"], ends):
                if term in weights:
                    mine = places[end - n : end]
                    lists[term] = _Postings(mine, impacts_of(counts[end - n : end], lengths[mine], documents, words))
            for q, (_, terms) in enumerate(queries):
                tops[q] = best_in_shard([(weights[t], lists[t]) for t in terms if t in lists], len(ids), ids, named, tops[q], k)
        number = np.repeat([q for q, _ in queries], [len(t) for t in tops]).astype(np.int64)
        found = np.concatenate([np.zeros((0, 3), np.int64), *tops])
        yield pa.record_batch([pa.array(number), pa.array(found[:, 1], mask=found[:, 2] == 0), pa.array(found[:, 0]), pa.array(np.full(len(found), TaskContext.get().partitionId(), np.int32))], ["query", "doc_id", "score", "task"])

    return run


def terms_column(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))), F.array().cast("array<string>"))


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents, of a score above 0, for each of items(item_id, text) in docs(doc_id, text).

    Terms are the runs of characters that ``TERM`` matches, with only A-Z
    lower-cased. A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a
    document of n terms has m = 10 + (90 n N) div L and scores the sum of
    weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's distinct terms;
    N counts documents with terms, L their terms. Equal scores come in order
    of doc_id, missing ids last. Null and empty texts have no terms and take
    no part; texts of any length count whole; repeated rows, also of items,
    are rows of their own; empty tables give no rows.

    The items' terms are told to all tasks in parts of about ``QUERY_TERMS``,
    a search each; where they have more than ``VOCABULARY`` distinct terms,
    the index keeps all terms instead of theirs.
    """
    asked = items.select(F.monotonically_increasing_id().alias("query"), "item_id", terms_column(F.col("text")).alias("terms"))
    asked = materialize(asked, "lexical-items", F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n"))
    distinct = asked.select(F.explode("terms").alias("term")).distinct()
    few = distinct.limit(VOCABULARY + 1).collect()
    vocabulary = [r["term"].encode() for r in few] if len(few) <= VOCABULARY else None
    shards = materialize(index(docs, vocabulary), "lexical-index", F.coalesce(F.sum("held"), F.lit(0)).alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    documents, words = shards.facts["documents"], shards.facts["words"]
    pairs = shards.select(F.explode(F.arrays_zip("terms", "frequencies")).alias("x")).select(F.col("x.terms").cast("string").alias("term"), F.col("x.frequencies").alias("n"))
    frequency = pairs.groupBy("term").agg(F.sum("n").alias("df"))

    chunks = max(1, -(-asked.facts["n"] // QUERY_TERMS))
    found = None
    for chunk in range(chunks):
        mine = asked.where(F.pmod(F.xxhash64("query"), F.lit(chunks)) == chunk)
        queries = [(r["query"], [t.encode() for t in r["terms"]]) for r in mine.select("query", "terms").collect()]
        known = mine.select(F.explode("terms").alias("term")).distinct().join(frequency, "term").collect()
        weights = {r["term"].encode(): math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1))) for r in known}
        part = shards.mapInArrow(_search(queries, weights, documents, words, k), "query long, doc_id long, score long, task int")
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = Window.partitionBy("query", F.pmod("task", F.lit(64))).orderBy(*order)
    far = Window.partitionBy("query").orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).withColumn("rank", F.row_number().over(far)).where(F.col("rank") <= k)
    out = materialize(best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score"), "lexical-ranked")
    discard(asked, shards)
    return out
