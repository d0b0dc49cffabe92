"""SimHash fingerprints and their near duplicates, compared bit-sliced."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import as_rows, in_small_batches, joined_hot, one_row_each, rows_of, tiled, without
from quiresmith.llm.graph import components, forest
from quiresmith.session import materialize

SHINGLE = 4
RADIUS = 4
SEGMENTS = 6
LANES = 512
_STEP = 1 << 16
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, signed, of the shingles of a text's words; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    span = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - span + 1].tolist()
    stops = ends[span - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), _STEP):
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + _STEP], stops[at : at + _STEP])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(..., text) with the text replaced by its fingerprint fp (long); a null text counts as empty."""
    keys = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fps = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*map(batch.column, keys), pa.array(fps, pa.int64())], [*keys, "fp"])

    return in_small_batches(docs).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keys), T.StructField("fp", T.LongType())]))


def _above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above ``radius``."""
    above, equal = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def close_pairs(fps: np.ndarray, radius: int = RADIUS, stride: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of fingerprints (uint64) that differ in ``radius`` bits at most.

    Bit plane b holds bit b of all fingerprints, 64 lanes to a word. Each
    fingerprint is held against all lanes at once: planes that differ are
    added two at a time by a carry-save adder into bit-sliced counters that
    saturate. After every ``stride`` planes, rows whose lanes all exceed the
    radius are abandoned, and with the last of them the block.
    """
    n = len(fps)
    lanes = -(-n // 64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    sliced = np.zeros((64, lanes * 64), np.uint8)
    sliced[:, :n] = bits.T
    planes = np.packbits(sliced, axis=1, bitorder="little").view("<u8")
    later = np.zeros((n, lanes * 64), np.uint8)
    later[:, :n] = np.triu(np.ones((n, n), np.uint8), 1)
    alive = np.packbits(later, axis=1, bitorder="little").view("<u8")
    rows = np.flatnonzero(alive.any(axis=1))
    alive = alive[rows]
    own = np.where(bits.astype(bool), _ONES, np.uint64(0))[rows]
    counters = [np.zeros_like(alive) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros_like(alive)
    for b in range(0, 64, 2):
        x, y = planes[b] ^ own[:, b, None], planes[b + 1] ^ own[:, b + 1, None]
        both = x ^ y
        carry = (x & y) | (counters[0] & both)
        counters[0] ^= both
        for c in counters[1:]:
            spill = c & carry
            c ^= carry
            carry = spill
        over |= carry
        if (b + 2) % stride == 0:
            alive &= ~_above(counters, over, radius)
            left = alive.any(axis=1)
            if not left.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if left.mean() < 0.75:
                rows, alive, own, over = rows[left], alive[left], own[left], over[left]
                counters = [c[left] for c in counters]
    i, j = np.nonzero(np.unpackbits(alive.view(np.uint8), axis=1, bitorder="little"))
    return rows[i], j


def _edges_of(radius: int, lanes: int):
    def links(fps: list[np.ndarray]) -> pa.RecordBatch:
        block = np.unique(np.concatenate(fps))
        i, j = close_pairs(block.view("<u8"), radius) if len(block) > 1 else (np.empty(0, int),) * 2
        child, parent = forest(len(block), i, j)
        return pa.record_batch([pa.array(block[parent]), pa.array(block[child])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last = 0, None
        for batch in batches:
            fp, tile = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)])) if len(tile) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                # Whole tiles share a block while they fit; pairs across tiles are true links as well.
                if tile[a] != last and size and size + (b - a) > lanes:
                    yield links(held)
                    held, size = [], 0
                held.append(fp[a:b])
                size, last = size + (b - a), tile[a]
        if size:
            yield links(held)

    return run


def linked(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, lanes: int = LANES) -> DataFrame:
    """Forest edges (a, b) over distinct fps(fp) that join all fingerprints within ``radius``.

    With ``segments`` > radius segments, fingerprints that differ in at most
    ``radius`` bits agree in at least ``segments - radius`` of them; each
    choice of so many segments is a table, and the fingerprints of a bucket
    are held against each other bit-sliced. Large buckets are cut in tiles.
    """
    agree = segments - radius
    if agree < 1:
        raise ValueError("segments must exceed the radius")
    bounds = [round(64 * k / segments) for k in range(segments + 1)]
    masks = []
    for chosen in combinations(range(segments), agree):
        mask = sum(((1 << bounds[s + 1]) - (1 << bounds[s])) for s in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    tables = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("_e")).select("fp", "_e.t", "_e.k")
    dealt = tiled(keyed, ["t", "k"], "fp", lanes // 2)
    dealt = dealt.select("fp", F.xxhash64("t", "k", "tile_i", "tile_j").alias("tile"))
    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(_edges_of(radius, lanes), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for docs(doc_id, text), one row per document; further columns but the text stay.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is
    the smallest doc_id reachable over links, the document's own included. A
    null or empty text has fingerprint 0, linked like any other; documents
    with a null id get the smallest id of their component (null if it has
    none); repeated rows stay as they are; an empty table gives no rows. Texts
    of any length are read whole. Columns named fp or component_id give way.
    """
    marked = materialize(fingerprints(without(docs, "fp", "component_id"), shingle), "simhash")
    first = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-distinct", F.count(F.lit(1)).alias("fps"), F.sum("n").alias("docs"))
    groups = components(linked(first.select("fp"), radius))
    named = first.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    by_fp = joined_hot(named.select("fp", "root", "n"), smallest, "root", "_n", first.facts["fps"]).select("fp", "component_id", "n")
    return joined_hot(marked, materialize(by_fp, "simhash-facts"), "fp", "n", first.facts["docs"] or 0).select(*marked.columns, "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text, ...) with one document of each component, the one of the smallest id.

    Of several with that id, the smallest hash of the text decides, then that
    of all columns; all columns stay as they are, whatever their names. Rows
    without an id stand behind all others. Null and empty texts are one
    document; an empty table gives no rows.
    """
    rows = as_rows(docs)
    marked = near_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text"), "hash"), shingle, radius)
    keys = materialize(marked.groupBy("component_id", F.col("doc_id").alias("id"), "hash").agg(F.count(F.lit(1)).alias("n")), "simhash-keys", F.count(F.lit(1)).alias("keys"))
    kept = keys.groupBy("component_id").agg(F.min(F.struct("id", "hash")).alias("k"), F.count(F.lit(1)).alias("_n"))
    # What goes is less than what stays: only its keys meet the texts.
    judged = materialize(joined_hot(keys, kept, "component_id", "_n", keys.facts["keys"]).select("id", "hash", "n", (F.struct("id", "hash") == F.col("k")).alias("stays")), "simhash-judged")
    left = rows.join(judged.where(~F.col("stays")).select("id", "hash"), ["id", "hash"], "left_anti")
    return one_row_each(left, ["id", "hash"], judged.where("stays and n > 1").select("id", "hash")).select("row.*")
