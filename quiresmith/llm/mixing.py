"""Mixing sources to target weights by balanced sampling (the cube method).

Every source gets a target: its share, by weight, of all words, stopped at a
multiple of the source's own words. A source's rate (target / words) says how
often each of its documents is taken: the whole part for certain, the
fractional part with that probability. The cube method turns these inclusion
probabilities into 0 or 1 while it keeps two totals of each source in place,
words and documents: it moves the probabilities of a window of documents
along the null space of both totals until one of them is decided, then lets
the next one in, long documents first. Documents fly in blocks, many tasks per
source; each block leaves a few short ones undecided. Those of a source land
together, and when too few are left for both totals, the document total is
dropped, then the word total, so that only a short document is rounded.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.llm.common import as_rows, one_row_each, word_count
from quiresmith.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_ROWS = 2048
#: Undecided short documents that a block leaves to the landing.
SPARE = 8
_EPS = 1e-9
#: Rows alike that one task numbers.
_ALIKE = 128


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, source_docs, source_rank, target for sizes(source, size, and n where a row stands for n).

    Sources by code point, null last, take the weights in turn. Targets are
    min(max_repeats * size, level * weight), where the level makes them sum to
    all words: sources are passed in order of the level that fills them, and
    the level that the rest can hold is read off running sums.
    """
    n = F.col("n") if "n" in sizes.columns else F.lit(1)
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * n).alias("source_size"), F.sum(n).alias("source_docs"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("source_rank", F.row_number().over(in_order) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_full", max_repeats * F.col("source_size") / F.col("_w"))
    before = Window.orderBy("_full", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_full", "source_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumn("_total", F.sum("source_size").over(everything))
    level = (F.col("_total") - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(rest)
    ranked = ranked.withColumn("_level", level)
    held = F.when(F.col("_level") <= F.col("_full"), F.col("_full"))
    ranked = ranked.withColumn("_held", F.min_by("_level", held).over(everything))
    target = F.least(max_repeats * F.col("source_size").cast("double"), F.col("_held") * F.col("_w"))
    return ranked.select("source", "source_size", "source_docs", "source_rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def _move(u: list[float], pi: list[float], rng: random.Random) -> None:
    """One martingale step of ``pi`` along ``u`` that drives an entry to 0 or 1."""
    up = down = float("inf")
    for d, p in zip(u, pi, strict=True):
        if d > 0:
            up, down = min(up, (1 - p) / d), min(down, p / d)
        elif d < 0:
            up, down = min(up, -p / d), min(down, (p - 1) / d)
    step = up if rng.random() * (up + down) < down else -down
    for k, d in enumerate(u):
        p = pi[k] + step * d
        pi[k] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p


def _direction(x: np.ndarray) -> np.ndarray:
    """The longest unit's axis, projected onto the null space of word and document totals.

    Where that null space is nil, the document total is dropped, then the word total.
    """
    k = int(np.argmax(x))
    y = x / max(1.0, x[k])
    n, sy, syy = len(y), y.sum(), y @ y
    det = n * syy - sy * sy
    for slope, base in (
        ((n * y[k] - sy) / det, (syy - sy * y[k]) / det) if det > 1e-9 else (0.0, 1.0 / n),
        (y[k] / syy, 0.0) if syy else (0.0, 0.0),
        (0.0, 0.0),
    ):
        u = -(slope * y + base)
        u[k] += 1.0
        if np.abs(u).max() > 1e-7:
            break
    return np.where(np.abs(u) > 1e-12, u, 0.0)


def fly(sizes: list[int], chances: list[float], rng: random.Random, leave: int, window: int = 16) -> list[float]:
    """Decide all but ``leave`` units, keeping the totals of words and documents.

    Units enter a window, the longest first; each step moves the longest of
    the window along ``_direction``, so that the others make up for it, and
    settles one unit at least. The window grows until the others together
    outweigh its longest many times, or a long one would wait to the end. The
    units left are short.
    """
    out = list(chances)
    queue = sorted((k for k, p in enumerate(out) if 0.0 < p < 1.0), key=lambda k: -sizes[k])
    held, queue = queue[:window], iter(queue[window:])
    waiting = True
    while held and (waiting or len(held) > leave):
        pi = [out[k] for k in held]
        _move(_direction(np.array([sizes[k] for k in held], float)).tolist(), pi, rng)
        for k, p in zip(held, pi, strict=True):
            out[k] = p
        held = [k for k in held if 0.0 < out[k] < 1.0]
        longest, total = max((sizes[k] for k in held), default=0), sum(sizes[k] for k in held)
        while waiting and (len(held) < window or total < window * longest // 2):
            k = next(queue, None)
            if k is None:
                waiting = False
            else:
                held.append(k)
                total += sizes[k]
    return out


def _flight(last: bool, seed: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = table.sort_by([("_order", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        rng = random.Random(f"{seed}:{':'.join(str(k.as_py()) for k in key)}:{int(last)}")
        sizes, chances = order.column("size").to_pylist(), order.column("_chance").to_pylist()
        chances = fly(sizes, chances, rng, 0 if last else SPARE)
        return order.set_column(order.schema.get_field_index("_chance"), "_chance", pa.array(chances, pa.float64()))

    return run


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_rows: int = BLOCK_ROWS,
    seed: int = 17,
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Mix docs(doc_id, text, source): doc_id, source, size, source_size, target, copies.

    One row per document; ``copies`` (0 to max_repeats) is how often the mix
    takes it. Draws hang on ids, texts and seed alone, so reruns agree
    whatever the partitioning. A null text has size 0; a null source is a
    source of its own, the last; null ids and repeated rows are documents like
    any other, told apart by a running number, and fly in many blocks; texts
    of any length are counted whole; an empty table gives an empty mix.
    ``keys`` are the columns that the mix keeps, doc_id first.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    every = docs.select(*keys, "source", word_count(F.col("text")).alias("size"), digest.alias("_hash"))
    counted = materialize(every.groupBy(*keys, "source", "size", "_hash").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    plan = source_targets(counted, weights, max_repeats)
    # Rows that are alike get running numbers, in parts so that no task makes all of them.
    parts = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _ALIKE).cast("int")))).repartition("_hash", "_part")
    last = F.least((F.col("_part") + 1) * _ALIKE, F.col("n")) - 1
    sizes = parts.withColumn("_k", F.explode(F.sequence((F.col("_part") * _ALIKE).cast("long"), last.cast("long"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sizes.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_rate", F.least(rate, F.lit(float(max_repeats))))
        .withColumn("_whole", F.floor("_rate").cast("int"))
        .withColumn("_chance", F.col("_rate") - F.col("_whole"))
        .withColumn("_order", F.xxhash64("doc_id", "_hash", "_k", F.lit(seed)))
    )
    keep = [*keys, "source", "size", "source_size", "target", "source_rank", "_whole", "_chance", "_order"]
    kind = rows.select(*keep).schema

    def flown(df: DataFrame, blocks: Column, last: bool = False) -> DataFrame:
        flight = _flight(last, seed)
        dealt = df.select(*keep, blocks.alias("_block")).groupBy("source_rank", "_block")
        return dealt.applyInArrow(lambda key, t: flight(key, t.drop_columns("_block")), kind)

    def block(level: int, blocks: Column) -> Column:
        return F.pmod(F.xxhash64("_order", F.lit(level)), F.greatest(blocks, F.lit(1))).cast("int")

    state = materialize(flown(rows, block(1, F.ceil(F.col("source_docs") / block_rows))), "mix-flight")
    open_ = (F.col("_chance") > 0) & (F.col("_chance") < 1)
    done, left = state.where(~open_), state.where(open_)
    # A block leaves SPARE units at most, so each level shrinks a large source by block_rows / SPARE.
    most = counted.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    level = 1
    while (most := SPARE * -(-most // block_rows)) > block_rows:
        level += 1
        state = materialize(flown(left, block(level, F.lit(-(-most // block_rows)))), "mix-flight")
        done, left = done.unionByName(state.where(~open_)), state.where(open_)
    landed = flown(left, F.lit(0), last=True)
    copies = (F.col("_whole") + F.col("_chance").cast("int")).alias("copies")
    return done.unionByName(landed).select(*keys, "source", "size", "source_size", "target", copies)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text, source, ...) with each document as often as the mix takes it; those not taken go.

    All columns stay as they are, whatever their names. Rows that share id,
    text and source are taken as often as the mix takes all of them together,
    all as the one with the smallest hash of its columns.
    """
    rows = as_rows(docs).withColumn("from", F.xxhash64("row.source"))
    keyed = rows.select(F.col("id").alias("doc_id"), "hash", F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    taken = mix(keyed, keys=("doc_id", "hash"), **options)
    totals = taken.groupBy(F.col("doc_id").alias("id"), "hash", F.xxhash64("source").alias("from")).agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("n"))
    totals = materialize(totals, "mix-totals")
    keys = ["id", "hash", "from"]
    once = one_row_each(rows, keys, totals.where("copies > 0 and n > 1").select(*keys))
    found = once.join(totals.where("copies > 0").select(*keys, "copies"), keys)
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
