"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t. A rotation
spreads that distance over all coordinates; split into m blocks, any such pair
is within 1/m of the budget in one block at least. In each block vectors are
range-joined: cells, one radius wide, of a grid over the block's first axes,
with each vector copied to the next cell of each axis, and the block's own
budget as a filter. The union of the blocks' candidates is verified exactly.
How many blocks there are and how many axes are cut depends on the label's
size: what gives cells of a task's size with the fewest copies.
Coordinates are rounded to a lattice once, so that block distances are exact
integers and every task agrees on the first block that a pair meets in; there
it counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.common import joined_hot, rows_of, tiled
from quiresmith.llm.graph import components, forest
from quiresmith.session import discard, materialize

COSINE = 0.98
#: Vectors that a cell of the grid should hold, and half of those that a tile may.
CELL_ROWS = 4096
CHUNK = 2048
_LATTICE = 1 << 20
#: What rounding to the lattice can add to a squared distance of this size.
_SLACK = 1e-5
_SLAB = 256


def _rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _splits(dim: int, blocks: int) -> list[tuple[int, int]]:
    bounds = [round(dim * k / min(blocks, dim)) for k in range(min(blocks, dim) + 1)]
    return list(zip(bounds[:-1], bounds[1:]))


def _budget(cosine: float, splits: list[tuple[int, int]], dim: int) -> list[float]:
    """Each block's share of the squared distance, in lattice units, in proportion to its axes."""
    whole = (2 - 2 * cosine + _SLACK) * _LATTICE**2
    return [whole * (b - a) / dim for a, b in splits]


def grid(n: int, dim: int, cosine: float, cell_rows: int) -> tuple[int, int]:
    """Blocks, and axes cut in each, for n vectors: the fewest copies with cells of about ``cell_rows``.

    Of two coordinates with a normal spread, as a rotation gives them, a cell
    and the one before hold the share ``near`` on one axis. An axis doubles a
    vector's copies. Where no grid is fine enough, the finest of the best is
    taken, and its cells fall in several tiles.
    """
    best = None
    blocks = 1
    while blocks <= dim:
        near = min(0.95, 2 * 0.2821 * (dim * max(2 - 2 * cosine, 1e-12) / blocks) ** 0.5)
        axes = max(0, math.ceil(math.log(max(1.0, n / cell_rows)) / -math.log(near)))
        cut = min(axes, dim // blocks)
        left = near**cut * n / cell_rows  # tiles along a side of a cell that is too large
        cost = (blocks * 2**cut * max(1.0, left), blocks)
        if best is None or cost < best[0]:
            best = (cost, blocks, cut)
        blocks *= 2
    return best[1:]


def _cells(cosine: float):
    """Kernel over reps: adds the lattice coordinates and the cells of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1024):
            dims, axes, blocks = (batch.column(c).to_numpy() for c in ("dim", "axes", "blocks"))
            texts = batch.column("embedding").to_pylist()
            points, cells = [], []
            for dim, cut, m, x in zip(dims, axes, blocks, texts):
                v = _scaled(np.array([x], float))[0]
                u = np.rint((v / np.sqrt(v @ v)) @ _turn(dim) * _LATTICE).astype(np.int32)
                points.append(u.tobytes())
                cells.append(_cells_of(u, int(cut), int(dim), cosine, int(m)))
            names = batch.schema.names
            yield pa.record_batch([*batch.columns, pa.array(points, pa.binary()), pa.array(cells, pa.list_(_CELL))], [*names, "point", "cells"])

    turns: dict[int, np.ndarray] = {}

    def _turn(dim: int) -> np.ndarray:
        if dim not in turns:
            turns[dim] = _rotation(dim)
        return turns[dim]

    return run


_CELL = pa.struct([("block", pa.int32()), ("cell", pa.int64()), ("home", pa.int32())])


def _cells_of(u: np.ndarray, cut: int, dim: int, cosine: float, blocks: int) -> list[dict]:
    """Cells of a point: in each block its own, and the next along any of the cut axes; ``home`` has a bit for each axis where it is the point's own.

    Two points at most a radius apart lie in the same or in neighbouring cells of each axis, and meet in the higher one.
    """
    found = []
    splits = _splits(dim, blocks)
    for b, ((lo, hi), budget) in enumerate(zip(splits, _budget(cosine, splits, dim))):
        width = budget**0.5 + 1
        own = [int(c // width) for c in u[lo : min(hi, lo + cut)].tolist()]
        for step in product((0, 1), repeat=len(own)):
            key = b
            for part, more in zip(own, step):
                key = (key * 1_000_003 + part + more) & 0xFFFFFFFFFFFFFFFF
            home = sum(1 << k for k, more in enumerate(step) if not more)
            found.append({"block": b, "cell": key - (1 << 64) if key >> 63 else key, "home": home})
    return found


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor lose digits."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _lifted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two forms of lattice points whose products are squared distances, exact in any order of summation."""
    square, one = (points * points).sum(axis=1, keepdims=True), np.ones((len(points), 1))
    return np.hstack((points, square, one)), np.hstack((-2 * points, one, square))


def _pairs(cosine: float):
    """Kernel over whole tiles: counts of links per rep, and forest edges."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, tile_i, tile_j, blocks, axes = (key[k].as_py() for k in (1, 3, 4, 6, 7))
        table = table.sort_by("rep")
        rep, n, home, part = (table.column(c).to_numpy() for c in ("rep", "n", "home", "part"))
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        unit = _scaled(flat.reshape(len(rep), -1))
        dim = unit.shape[1]
        norm = np.sqrt((unit * unit).sum(axis=1))
        points = np.frombuffer(b"".join(table.column("point").to_pylist()), np.int32).reshape(-1, dim).astype(float)
        splits = _splits(dim, blocks)
        budget = _budget(cosine, splits, dim)
        lifted = [_lifted(points[:, a:b]) for a, b in splits[: block + 1]]
        count = np.zeros(len(rep), np.int64)
        left, right = [], []

        def along(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Products of the pairs' rows, each summed in the same order wherever the pair is met."""
            cuts = range(0, len(i), 1 << 15)
            return np.concatenate([np.einsum("ij,ij->i", a[i[c : c + (1 << 15)]], b[j[c : c + (1 << 15)]]) for c in cuts])

        for at in range(0, len(rep), _SLAB):
            stop = min(at + _SLAB, len(rep))
            i, j = np.nonzero(lifted[block][0][at:stop] @ lifted[block][1][at:].T <= budget[block])
            i, j = i + at, j + at
            # A pair counts once: in the higher cell of each axis, in the tile of both parts, and in its first block.
            keep = (i < j) & ((home[i] | home[j]) == (1 << axes) - 1)
            if tile_i != tile_j:
                keep &= part[i] != part[j]
            i, j = i[keep], j[keep]
            for k in range(block):
                if len(i):
                    keep = along(i, j, *lifted[k]) > budget[k]  # whole numbers, exact in any order
                    i, j = i[keep], j[keep]
            if not len(i):
                continue
            keep = along(i, j, unit, unit) / (norm[i] * norm[j]) >= cosine
            i, j = i[keep], j[keep]
            count += np.bincount(i, n[j], len(rep)).astype(np.int64) + np.bincount(j, n[i], len(rep)).astype(np.int64)
            left.append(i.astype(np.int32))
            right.append(j.astype(np.int32))
        i, j = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (left, right))
        child, root = forest(len(rep), i, j)
        linked = np.flatnonzero(count)
        return pa.table(
            {
                "a": pa.array(np.concatenate((rep[linked], rep[root]))),
                "b": pa.array(np.concatenate((rep[linked], rep[child]))),
                "links": pa.array(np.concatenate((count[linked], np.zeros(len(child), np.int64)))),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors(vec_id, embedding, label), one row per vector.

    Vectors of one label link at ``cosine`` or more, in double precision.
    Equal vectors are compared as one and count as many. Null labels, null or
    zero vectors, null or non-finite components and vectors with a null id
    link with nothing: n_links 0, their own component. Vectors of different
    dimension do not link. Rows that repeat an id are vectors of their own,
    in links and in components. An empty table gives no rows; further columns
    are not read.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    # -0.0 and 0.0 are one value to grouping and to the cosine, so they are to the hashes that find a row's vector again.
    plain = F.transform(x, lambda c: F.when(c == 0, F.lit(0).cast(vectors.schema["embedding"].dataType.elementType)).otherwise(c))
    rows = vectors.select("vec_id", "label", plain.alias("embedding"), sound.alias("sound"))
    rows = rows.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(2), "embedding", "label")})
    reps = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    # Numbers of their own, fixed by writing them.
    reps = materialize(reps.withColumns({"dim": F.size("embedding"), "rep": F.monotonically_increasing_id()}), "vector-reps", F.count(F.lit(1)).alias("reps"), F.sum("n").alias("rows"))
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    # A grid for every power of two of a label's size, by a short table.
    power = F.ceil(F.log2("size")).cast("int")
    grids = [(dim, k, *grid(1 << k, dim, cosine, cell_rows)) for (dim,) in reps.select("dim").distinct().toLocalIterator() for k in range(48)]
    spark = vectors.sparkSession
    known = F.broadcast(spark.createDataFrame(grids, "dim int, power int, blocks int, axes int"))
    per_label = sizes.withColumn("power", power).join(known, ["dim", "power"]).select("label", "dim", "blocks", "axes")
    kept = ["rep", "n", "label", "dim", "embedding", "blocks", "axes"]
    celled = reps.join(per_label, ["label", "dim"]).select(*kept)
    kind = f"{', '.join(f'{c} {celled.schema[c].dataType.simpleString()}' for c in kept)}, point binary, cells array<struct<block: int, cell: long, home: int>>"
    points = materialize(celled.mapInArrow(_cells(cosine), kind), "vector-cells")
    flat = points.select(*kept, "point", F.explode("cells").alias("_c")).select(*kept, "point", "_c.block", "_c.cell", "_c.home")
    dealt = tiled(flat, ["label", "block", "cell", "dim"], "rep", CHUNK)
    pairs = dealt.groupBy("label", "block", "cell", "tile_i", "tile_j", "dim", "blocks", "axes").applyInArrow(_pairs(cosine), "a long, b long, links long")
    pairs = materialize(pairs, "vector-links")
    discard(points)
    counted = pairs.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(pairs.where("links = 0").select("a", "b"))
    named = reps.select("rep", "first_id", "n", "h1", "h2").join(counted, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("root", F.coalesce("root", "rep"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    facts = joined_hot(named, smallest, "root", "_n", reps.facts["reps"]).select("h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    facts = materialize(facts.withColumn("h", F.struct("h1", "h2")).drop("h1", "h2"), "vector-facts")
    full = joined_hot(rows.where("sound").select("vec_id", F.struct("h1", "h2").alias("h")), facts, "h", "n", reps.facts["rows"] or 0).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = full.unionByName(alone)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
