"""Exact top-k search by tiled matrix products.

Vectors become integers and are packed, queries into blocks, each one row of
bytes. A task holds a shard of several packs and the blocks stream by: every
block and pack are a tile, one matrix product, of which each query keeps its k
best. The lists of a query are merged in three levels: within its shard, within
groups of shards, and across them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.llm.common import rows_of, streamed
from quiresmith.session import materialize

SCALE = 1024.0
#: Rows of a pack, packs of a shard that one task holds, queries of a block.
PACK_ROWS, SHARD_PACKS, BLOCK_ROWS = 4096, 64, 512
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_NONE = -(1 << 63)


def whole_numbers(vectors: DataFrame, scale: float = SCALE, *more: str) -> DataFrame:
    """vec_id, v (array of double: floor(scale * x)) and ``more`` columns; rows with a null id, a null or a non-finite component are left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    # floor() gives a long; doubles that a long cannot hold have no fraction to drop.
    scaled = lambda x: x.cast("double") * scale
    v = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) >= 1e18, scaled(x)).otherwise(F.floor(scaled(x)).cast("double")))
    return vectors.where(sound).select("vec_id", v.alias("v"), *more)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, as longs: exact in doubles up to 2^53, in whole numbers of any size beyond, held to a long's range."""
    if not q.size or not c.size or max(1.0, np.abs(q).max()) * max(1.0, np.abs(c).max()) * q.shape[1] < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(q) @ whole(c).T, -_LONG, _LONG).astype(np.int64)


def _pack(rows: DataFrame, key: str) -> DataFrame:
    """One row per key and dimension: row numbers, ids in rising order and their vectors, as bytes of longs and doubles."""

    def run(k: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = table.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        uids, ids = (order.column(c).to_numpy().astype("<i8").tobytes() for c in ("uid", "vec_id"))
        flat = order.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({key: pa.array([k[0].as_py()], pa.int32()), "dim": pa.array([k[1].as_py()], pa.int32()), "uids": [uids], "ids": [ids], "mat": [flat.astype("<f8").tobytes()]})

    return rows.groupBy(key, "dim").applyInArrow(run, f"{key} int, dim int, uids binary, ids binary, mat binary")


def best_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of each row's k best scores, ties to the smaller column."""
    n = scores.shape[1]
    if n <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    bar = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above = scores > bar
    # Of the scores at the bar, as many as are missing, from the left.
    level = scores == bar
    keep = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(keep)


def _tile(k: int):
    """Kernel over a shard's packs, which come first, and the blocks of queries that stream by: each query's k best in the shard."""
    names = ["query", "query_id", "uid", "vec_id", "score", "shard"]

    def best(block: dict, packs: list[dict]) -> Iterator[list[np.ndarray]]:
        uids, ids = np.frombuffer(block["uids"], "<i8"), np.frombuffer(block["ids"], "<i8")
        q = np.frombuffer(block["mat"], "<f8").reshape(len(ids), block["dim"])
        for r in packs:
            if r["dim"] != block["dim"]:
                continue
            c_uids, c_ids = np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["ids"], "<i8")
            scores = products(q, np.frombuffer(r["mat"], "<f8").reshape(len(c_ids), r["dim"]))
            scores[uids[:, None] == c_uids[None]] = _NONE
            i, j = best_places(scores, k)
            other = scores[i, j] > _NONE
            i, j = i[other], j[other]
            yield [uids[i], ids[i], c_uids[j], c_ids[j], scores[i, j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packs = None, []
        for batch in rows_of(batches, 16):
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, packs = r["shard"], []
                if not r["kind"]:
                    packs.append(r)
                    continue
                lists = list(best(r, packs))
                if lists:
                    query, query_id, uid, vec_id, score = (np.concatenate(x) for x in zip(*lists))
                    order = np.lexsort((uid, vec_id, ~score, query))
                    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                    top = order[rank < k]
                    yield pa.record_batch([*(pa.array(x[top]) for x in (query, query_id, uid, vec_id, score)), pa.array(np.full(len(top), shard, np.int32))], names)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = SCALE, pack_rows: int = PACK_ROWS, shard_packs: int = SHARD_PACKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query over vectors(vec_id, embedding).

    ``is_query`` is a condition on vec_id. All rows but the query's own are
    candidates; ties go to the smaller vec_id; vectors of another dimension do
    not meet. Rows that repeat an id are candidates each, also of one another,
    and each that is a query has a list of its own. Scores beyond the range of
    a long are held at its ends and tie there. Null vectors, null or
    non-finite components and null ids take no part; without queries or
    candidates there are no rows.
    """
    sound = whole_numbers(vectors, scale).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"))
    v = materialize(sound, "topk-vectors", F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("queries"))
    n, queries = v.facts["n"], v.facts["queries"]
    packs, blocks = max(1, -(-n // pack_rows)), max(1, -(-queries // block_rows))
    # A task holds one shard of several packs and lets the blocks of queries stream by.
    shards = max(-(-packs // shard_packs), min(32, packs))
    number = lambda parts: F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")  # noqa: E731 - by row, so that rows alike are dealt like others
    held = _pack(v.withColumn("pack", number(packs)), "pack").withColumn("shard", F.pmod("pack", F.lit(shards)).cast("int"))
    asked = _pack(v.where(is_query).withColumn("pack", number(blocks)), "pack")
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    lists = streamed(held, sent, shards).mapInArrow(_tile(k), "query long, query_id long, uid long, vec_id long, score long, shard int")
    order = [F.col("score").desc(), F.col("vec_id"), F.col("uid")]
    groups = max(1, round(shards**0.5))
    near = Window.partitionBy("query", "group").orderBy(*order)
    merged = lists.withColumn("group", F.col("shard") % groups).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    far = Window.partitionBy("query").orderBy(*order)
    return merged.withColumn("rank", F.row_number().over(far)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
