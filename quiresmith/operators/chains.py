"""Counting and rising chains of sequences, a key at a time.

These carry state from one row to the next, so they are Arrow kernels; keys
are independent and spread over the cluster.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

def _walk_back(before: list[int], ends: list[tuple[int, int]]) -> list[int]:
    """Positions of the chain that ends best: the longest, then the smallest last value, then the first."""
    if not ends:
        return []
    at = max(range(len(ends)), key=lambda k: (ends[k][0], -ends[k][1]))
    chain = []
    while at >= 0:
        chain.append(at)
        at = before[at]
    return chain[::-1]


def counting_chain(values: Sequence[int]) -> list[int]:
    """Positions of the longest chain that counts up by one, in one pass.

    For each value the longest chain that ends in it so far is known, and
    where; the first to reach a length holds it.
    """
    best: dict[int, tuple[int, int]] = {}
    before, ends = [], []
    for k, v in enumerate(values):
        length, at = best.get(v - 1, (0, -1))
        before.append(at)
        ends.append((length + 1, v))
        if length + 1 > best.get(v, (0, -1))[0]:
            best[v] = (length + 1, k)
    return _walk_back(before, ends)


def rising_chain(values: Sequence[int]) -> list[int]:
    """Positions of the longest strictly rising chain, by a prefix-maximum tree over the distinct values."""
    levels = sorted(set(values))
    tree: list[tuple[int, int]] = [(0, 1)] * (len(levels) + 1)  # (length, -position): the first of the longest wins
    before, ends = [], []
    for k, v in enumerate(values):
        rank = bisect_left(levels, v)
        best, node = (0, 1), rank
        while node > 0:
            best = max(best, tree[node])
            node &= node - 1
        before.append(-best[1] if best[0] else -1)
        ends.append((best[0] + 1, v))
        node = rank + 1
        while node < len(tree):
            tree[node] = max(tree[node], (best[0] + 1, -k))
            node += node & -node
    return _walk_back(before, ends)


def chains(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, pick: Callable[[Sequence[int]], list[int]] = counting_chain) -> DataFrame:
    """keys, position (from 0) and value of each key's chain; ``order`` fixes the sequence.

    Keys are many and short, so a task takes its keys one after the other from
    sorted batches, instead of a call for each.
    """
    kinds = [df.schema[k] for k in keys]
    out = T.StructType([*kinds, T.StructField("position", T.IntegerType()), T.StructField("value", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        values: list[int] = []
        found: list[tuple] = []

        def close() -> None:
            found.extend((*key, at, values[at]) for at in pick(values))

        def table(types: list[pa.DataType]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * (len(keys) + 2)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*types, pa.int32(), pa.int64()])], [*keys, "position", "value"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            for now, v in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column(value).to_pylist()):
                if now != key:
                    if key is not None:
                        close()
                    key, values = now, []
                values.append(v)
            yield table(types)
            found.clear()
        if key is not None:
            close()
            yield table(types)

    rows = df.select(*dict.fromkeys([*keys, *order, value])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, out)
