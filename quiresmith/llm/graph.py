"""Connected components, inside a block and across a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.common import joined_hot
from quiresmith.session import discard, materialize


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (child, root) of the components that links (i, j) form over n positions."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (before == label).all():
            break
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _facts() -> tuple[Column, ...]:
    """What tells whether a round changed any link."""
    digest = F.xxhash64("lo", "hi")
    return F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("xor"), F.sum(F.shiftright(digest, 24)).alias("sum")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node in edges(a, b), longs.

    Large-star and small-star rounds (Kiveris et al., 2014): each hangs
    neighbours on the smallest one known, with a minimum per node that is
    combined before the shuffle; no node's neighbours meet in a list, and the
    links of a node with very many stay where they are. Rounds are cut by
    tables in the shared folder, of which the last is kept, and end when the
    links stand still, as they do after finitely many.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    links = materialize(links.distinct(), "links", *_facts())
    state, now = None, links.facts
    while now != state:
        # Large star: of a node's neighbours, the larger ones move to the smallest.
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined_hot(both.where("v > u"), least, "u", "n", 2 * now["n"]).select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo <> hi").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of these.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = joined_hot(large, least, "hi", "n", now["n"]).select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        small = moved.union(least.select(F.col("m").alias("lo"), "hi"))
        before, links = links, materialize(small.where("lo <> hi").distinct(), "links", *_facts())
        discard(before)
        state, now = now, links.facts
    roots = links.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.union(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
