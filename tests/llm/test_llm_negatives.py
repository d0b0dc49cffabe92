"""Hard negatives and exact search against brute force, with repeats, ties, nulls and many shards."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiresmith.llm import negatives, topk

KIND = "vec_id long, embedding array<float>, label int, uid string, mat int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [[k, (rng.standard_normal(6) * 0.3 + (k % 4 == 0)).astype("f4").tolist(), k % 3] for k in range(300)]
    for k in range(300, 420):  # near and exact copies
        out.append([k, out[k % 40][1] if k % 2 else [x * 1.01 for x in out[k % 40][1]], k % 3])
    out += [[500 + k, [0.5] * 6, 0] for k in range(150)]  # a hot vector
    out += [[100, [0.4] * 6, 1], [100, [0.4] * 6, 1], [100, [0.2] * 6, 2], [0, out[0][1], 0]]  # repeated ids
    out += [[800, None, 1], [801, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1], [802, [float("nan")] * 6, 0], [803, [float("inf")] * 6, 0], [804, [0.3] * 6, None], [None, [0.3] * 6, 1]]
    out += [[850 + k, [0.2 * k, 1.0], k % 2] for k in range(12)] + [[900, [], 0], [901, [], 1], [902, [], 0]]  # other dimensions
    return out


def floored(rows, scale):
    keep = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(k, r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]], r[2]) for k, r in enumerate(keep)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute(rows, every, positives=5, n=3):
    v = [r for r in floored(rows, 256) if r[3] is not None]
    want = Counter()
    for uid, vid, a, label in v:
        if vid % every:
            continue
        scored = sorted((-dot(a, x[2]), x[1], x[0], x[3]) for x in v if x[0] != uid and len(x[2]) == len(a))
        for s, pid, _, _ in [x for x in scored if x[3] == label][:positives]:
            hits = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:n]
            for rank, x in enumerate(hits, 1):
                want[vid, pid, rank, x[1], -s, -x[0]] += 1
    return want


@pytest.mark.parametrize("small", [True, False])
def test_hard_negatives(spark, rows, monkeypatch, small):
    if small:
        for name, size in (("SHARD_ROWS", 60), ("LIST_ROWS", 16), ("LABEL_ROWS", 4), ("ANCHOR_ROWS", 7), ("SAMPLE_ROWS", 100)):
            monkeypatch.setattr(negatives, name, size)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    got = Counter(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0).collect())
    want = brute(rows, 10)
    assert got == want and len(want) > 100
    assert negatives.mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(df, F.col("vec_id") < 0).count() == 0


def test_window_of_large_and_negative_scores(spark):
    big = float(1 << 21)
    df = spark.createDataFrame([(0, [big], 0), (1, [big], 0), (2, [big * 0.75], 1), (3, [big * 0.96], 1), (4, [-1.0], 0), (5, [-1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {tuple(r)[:4] for r in negatives.mine(df, F.col("vec_id").isin(0, 4)).collect()}
    assert got == {(0, 1, 1, 2)}  # 3 is above 95 percent; 4's positives score below zero


def test_bounds_and_visits():
    rng = np.random.default_rng(8)
    points = rng.standard_normal((500, 8)) * 50
    centres = negatives.fit_centroids(points, 12)
    place, distance = negatives.nearest(points, centres)
    near = ((points[:, None] - centres) ** 2).sum(2)
    assert np.array_equal(place, near.argmin(1)) and np.allclose(distance**2, near.min(1))
    radius = np.array([distance[place == c].max(initial=0) for c in range(12)])
    a = rng.standard_normal((5, 8)) * 50
    least, most = negatives.bounds(a, centres, radius)
    scores = a @ points.T
    assert all((scores[:, place == c] <= most[:, [c]]).all() and (scores[:, place == c] >= least[:, [c]]).all() for c in range(12))
    seen = []

    def score(at, rows):
        seen.append(at)
        return np.array([[10 - at]] * len(rows), np.int64)

    one = [np.array([7])] * 4
    i, s, _, _ = negatives._search(np.array([[10.0, 9.0, 8.0, -np.inf]]), 1, score, one, one, np.array([np.iinfo(np.int64).min]))
    assert (i.tolist(), s.tolist(), seen) == ([0], [10], [0])  # bounds strictly below the first score are not visited


def test_repeated_ids_in_exact_search(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.9, 0.1]), (1, [0.8, 0.0]), (2, [0.1, 0.7])], "vec_id long, embedding array<float>")
    got = Counter((r["query_id"], r["vec_id"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == Counter({(100, 100): 2, (100, 1): 2, (100, 2): 2})


def test_equal_rows_are_spread_over_packs(spark):
    same = spark.range(100_000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"))
    got = topk.top_k(same, F.col("vec_id") == 500, k=3, pack_rows=4096)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(500, k + 1, k, 512 * 512 + 256 * 256) for k in range(3)]
    sizes = [r["count"] for r in same.select(F.pmod(F.xxhash64("vec_id"), F.lit(25)).alias("pack")).groupBy("pack").count().collect()]
    assert max(sizes) < 2 * 100_000 / 25


def test_exact_search_with_few_rows_a_pack(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    v = floored(rows, 1024)
    want = Counter()
    for uid, vid, a, _ in v:
        if vid % 100 == 0:
            best = sorted((-dot(a, x[2]), x[1], x[0]) for x in v if x[0] != uid and len(x[2]) == len(a))[:10]
            want.update((vid, rank, x[1], -x[0]) for rank, x in enumerate(best, 1))
    for packs in (1, 3):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, pack_rows=50, shard_packs=packs, block_rows=3)
        assert Counter(tuple(r) for r in got.collect()) == want
