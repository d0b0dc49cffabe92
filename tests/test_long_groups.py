"""Ranks, percentiles and running sums of groups that no task holds, against plain Python and windows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiresmith.operators import long_groups, sequences


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(6)
    return {
        "spread": [rng.gauss(0, 1e3) for _ in range(3000)],
        "tails": [10 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(2001)],
        "two": [1.0] * 1500 + [2.0] * 1500,
        "one": [7.5] * 1200,
        "steps": [float(rng.randrange(5)) for _ in range(2500)],
        "short": [3.0, 1.0, 2.0, 2.0],
        "single": [4.0],
        "edge": [float(k) for k in range(101)],
    }


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(g, "x", v, k) for g, vs in groups.items() for k, v in enumerate(vs)]
    rows += [("spread", "x", None, -1), ("nulls", "x", None, 0), (None, "x", 5.0, 0), (None, "x", 6.0, 1), (None, None, 1.0, 2)]
    rows += [(None, "long", float(k % 400), k) for k in range(900)]
    return spark.createDataFrame(rows, "g string, h string, v double, n int").repartition(6, "n")


RANKS = {"least": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "third": lambda n: F.lit(2), "most": lambda n: n - 1, "beyond": lambda n: n, "p98": lambda n: F.floor((n - 1) * 0.98)}


@pytest.mark.parametrize("long", [100, 1 << 18])
def test_ranks(table, groups, long):
    got = {(r["g"], r["h"]): r for r in long_groups.kth_values(table, ["g", "h"], "v", RANKS, long).collect()}
    want = {(g, "x"): sorted(v) for g, v in groups.items()} | {("nulls", "x"): [], (None, "x"): [5.0, 6.0], (None, None): [1.0], (None, "long"): sorted(float(k % 400) for k in range(900))}
    assert set(got) == set(want)
    for key, values in want.items():
        at = {"least": 0, "middle": len(values) // 2, "third": 2, "most": len(values) - 1, "beyond": len(values), "p98": int((len(values) - 1) * 0.98)}
        for name, k in at.items():
            assert got[key][name] == (values[k] if 0 <= k < len(values) else None), (key, name)


@pytest.mark.parametrize("long", [100, 1 << 18])
def test_percentiles_and_medians(table, groups, long):
    got = {(r["g"], r["h"]): r for r in long_groups.percentiles(table, ["g", "h"], "v", {"p5": 0.05, "p50": 0.5, "p98": 0.98}, long).collect()}
    for g, values in groups.items():
        for name, p in (("p5", 0.05), ("p50", 0.5), ("p98", 0.98)):
            assert got[g, "x"][name] == pytest.approx(float(np.percentile(values, 100 * p)), rel=1e-12), (g, name)
    assert got["nulls", "x"]["p5"] is None
    medians = {r["h"]: r["m"] for r in long_groups.upper_median(table, ["h"], "v", "m", long).collect()}
    every = sorted(v for vs in groups.values() for v in vs)
    every = sorted([*every, 5.0, 6.0])
    assert medians["x"] == every[len(every) // 2]
    whole = long_groups.kth_values(table, [], "v", {"most": lambda n: n - 1}, long).collect()
    assert [tuple(r) for r in whole] == [(max(max(v) for v in groups.values()),)]
    assert long_groups.percentiles(table.where("false"), ["g"], "v", {"p": 0.5}, long).count() == 0


def test_a_rank_between_two_heavy_values_is_found(spark):
    df = spark.range(40_000).select(F.lit("a").alias("g"), F.when(F.col("id") < 20_000, 1.0).otherwise(2.0).alias("v"))
    got = long_groups.kth_values(df, ["g"], "v", {"last": lambda n: F.lit(19_999), "first": lambda n: F.lit(20_000)}, 50).first()
    assert (got["last"], got["first"]) == (1.0, 2.0)


@pytest.mark.parametrize("long", [100, 1 << 18])
def test_running_sums(table, long):
    marked = table.withColumns({"size": F.col("n").cast("long") * 3 + 1, "keep": F.col("n") % 3 != 0, "range_": F.lit(9), "start_": F.lit("own")})
    order = ["n", F.col("v").desc()]
    for keys in (["g", "h"], ["h"], []):
        new = long_groups.running_offset(marked, keys, [*order, "g"], "size", 10, long=long)
        old = sequences.running_offset(marked, keys, [*order, "g"], "size", 10)
        assert new.columns == old.columns
        assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
    new, old = long_groups.remap(marked, ["g", "h"], order, "keep", long=long), sequences.remap(marked, ["g", "h"], order, "keep")
    assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
    assert long_groups.remap(marked.where("false"), ["g"], order, "keep", long=long).count() == 0


def test_long_groups_use_all_tasks(spark):
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.lit(1).alias("at"), F.lit(5).cast("long").alias("size"))  # all tie
    out = long_groups.running_sum(df, ["g"], ["at"], F.col("size"), "s", long=2000)
    assert [tuple(r) for r in out.groupBy("g").agg(F.min("s"), F.max("s"), F.count_distinct("s")).orderBy("g").collect()] == [(0, 5, 100_000, 20_000), (1, 5, 100_000, 20_000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "range_" in plan
