"""Ordered work on groups of any length: selection by rank, percentiles and running sums.

A window or a list over a group is one task's work, which is right for groups
that are bounded. Here groups are counted first, and only those of up to
``LONG`` rows go that way. In longer ones a rank is found by narrowing a
bracket of values, counted exactly each time; and running sums are taken in
two levels, within ranges of the order and over the ranges' sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.operators.columns import fresh
from quiresmith.session import discard, materialize

#: Rows of a group that a single buffer or window may hold; points of the sketch that brackets are taken from, and its accuracy; rows of a table that may be broadcast.
LONG, GRID, ACCURACY, SMALL = 1 << 18, 256, 10_000, 10_000
#: Ranges that a table may be cut in however few rows they have.
FEW = 64


def _key(keys: Sequence[str]) -> Column:
    """A group's key as one value, in which nulls are equal."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def _split(df: DataFrame, key: str, counted: Column, long: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of short groups; and those of long ones, and a table of these groups with n, their rows, or None where there are none.

    A table of at most ``long`` rows is not counted by group. There are fewer long groups than rows by the factor ``long``.
    """
    if df.count() <= long:
        return df, None, None
    sizes = df.groupBy(key).agg(F.count(counted).alias("n")).where(F.col("n") > long)
    sizes = materialize(sizes, "long-groups", F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    if not sizes.facts["groups"]:
        discard(sizes)
        return df, None, None
    named = _small(sizes.select(key), sizes.facts["groups"])
    return df.join(named, key, "left_anti"), df.join(named, key, "left_semi"), sizes


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A counted table, broadcast if it is small."""
    return F.broadcast(table) if rows <= SMALL else table


def _narrowed(rows: DataFrame, sizes: DataFrame, ranks: dict[str, Callable[[Column], Column]], long: int) -> DataFrame:
    """key, n and the value at each rank of the long groups of rows(key, v).

    Each rank has a bracket [low, high] of values, with exact numbers of those
    below and within. A sketch of the values within gives a narrower bracket
    and a pivot; counting again tells on which side of the pivot the rank
    lies. So a round leaves a small share of the values, and at least one
    value less; it ends where one value is left, or ``long`` rows are.
    """
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()))).alias("x")
    ends = rows.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    state = sizes.join(ends, "key").select("key", "n", asked, "low", "high").select("key", "n", "x.name", "x.rank", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("within"))
    wide = (F.col("within") > long) & (F.col("low") < F.col("high"))
    known = F.count(F.lit(1)).alias("asks"), F.count_if(wide).alias("wide")
    state = materialize(state.where("rank >= 0 and rank < n"), "ranks", *known)
    while state.facts["wide"]:
        left = _small(state.where(wide).select("key", "name", "low", "high"), state.facts["wide"])
        near = rows.join(left, "key").where("v between low and high")
        grid = [k / GRID for k in range(GRID + 1)]
        sketch = near.groupBy("key", "name").agg(F.percentile_approx("v", grid, ACCURACY).alias("grid"))
        at = (F.col("rank") - F.col("below")) / (F.col("within") - 1) * GRID
        pick = lambda place: F.get("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), place)).cast("int"))
        cuts = state.where(wide).join(sketch, ["key", "name"]).select("key", "name", pick(F.floor(at) - 2).alias("a"), pick(F.round(at)).alias("m"), pick(F.ceil(at) + 2).alias("b"))
        counted = near.join(_small(cuts, state.facts["wide"]), ["key", "name"]).groupBy("key", "name").agg(
            *(F.first(c).alias(c) for c in "amb"),
            F.count_if(F.col("v") < F.col("a")).alias("lt_a"), F.count_if(F.col("v") <= F.col("b")).alias("le_b"), F.count_if(F.col("v") < F.col("m")).alias("lt_m"), F.count_if(F.col("v") <= F.col("m")).alias("le_m"),
            F.max(F.when(F.col("v") < F.col("m"), F.col("v"))).alias("before"), F.min(F.when(F.col("v") > F.col("m"), F.col("v"))).alias("after"),
        )
        place = F.col("rank") - F.col("below")
        lower, upper = place < F.col("lt_m"), place >= F.col("le_m")
        # The sketch's ends hold unless its error was larger than it should be; then the old ones do.
        from_a, to_b = lower & (F.col("lt_a") <= place) & (F.col("a") <= F.col("before")), upper & (F.col("le_b") > place) & (F.col("b") >= F.col("after"))
        passed = F.when(from_a, F.col("lt_a")).when(lower, 0).when(upper, F.col("le_m")).otherwise(F.col("lt_m"))
        ends = F.when(lower, F.col("lt_m")).when(to_b, F.col("le_b")).when(upper, F.col("within")).otherwise(F.col("le_m"))
        done = F.col("m").isNull()
        new = state.join(counted, ["key", "name"], "left").select(
            "key", "n", "name", "rank",
            F.when(done, F.col("low")).when(from_a, F.col("a")).when(lower, F.col("low")).when(upper, F.col("after")).otherwise(F.col("m")).alias("low"),
            F.when(done, F.col("high")).when(lower, F.col("before")).when(to_b, F.col("b")).when(upper, F.col("high")).otherwise(F.col("m")).alias("high"),
            F.when(done, F.col("below")).otherwise(F.col("below") + passed).alias("below"),
            F.when(done, F.col("within")).otherwise(ends - passed).alias("within"),
        )
        new = materialize(new, "ranks", *known)
        discard(state)
        state = new
    asks = state.facts["asks"]
    few = _small(state.where("low < high").select("key", "name", "rank", "low", "high", "below"), asks)
    listed = rows.join(few, "key").where("v between low and high").groupBy("key", "name").agg(F.get(F.array_sort(F.collect_list("v")), F.first(F.col("rank") - F.col("below")).cast("int")).alias("v"))
    found = state.join(listed, ["key", "name"], "left").withColumn("v", F.coalesce("v", "low"))
    wide_rows = sizes.join(found.groupBy("key").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks)), "key", "left")
    return wide_rows.select("key", "n", *ranks)


def kth_values(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], long: int = LONG) -> DataFrame:
    """keys and, for each name of ``ranks``, the value at that rank: a whole number from 0, given by a function of the group's size.

    Nulls do not count; a group without values and a rank outside the group
    give null; values are numbers, dates or times. Exact for groups of any
    length: nothing that is held grows with a group beyond ``long`` values.
    """
    rows = df.select(_key(keys).alias("key"), F.col(value).alias("v"))
    short, rest, sizes = _split(rows, "key", F.col("v"), long)
    lists = short.groupBy("key").agg(F.array_sort(F.collect_list("v")).alias("v")).withColumn("n", F.size("v").cast("long"))
    out = lists.select("key", *(F.when((rank(F.col("n")) >= 0) & (rank(F.col("n")) < F.col("n")), F.get("v", rank(F.col("n")).cast("int"))).alias(name) for name, rank in ranks.items()))
    if rest is not None:
        out = out.unionByName(_narrowed(rest.where("v is not null"), sizes, ranks, long).drop("n"))
    return out.select(*(F.col("key")[k].alias(k) for k in keys), *ranks)


def upper_median(df: DataFrame, keys: Sequence[str], value: str, out: str, long: int = LONG) -> DataFrame:
    """keys, ``out``: the middle of each group's values, the upper one of two."""
    return kth_values(df, keys, value, {out: lambda n: F.floor(n / 2)}, long)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], long: int = LONG) -> DataFrame:
    """keys and interpolated percentiles, by name; as ``kth_values`` for nulls and lengths."""
    rows = df.select(_key(keys).alias("key"), F.col(value).alias("v"))
    short, rest, sizes = _split(rows, "key", F.col("v"), long)
    out = short.groupBy("key").agg(*(F.percentile("v", F.lit(p)).alias(name) for name, p in shares.items()))
    if rest is not None:
        near: dict[str, Callable[[Column], Column]] = {}
        for name, p in shares.items():
            near[f"{name} lower"] = lambda n, p=p: F.floor((n - 1) * p)
            near[f"{name} upper"] = lambda n, p=p: F.ceil((n - 1) * p)
        found = _narrowed(rest.where("v is not null"), sizes, near, long)

        def between(name: str, p: float) -> Column:
            at, low, high = (F.col("n") - 1) * F.lit(p), F.col(f"`{name} lower`"), F.col(f"`{name} upper`")
            return F.when(low == high, low.cast("double")).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

        out = out.unionByName(found.select("key", *(between(name, p).alias(name) for name, p in shares.items())))
    return out.select(*(F.col("key")[k].alias(k) for k in keys), *shares)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str, before: bool = False, long: int = LONG) -> DataFrame:
    """Rows with ``out``: the sum of ``value`` over the rows of their group up to and with them, or ``before`` them (0 for the first).

    A long group is cut into ranges of the order, each a task's worth: sums
    within a range are a window's, and those of the ranges before are added.
    Rows that tie in the order come in any order, as in a window. Nulls of
    ``value`` add nothing.
    """
    key, own, part, row, start = (fresh(df, x) for x in ("key_", "value_", "range_", "row_", "start_"))
    rows = df.withColumns({key: _key(keys), own: value})
    short, rest, sizes = _split(rows, key, F.lit(1), long)
    frame = (Window.unboundedPreceding, -1) if before else (Window.unboundedPreceding, 0)

    def summed(table: DataFrame, by: list[str], then: list[str | Column]) -> Column:
        return F.coalesce(F.sum(own).over(Window.partitionBy(*by).orderBy(*then).rowsBetween(*frame)), F.lit(0))

    result = short.withColumn(out, summed(short, [key], list(order)))
    if rest is not None:
        total = sizes.facts["rows"]
        # A window sorts on disk, so a range may hold LONG rows: cutting one for every few rows would send samples of them all to the driver.
        ranges = max(2, min(-(-total // long), max(FEW, -(-total // LONG))))
        ordered = rest.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(ranges, key, *order, row).withColumn(part, F.spark_partition_id())
        ordered = materialize(ordered, "ranges")
        sums = ordered.groupBy(key, part).agg(F.sum(own).alias(start))
        starts = sums.withColumn(start, F.coalesce(F.sum(start).over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        starts = _small(starts, ranges + sizes.facts["groups"])
        local = ordered.withColumn(out, summed(ordered, [key, part], [*order, row])).join(starts, [key, part])
        result = result.unionByName(local.withColumn(out, F.col(out) + F.col(start)).drop(start, part, row))
    return result.drop(key, own)


def running_offset(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], size: str, gap: int, out: str = "offset", long: int = LONG) -> DataFrame:
    """Rows with where they start when stacked with a gap between them, in groups of any length."""
    return running_sum(df, keys, order, F.col(size) + gap, out, before=True, long=long)


def remap(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: str, out: str = "new_at", long: int = LONG) -> DataFrame:
    """Rows with their place among the kept ones; dropped rows take that of the kept row before, 0 at least. Groups may have any length."""
    placed = running_sum(df, keys, order, F.col(keep).cast("long"), out, long=long)
    return placed.withColumn(out, F.greatest(F.col(out) - 1, F.lit(0)))
