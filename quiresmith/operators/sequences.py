"""Ordered operators over windows: runs, offsets, neighbours, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions.numbers import half_even
from quiresmith.operators.columns import fresh


def is_complete(numbers: Column) -> Column:
    """Whether sorted numbers are exactly 1 to n; an empty array is."""
    n = F.size(numbers)
    return F.when(n > 0, F.array_sort(numbers) == F.sequence(F.lit(1), n)).otherwise(n == 0)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Rows with ``run``, the number of their run of equal ``flag`` within the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    start = ~F.col(flag).eqNullSafe(F.lag(flag).over(w)) | (F.row_number().over(w) == 1)
    own = fresh(df, "_start")
    return df.withColumn(own, start.cast("int")).withColumn("run", F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(own)


def bands(df: DataFrame, keys: Sequence[str], at: str, flag: str) -> DataFrame:
    """keys, start, end (inclusive), rows of the runs where ``flag`` is true; ``at`` must count up by one."""
    on = df.where(F.col(flag)).withColumn("_island", F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at)))
    return on.groupBy(*keys, "_island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("rows")).drop("_island")


def keep_in_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], blank: str, max_gap: int) -> DataFrame:
    """Rows with ``keep``: false inside blank runs longer than ``max_gap``, but for half of it at the head and the rest at the tail."""
    marked = runs(df, keys, order, blank)
    run = Window.partitionBy(*keys, "run")
    at, n = F.row_number().over(run.orderBy(*order)), F.count(F.lit(1)).over(run)
    head = max_gap // 2
    inside = F.col(blank) & (n > max_gap) & (at > head) & (at <= n - (max_gap - head))
    return marked.withColumn("keep", ~F.coalesce(inside, F.lit(False))).drop("run")


def dilate(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, by: int, out: str) -> DataFrame:
    """Rows with ``out``: whether a row at most ``by`` places off has the flag."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-by, by)
    return df.withColumn(out, F.max(F.col(flag).cast("int")).over(frame) == 1)


def running_offset(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, gap: int, out: str = "offset") -> DataFrame:
    """Rows with where they start when stacked with a gap between them."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(F.col(size) + gap).over(before), F.lit(0)))


def remap(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str, out: str = "new_at") -> DataFrame:
    """Rows with their place among the kept ones; dropped rows take that of the kept row before, 0 at least."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.greatest(F.sum(F.col(keep).cast("int")).over(so_far) - 1, F.lit(0)))


def until_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, out: str = "stop", last: Column | None = None) -> DataFrame:
    """Rows with the start of the next one of their key; the last has ``last``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.coalesce(F.lead(start).over(w), last if last is not None else F.lit(None)))


def first_places(df: DataFrame, keys: Sequence[str], x: str, number: str, tolerance: float, order: Sequence[str]) -> DataFrame:
    """The first row in reading order of each number in each column bucket."""
    slot = half_even(F.col(x) / max(1.0, tolerance))
    rank = F.row_number().over(Window.partitionBy(*keys, slot, number).orderBy(*order))
    own = fresh(df, "_rank")
    return df.withColumn(own, rank).where(F.col(own) == 1).drop(own)


def opens_line(spans: DataFrame, keys: Sequence[str] = ("doc", "page"), reach: int = 5, **among: Column) -> DataFrame:
    """Spans(left, y) with ``opens``: whether nothing stands left of them within ``reach`` points of height; each of ``among`` says it for the spans that meet it, among themselves."""
    line = fresh(spans, "_line")
    near = Window.partitionBy(*keys).orderBy(line).rangeBetween(-reach, reach)
    lined = spans.withColumn(line, half_even(F.col("y")).cast("long"))
    some = {name: meets & (F.col("left") <= F.min(F.when(meets, F.col("left"))).over(near) + 0.5) for name, meets in among.items()}
    return lined.withColumns({"opens": F.col("left") <= F.min("left").over(near) + 0.5} | some).drop(line)


def opens_coarse_line(spans: DataFrame, keys: Sequence[str] = ("doc", "page"), step: float = 3.0) -> DataFrame:
    """Spans with ``opens``: whether nothing stands left of them in their line bucket."""
    bucket = half_even(F.col("y") / step)
    return spans.withColumn("opens", F.col("left") <= F.min("left").over(Window.partitionBy(*keys, bucket)) + 0.5)


def like_neighbours(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ink: str, first: int = 3, last: int = 15) -> DataFrame:
    """Rows with ``like_inward``: whether their ink is above 0.6 of the upper quartile of inked rows further in."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, last)
    near = F.percentile(F.when(F.col(ink) > 0, F.col(ink)), F.lit(0.75)).over(frame)
    return rows.withColumn("like_inward", F.coalesce(F.col(ink) > 0.6 * near, F.lit(False)))


def longest_true(flags: Column) -> Column:
    """Length of the longest run of true in an array."""
    step = F.aggregate(
        flags,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, f: F.struct(F.when(f, acc["now"] + 1).otherwise(0).alias("now"), F.greatest(acc["best"], F.when(f, acc["now"] + 1).otherwise(0)).alias("best")),
    )
    return step["best"]


def next_free(df: DataFrame, taken: DataFrame, name: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows with ``free``: their name, or with the first suffix -2, -3, ... beyond those taken; rows of one name in ``order``."""
    # A taken name "x-3" counts for the name "x".
    own, base_of, used_of = (fresh(df, x) for x in ("_k", "_base", "_used"))
    base = F.regexp_replace(name, r"-[0-9]+$", "")
    suffix = F.regexp_extract(name, r"-([0-9]+)$", 1).try_cast("int")
    used = taken.select(base.alias(base_of), F.coalesce(suffix, F.lit(1)).alias("n")).unionByName(taken.select(F.col(name).alias(base_of), F.lit(1).alias("n")))
    used = used.distinct().groupBy(base_of).agg(F.array_sort(F.collect_set("n")).alias(used_of))
    rank = F.row_number().over(Window.partitionBy(name).orderBy(*(order or [name])))
    joined = df.withColumn(own, rank).join(used, F.col(name) == F.col(base_of), "left")
    numbers = F.coalesce(used_of, F.array().cast("array<int>"))
    open_ = F.array_except(F.sequence(F.lit(1), F.size(numbers) + F.col(own) + 1), numbers)
    n = F.element_at(open_, F.col(own))
    return joined.withColumn("free", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n))).drop(own, base_of, used_of)


def trimmed_tail(pages: DataFrame, is_end: str, marked: str, keys: Sequence[str] = ("doc",)) -> DataFrame:
    """keys, last_page (exclusive): without the run of end pages at the foot, but past the last marked page and never before page 1."""
    onward = Window.partitionBy(*keys).orderBy("page").rowsBetween(0, Window.unboundedFollowing)
    tail = pages.withColumn("_tail", F.min(F.col(is_end).cast("int")).over(onward) == 1)
    body = F.coalesce(F.max(F.when(~F.col("_tail"), F.col("page") + 1)), F.lit(1))
    last_mark = F.coalesce(F.max(F.when(F.col(marked), F.col("page") + 1)), F.lit(0))
    return tail.groupBy(*keys).agg(F.greatest(body, last_mark, F.lit(1)).alias("last_page"))
