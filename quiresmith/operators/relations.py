"""Joins, set comparison and deduplication between corpus tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.operators.columns import fresh

#: Fixed value: faults that do not spoil a document's pictures.
HARMLESS = ("shredded", "mixed-rotation")
#: Fixed value: faults that reading again may mend.
FIXABLE = ("pair-mismatch", "missing-part", "gap", "foreign-label", "no-questions", "no-output")
BROADCAST_ROWS = 100_000


def texts(values: Sequence[str]) -> Column:
    """Array literal of strings."""
    return F.array(*map(F.lit, values)).cast("array<string>")


def first_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    own = fresh(df, "_rank")
    return df.withColumn(own, rank).where(F.col(own) == 1).drop(own)


def last_by(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the last in ``order``."""
    return first_by(df, keys, *(F.col(c).desc() for c in order))


def without(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def only(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is in ``wanted``."""
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def without_copies(files: DataFrame, name: str = "name") -> DataFrame:
    """Files but the second downloads "<name> (n)" of a name that is there itself."""
    from quiresmith.functions.names import COPY

    plain = F.regexp_replace(name, COPY, "")
    kept = files.where(~F.col(name).rlike(COPY))
    copies = files.where(F.col(name).rlike(COPY)).withColumn("_plain", plain)
    lone = copies.join(kept.select(F.col(name).alias("_plain")), "_plain", "left_anti").drop("_plain")
    return kept.unionByName(lone)


def flagged(df: DataFrame, there: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Rows with ``flag``: whether no row of ``there`` has their key."""
    own = fresh(df, "_seen")
    seen = there.select(*keys).distinct().withColumn(own, F.lit(True))
    return df.join(seen, list(keys), "left").withColumn(flag, F.col(own).isNull()).drop(own)


def with_partner(rows: DataFrame, name: str = "name", prefix: str = "mate_") -> DataFrame:
    """Rows with the columns of the same document's other side, null where there is none."""
    from quiresmith.functions.names import partner

    mates = rows.select(*(F.col(c).alias(f"{prefix}{c}") for c in rows.columns))
    own = fresh(rows, "_mate")
    return rows.withColumn(own, partner(F.col(name))).join(mates, F.col(own) == F.col(f"{prefix}{name}"), "left").drop(own)


def at_positions(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], order: Sequence[str], position: str = "position") -> DataFrame:
    """Rows whose place in their key's order (from 0) is wanted."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn(position, place).join(wanted, [*keys, position])


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it is counted at ``rows`` or fewer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_interval(points: DataFrame, bounds: DataFrame, keys: Sequence[str], at: Column, start: Column, stop: Column, how: str = "inner") -> DataFrame:
    """Points in [start, stop) of their key's intervals; the key makes it an equi-join with a residual."""
    on = [points[k].eqNullSafe(bounds[k]) for k in keys]
    return points.join(bounds, [*on, at >= start, (at < stop) | stop.isNull()], how)


def overlapping(blocks: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks(y0, y1) with their key's window (top, foot) that they reach into."""
    joined = blocks.join(windows, list(keys))
    return joined.where((F.col("y1") > F.col("top")) & (F.col("y0") < F.col("foot")))


def near_pairs(points: DataFrame, keys: Sequence[str], at: str, tolerance: float, left: Sequence[str], right_prefix: str = "near_") -> DataFrame:
    """Pairs of a key's points at most ``tolerance`` apart: each is joined to its own and both neighbour buckets."""
    bucket = F.floor(F.col(at) / tolerance)
    a = points.select(*keys, *left, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    b = points.select(*keys, *(F.col(c).alias(f"{right_prefix}{c}") for c in left), bucket.alias("_bucket"))
    return a.join(b, [*keys, "_bucket"]).where(F.abs(F.col(at) - F.col(f"{right_prefix}{at}")) <= tolerance).drop("_bucket")


def as_of(marks: DataFrame, rows: DataFrame, keys: Sequence[str], mark_at: str, row_at: str, reach: int, priority: Sequence[Column], mark_keys: Sequence[str]) -> DataFrame:
    """Each mark with the best of its key's rows less than ``reach`` above it.

    The first condition of ``priority`` that any row meets wins, and among
    its rows the nearest; marks without such a row have nulls.
    """
    rank = None
    for k, condition in enumerate(priority):
        rank = F.when(condition, k) if rank is None else rank.when(condition, k)
    ranked = rows.withColumn("_rank", rank).where("_rank is not null")
    band = (F.col(row_at) < F.col(mark_at)) & (F.col(row_at) > F.col(mark_at) - reach)
    on = [marks[k].eqNullSafe(ranked[k]) for k in keys]
    found = marks.join(ranked, [*on, band]).select(*(marks[c] for c in mark_keys), F.struct("_rank", (-F.col(row_at)).alias("_back")).alias("_order"))
    best = found.groupBy(*mark_keys).agg(F.min("_order").alias("_best"))
    best = best.select(*mark_keys, F.col("_best._rank").alias("priority"), (-F.col("_best._back")).alias("found_at"))
    return marks.join(best, list(mark_keys), "left")


def fault_gate(faults: Column, harmless: Sequence[str] = HARMLESS) -> Column:
    """Whether any fault is left beyond the harmless ones."""
    return F.size(F.array_except(faults, texts(harmless))) > 0


def fixable(faults: Column, harmless: Sequence[str] = HARMLESS) -> Column:
    """Whether a fault is left that reading again may mend."""
    return F.arrays_overlap(F.array_except(faults, texts(harmless)), texts(FIXABLE))


def with_fault(faults: Column, fault: str, when: Column) -> Column:
    """Faults with one more where ``when`` holds: sorted, each once."""
    more = F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(fault))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.coalesce(faults, F.array().cast("array<string>")), more))


def set_change(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Keys of either side with what became of them: kept, new or gone."""
    both = before.select(*keys).distinct().withColumn("_b", F.lit(True)).join(after.select(*keys).distinct().withColumn("_a", F.lit(True)), list(keys), "full")
    change = F.when(F.col("_a") & F.col("_b"), "kept").when(F.col("_a"), "new").otherwise("gone")
    return both.select(*keys, change.alias("change"))


def union_of(*parts: DataFrame) -> DataFrame:
    """Distinct rows of all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, order and repeats aside."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def header_columns(cells: DataFrame, aliases: dict[str, Sequence[str]], rows: int = 15, columns: int = 40, required: Sequence[str] = ("subject", "q_filename")) -> DataFrame:
    """sheet, row, field, col of the best header row of cells(sheet, row, col, value).

    Of the first rows, that with the most known headings wins, the first of
    equals; the first column of a field counts; the required fields must be there.
    """
    from quiresmith.functions.strings import heading_key

    spark = cells.sparkSession
    known = spark.createDataFrame([(f, a) for f, names in aliases.items() for a in names], "field string, _key string")
    near = cells.where((F.col("row") <= rows) & (F.col("col") <= columns)).withColumn("_key", heading_key(F.col("value")))
    hits = near.join(F.broadcast(known), "_key").groupBy("sheet", "row", "field").agg(F.min("col").alias("col"))
    scored = hits.groupBy("sheet", "row").agg(F.count(F.lit(1)).alias("n"), F.collect_set("field").alias("fields"))
    scored = scored.where(F.size(F.array_except(texts(required), F.col("fields"))) == 0)
    best = first_by(scored, ["sheet"], F.col("n").desc(), F.col("row"))
    return hits.join(best.select("sheet", "row"), ["sheet", "row"])
