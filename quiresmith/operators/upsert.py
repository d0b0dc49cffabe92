"""Keyed upserts and state changes: tables in, the new table out; writing is the caller's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, staged: DataFrame, key: str, columns: Sequence[str], blanks_overwrite: bool) -> DataFrame:
    """``table`` with ``staged`` merged in by key, one row per key, sorted.

    A staged value takes the place of the old one; a blank one does so only
    if blanks overwrite. Of staged rows with one key the last by ``seq`` holds.
    """
    from quiresmith.operators.relations import last_by

    new = last_by(staged, [key], "seq").select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = table.join(new, F.col(key) == F.col("_key"), "full")

    def value(c: str) -> Column:
        fresh, old = F.col(f"_{c}"), F.col(c)
        empty = fresh.isNull() | (F.trim(fresh.cast("string")) == "")
        take = F.col("_key").isNotNull() if blanks_overwrite else F.col("_key").isNotNull() & ~empty
        return F.when(take, fresh).otherwise(old).alias(c)

    return joined.select(F.coalesce(F.col(key), F.col("_key")).alias(key), *(value(c) for c in columns if c != key)).orderBy(key)


def upsert_rows_csv(table: DataFrame, staged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The catalogue file's upsert: by exact stem, and blanks overwrite."""
    return upsert(table, staged, "stem", columns, blanks_overwrite=True)


def upsert_sheet(table: DataFrame, staged: DataFrame, columns: Sequence[str], files: Sequence[str] = ("q_filename", "ms_filename")) -> DataFrame:
    """The sheet's upsert: by stem of either file name, whatever its case, and blanks never overwrite."""
    from quiresmith.functions.strings import picture_stem

    def keyed(df: DataFrame) -> DataFrame:
        named = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.lower(picture_stem(F.col(c)))) for c in files]
        return df.withColumn("_stem", F.coalesce(*named))

    return upsert(keyed(table), keyed(staged), "_stem", columns, blanks_overwrite=False).drop("_stem")


def moved(rows: DataFrame, plan: DataFrame, key: str = "file", state: str = "state") -> DataFrame:
    """Rows(file, state) with the states that plan(file, state) gives them; files that the plan marks gone (null) leave."""
    new = plan.select(F.col(key), F.col(state).alias("_to"), F.lit(True).alias("_planned"))
    joined = rows.join(new, key, "left").where(F.col("_planned").isNull() | F.col("_to").isNotNull())
    return joined.withColumn(state, F.coalesce("_to", state)).drop("_to", "_planned")


def manifest(rows: DataFrame, title: str, line: Column, order: Sequence[str]) -> DataFrame:
    """value: a title with the count, an empty line, then a line per row, in order; for a text sink."""
    lines = rows.select(F.lit(1).alias("_p"), line.alias("value"), *order)
    head = rows.agg(F.concat(F.lit(f"{title}: "), F.count(F.lit(1)).cast("string")).alias("value"))
    head = head.select(F.explode(F.array("value", F.lit(""))).alias("value")).withColumn("_p", F.lit(0))
    return head.unionByName(lines, allowMissingColumns=True).orderBy("_p", *order).select("value")
