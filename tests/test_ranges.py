"""Tables in ranges: what a change writes, versions, two writers, and operators that keep every column of their input."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quiresmith.operators import aggregates, raster, relations, sequences
from quiresmith.operators.upsert import upsert
from quiresmith.sources import ranges

KIND = "key string, name string, mark string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_ranges_that_are_touched_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = spark.createDataFrame([(f"{k:04d}", f"n{k}", "m") for k in range(1000)] + [(None, "none", "m")], KIND)
    assert ranges.create(table, path, "key", 100) == 0
    first = ranges.ranges(spark, path)
    assert rows_of(ranges.read(spark, path)) == rows_of(table) and 8 <= len(first) <= 12 and sum(r.rows for r in first) == 1001
    assert max(r.rows for r in first) <= 200 and [r.first for r in first] == [None, *sorted(r.first for r in first[1:])]
    staged = spark.createDataFrame([("0333", "new", "", 1), ("0333", "newer", " ", 2), ("0334", "", "x", 1), ("0335x", "more", "y", 1)], KIND + ", seq int")
    assert ranges.upsert_into(staged, path, ["name", "mark"], False, 100) == 1
    second = ranges.ranges(spark, path)
    changed = {r.folder for r in second} - {r.folder for r in first}
    assert 1 <= len(changed) <= 2 and len({r.folder for r in first} & {r.folder for r in second}) >= len(first) - 2
    assert rows_of(ranges.read(spark, path)) == rows_of(upsert(table, staged, "key", ["name", "mark"], False).select("key", "name", "mark"))
    assert rows_of(ranges.read(spark, path, 0)) == rows_of(table)
    assert ranges.upsert_into(staged.where("false"), path, ["name", "mark"], True) == 1
    # A range that grows is cut; its keys are found again.
    many = spark.createDataFrame([(f"0500-{k:03d}", "x", "y", 1) for k in range(500)], KIND + ", seq int")
    ranges.upsert_into(many, path, ["name", "mark"], True, 100)
    third = ranges.ranges(spark, path)
    assert len(third) > len(second) + 2 and sum(r.rows for r in third) == 1502 and max(r.rows for r in third) <= 250
    again = spark.createDataFrame([("0500-250", "hit", "", 1), ("9999", "last", "", 1), ("", "start", "", 1)], KIND + ", seq int")
    ranges.upsert_into(again, path, ["name", "mark"], True, 100)
    found = {r["key"]: (r["name"], r["mark"]) for r in ranges.read(spark, path).collect()}
    assert found["0500-250"] == ("hit", "") and found["9999"][0] == "last" and found[""][0] == "start" and len(found) == 1504
    assert ranges.versions(spark, path) == [0, 1, 2, 3]
    assert ranges.vacuum(spark, path) > 0 and ranges.versions(spark, path) == [3] and len(ranges.read(spark, path).collect()) == 1504
    assert len([f for f in os.listdir(tmp_path / "t" / "data") if f.startswith("range=")]) == len(ranges.ranges(spark, path))


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    ranges.create(spark.createDataFrame([("a", "1", "")], KIND), path, "key")
    with pytest.raises(RuntimeError, match="another writer"):
        ranges._publish(spark, path, [], "key string", "key", -1)
    assert rows_of(ranges.read(spark, path)) == [("a", "1", "")] and ranges.versions(spark, path) == [0]
    with pytest.raises(ValueError, match="no table"):
        ranges.read(spark, f"{path}-other")


def test_no_operator_drops_a_column_of_its_input(spark):
    helpers = ["_line", "_r", "_k", "_base", "_used", "_start", "_rank", "_round", "_island", "_n", "_tail", "_key", "_left", "_mate", "key_", "value_", "range_", "row_", "start_", "_lot"]
    df = spark.createDataFrame([("d", 0, k, 1.0 * k, 10.0 * k, k % 2 == 0, f"x{k}", *([k] * len(helpers))) for k in range(5)], "doc string, page int, at int, left double, y double, flag boolean, name string, " + ", ".join(f"`{h}` int" for h in helpers))
    taken = spark.createDataFrame([("x1",), ("x1-2",)], "name string")
    for out in (
        sequences.opens_line(df), sequences.opens_coarse_line(df), sequences.next_free(df, taken, "name"), sequences.runs(df, ["doc"], ["at"], "flag"), sequences.keep_in_gaps(df, ["doc"], ["at"], "flag", 2),
        sequences.dilate(df, ["doc"], ["at"], "flag", 1, "wide"), sequences.running_offset(df, ["doc"], ["at"], "at", 1), sequences.remap(df, ["doc"], ["at"], "flag"), sequences.until_next(df, ["doc"], ["at"], "at"),
        sequences.first_places(df, ["doc"], "left", "at", 2.0, ["at"]), raster.kept_parts(df, ["doc"], "at", "flag"), aggregates.stratified(df, "doc", ["at"], 9, 9), relations.first_by(df, ["at"], "left"), relations.last_by(df, ["at"], "left"),
    ):
        kept = out.where("at = 3").select([f"`{h}`" for h in helpers]).first()
        assert set(df.columns) <= set(out.columns) and (kept is None or set(kept) == {3})
    free = {r["name"]: r["free"] for r in sequences.next_free(df, taken, "name").collect()}
    assert free["x1"] == "x1-3" and free["x2"] == "x2"
