"""Registered queries against their SQL, on rows where they differed, and steps of theirs that grew faster than their input."""

from __future__ import annotations

from collections import Counter

import pytest


def _differences(spark, folder, name: str) -> tuple[Counter, Counter]:
    """Rows of a query that its SQL does not give, and the other way round, over the tables of a folder."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    found = entry.queries()[name](spark, str(folder))
    base = duckdb.connect()
    for path in folder.glob("*.parquet"):
        base.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    columns = ", ".join(f'"{c}"' for c in found.columns)
    sql = Counter(base.sql(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall())
    own = Counter(tuple(r) for r in found.collect())
    return own - sql, sql - own


def _write(spark, folder, name: str, rows, schema: str) -> None:
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))


def test_a_form_with_a_long_key_has_a_year(spark, tmp_path):
    keys = (999, 1000, 9999, 10000, 14926, 1234567)
    _write(spark, tmp_path, "orders", [(k, c, s) for k, (c, s) in enumerate((c, s) for c in keys for s in "OFP")], "o_orderkey long, o_custkey long, o_orderstatus string")
    assert _differences(spark, tmp_path, "form_problems") == (Counter(), Counter())


@pytest.mark.parametrize("name", ["fused_images", "fused_across", "image_files", "image_kinds", "ink_and_white"])
def test_levels_are_products_in_single_precision(spark, tmp_path, name):
    """Components just below a multiple of 1/255 or 1/40: the product is whole in single precision and short of it in double."""
    np = pytest.importorskip("numpy")
    near = [(float(np.float32(k / s)), s) for s in (255, 40) for k in range(-s, s)]
    edges = [x for x, s in near if np.floor(np.float32(x) * np.float32(s)) != np.floor(x * s)]
    assert len(edges) >= 64
    _write(spark, tmp_path, "embeddings", [(k, [edges[(k * 64 + j) % len(edges)] for j in range(64)], k % 3) for k in range(12)], "vec_id long, embedding array<float>, label int")
    assert _differences(spark, tmp_path, name) == (Counter(), Counter())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


SPAN = "doc string, kind string, page int, ord int, left double, centre double, y double, text string"


def test_starts_shuffle_their_spans_once(spark, tmp_path):
    """Spans meet by document in one exchange; nothing is joined or written on the way."""
    from quiresmith.operators import starts

    rows = [("d", "qp", k, 0, 50.0, 53.0, 100.0, str(k + 1)) for k in range(3)] + [("m", "ms", 0, k, 50.0, 53.0, 30.0 * k, f"Question {k + 1} Planning") for k in range(3)]
    spark.createDataFrame(rows, SPAN).write.parquet(f"{tmp_path}/spans")
    found = starts.find_starts(spark.read.parquet(f"{tmp_path}/spans"))
    plan = _plan(found)
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert sorted((r["doc"], r["page"], r["y"], r["number"]) for r in found.collect()) == [("d", k, 100.0, k + 1) for k in range(3)] + [("m", 0, 30.0 * k, k + 1) for k in range(3)]


def test_a_hunt_shuffles_its_spans_once(spark, tmp_path):
    from quiresmith.operators import starts

    spark.createDataFrame([("d", "qp", 0, 0, 50.0, 53.0, 20.0, "1"), ("d", "qp", 0, 1, 50.0, 53.0, 40.0, "3")], SPAN).write.parquet(f"{tmp_path}/spans")
    wanted = spark.createDataFrame([("d", [3, 1, 2])], "doc string, target array<int>")
    bands = spark.createDataFrame([("d", 0.0, 90.0)], "doc string, low double, high double")
    found = starts.hunt(spark.read.parquet(f"{tmp_path}/spans"), wanted, bands)
    assert _plan(found).count("Exchange hashpartitioning") <= 3  # spans, wanted and bands, each by document
    assert [(r["y"], r["number"]) for r in found.collect()] == [(40.0, 3)]


def test_ranges_of_long_groups_do_not_grow_as_their_rows(spark, monkeypatch):
    """A sample of each range goes to the driver, so there are few of them however short ``long`` is."""
    from pyspark.sql import functions as F

    from quiresmith.operators import long_groups

    table, asked = type(spark.range(1)), []
    cut = table.repartitionByRange
    monkeypatch.setattr(table, "repartitionByRange", lambda self, n, *by: asked.append(n) or cut(self, n, *by))
    found = long_groups.running_offset(spark.range(4000).withColumn("k", F.lit(1)), ["k"], ["id"], "id", 1, long=8).orderBy("id").collect()
    assert asked and max(asked) <= 64
    assert [r["offset"] for r in found] == [k * (k - 1) // 2 + k for k in range(4000)]


def test_keys_find_their_range_by_a_search(spark, tmp_path, monkeypatch):
    """A range for every few rows: plans do not hold a literal for each, and lots are cut in one job."""
    from quiresmith.sources import ranges

    table = spark.range(3000).selectExpr("cast(id as string) as key", "'a' as name").unionByName(spark.createDataFrame([(None, "n")], "key string, name string"))
    path = f"file://{tmp_path}/table"
    ranges.create(table, path, "key", 20)
    held = ranges.ranges(spark, path)
    assert 100 <= len(held) <= 400 and sum(r.rows for r in held) == 3001
    assert len(str(ranges._lot("key", [r.first for r in held])._jc)) < 2000
    staged = spark.range(2900, 3100).selectExpr("cast(id as string) as key", "'b' as name", "id as seq")
    ranges.upsert_into(staged, path, ["name"], False, 20)
    assert {r["key"]: r["name"] for r in ranges.read(spark, path).collect()} == {str(k): "b" if k >= 2900 else "a" for k in range(3100)} | {None: "n"}
    firsts = [r.first for r in ranges.ranges(spark, path)]
    assert firsts[0] is None and firsts[1:] == sorted(set(firsts[1:]))
