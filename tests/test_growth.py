"""Steps that took several joins, or regular expressions for every line, go by document in one shuffle."""

from __future__ import annotations

SPAN = "doc string, page int, ord int, left double, y double, text string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_readings_are_one_shuffle_and_one_table(spark, tmp_path, monkeypatch):
    """A document's spans, starts and numbers meet once, whichever of the three ways it is read."""
    from quiresmith.plans import corpus

    def spans(doc: str, lefts: list[float]):
        return [(doc, 0, k, float(left), 40.0 * (k + 1), str(k + 1)) for k, left in enumerate(lefts)]

    every = spans("own", [50, 50, 50]) + spans("edge", [50, 50]) + [("edge", 0, 9, 163.0, 60.0, "1")] + spans("raw", [50, 50]) + spans("none", [50])
    spark.createDataFrame(every, SPAN).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    swept = raw.where("not (doc = 'raw' and text = '1')")
    begun = spark.createDataFrame([("own", 0, 40.0, 1), ("edge", 0, 60.0, 1), ("raw", 0, 80.0, 2)], "doc string, page int, y double, number int")
    wanted = spark.createDataFrame([("own", [1, 2, 3]), ("edge", [1, 2]), ("raw", [1, 2]), ("none", [1, 2])], "doc string, target array<int>")
    plans, write = [], corpus.materialize
    monkeypatch.setattr(corpus, "materialize", lambda df, *more: plans.append(_plan(df)) or write(df, *more))
    readings, items = corpus.second_reading(swept, raw, wanted, begun)
    assert len(plans) == 1 and plans[0].count("Exchange ") == 1 and "Join" not in plans[0]
    assert {r["doc"]: (r["reading"], r["status"]) for r in readings.collect()} == {"own": (1, "cut"), "edge": (2, "cut"), "raw": (3, "cut"), "none": (None, "could not find them all")}
    found = sorted((r["doc"], r["page"], r["y"], r["number"]) for r in items.collect())
    assert found == [("edge", 0, 40.0, 1), ("edge", 0, 80.0, 2), ("none", 0, 40.0, 1), ("own", 0, 40.0, 1), ("own", 0, 80.0, 2), ("own", 0, 120.0, 3), ("raw", 0, 40.0, 1), ("raw", 0, 80.0, 2)]


def test_hand_over_takes_names_apart_by_paper(spark, tmp_path):
    """Pictures pass with one look at their paper's name; what is barred meets its pair without a join."""
    from quiresmith.plans import corpus

    held = {"9700_s01_qp_1": (1, 2), "9700_s01_MS_1": (1,), "9700_s01_ms_1": (2,), "9701_s01_qp_1": (1,), "9701_s01_ms_1": (1,), "9702_s01_qp_2": (1, 2), "9702_s01_ms_2": (1,), "other": (1,), "9703_s01_qp_1": (1,), "9703_s01_ms_1": (1,)}
    pictures = [(paper, n, size) for paper, numbers in held.items() for n in numbers for size in ("web", "full")]
    spark.createDataFrame(pictures, "paper string, number int, size string").write.parquet(f"{tmp_path}/artifacts")
    rows = spark.createDataFrame([("9701_s01_ms_1", ["gap"]), ("9700_s01_qp_1", ["stale"]), ("other", ["gap"])], "name string, faults array<string>")
    pending = spark.createDataFrame([("9703_s01_qp_1",)], "name string")
    found = corpus.hand_over(spark.read.parquet(f"{tmp_path}/artifacts"), rows, pending)
    plan = _plan(found)
    assert "Join" not in plan and plan.count("regexp_extract(") <= 12
    assert [tuple(r) for r in found.collect()] == [("9700", "s01", "1", 2)]


def test_workbooks_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """A zipped workbook of half a megabyte is a few hundred thousand cells: neither readers nor writers put many into one task."""
    from pyspark.sql import functions as F

    from quiresmith.sources import sinks, xlsx

    for k in range(6):
        (tmp_path / f"b{k}.xlsx").write_bytes(bytes(600_000))
    assert len(xlsx._Reader(str(tmp_path)).partitions()) == 6
    none, asked, table = F.lit(None).cast("string"), [], type(spark.range(1))
    deal = table.repartition
    monkeypatch.setattr(table, "repartition", lambda self, *by: asked.append(by) or deal(self, *by))
    books = spark.range(12).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("book"), F.lit("s").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("text").alias("kind"), F.lit("x").alias("value"), none.alias("formula"), F.lit(None).cast("int").alias("style"))
    sinks.write_cells(books, f"file://{tmp_path}/made")
    assert [by[1:] for by in asked] == [("book",)] and asked[0][0] >= 32
    assert len(list((tmp_path / "made").glob("*.xlsx"))) == 12


def test_bands_and_redactions_meet_by_document_without_joins(spark, tmp_path):
    from quiresmith.operators import layout

    spark.createDataFrame([("d", p, 600.0, 800.0) for p in (0, 1)] + [("e", 0, 600.0, 800.0)], "doc string, page int, width double, height double").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("d", p, 50.0, 20.0, 200.0, 40.0, "© board") for p in (0, 1)] + [("x", 0, 50.0, 20.0, 200.0, 40.0, "© board")], "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string").write.parquet(f"{tmp_path}/blocks")
    pages, blocks = spark.read.parquet(f"{tmp_path}/pages"), spark.read.parquet(f"{tmp_path}/blocks")
    bands = layout.header_footer_bands(blocks, pages)
    assert "Join" not in _plan(bands) and sorted(map(tuple, bands.collect())) == [("d", 40.0, 0.0), ("e", 0.0, 0.0)]
    assert "Join" not in _plan(layout.redactions(blocks, pages, bands))


def test_interval_faults_meet_by_document_without_joins(spark, tmp_path):
    from quiresmith.plans import corpus

    spark.createDataFrame([("d", 0, 0, 50.0, 10.0, "1"), ("d", 0, 1, 70.0, 30.0, "(b) x"), ("d", 0, 2, 50.0, 50.0, "2"), ("d", 1, 3, 50.0, 5.0, "3")], SPAN).write.parquet(f"{tmp_path}/spans")
    begun = spark.createDataFrame([("d", 0, 10.0, 1), ("d", 0, 50.0, 2)], "doc string, page int, y double, number int")
    found = corpus.interval_faults(spark.read.parquet(f"{tmp_path}/spans"), begun)
    assert "Join" not in _plan(found)
    assert sorted((r["number"], r["first_part"], r["foreign"]) for r in found.collect()) == [(1, "b", False), (2, None, True)]
