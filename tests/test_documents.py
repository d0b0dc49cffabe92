"""Documents end to end, from blocks and spans to items, page lists and audit rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiresmith.operators import aggregates, bands, raster, relations
from quiresmith.plans import documents

DOC = "9702_s25_qp_21"


@pytest.fixture(scope="module")
def corpus_tables(spark):
    pages = [(DOC, p, 600.0, 800.0, 0) for p in range(4)]
    blocks, spans = [], []
    for p in range(4):
        blocks.append((DOC, p, 0, 50.0, 20.0, 300.0, 40.0, "© board 2025"))
        spans.append((DOC, p, 0, 50.0, 175.0, 30.0, "© board 2025"))
    content = {1: [(100, "1"), (110, "(a)"), (400, "2")], 2: [(100, "3"), (120, "(a)")]}
    for p, lines in content.items():
        for k, (y, text) in enumerate(lines, 1):
            left = 50.0 if text[0] != "(" else 70.0
            blocks.append((DOC, p, k, left, float(y), left + 200, y + 12.0, f"{text} words [2]"))
            spans.append((DOC, p, k, left, left + 3.0, float(y), text))
    blocks.append((DOC, 3, 1, 50.0, 300.0, 300.0, 320.0, "Permission to reproduce items"))
    return (
        spark.createDataFrame(blocks, "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string"),
        spark.createDataFrame(spans, "doc string, page int, ord int, left double, centre double, y double, text string"),
        spark.createDataFrame(pages, "doc string, page int, width double, height double, rotation int"),
    )


def test_reading(spark, corpus_tables):
    blocks, spans, pages = corpus_tables
    reading = documents.read(blocks, spans, pages)
    assert [(r["page"], r["y"], r["number"]) for r in reading.starts.orderBy("number").collect()] == [(1, 100.0, 1), (1, 400.0, 2), (2, 100.0, 3)]
    assert reading.facts.first()["kind"] == "qp" and reading.facts.first()["last_page"] == 3
    assert [(r["page"], r["position"]) for r in documents.page_choice(reading, pages).orderBy("page").collect()] == [(1, 0), (2, 1)]
    row = documents.audit(reading, blocks, pages).first()
    assert (row["name"], row["questions"], row["faults"]) == (DOC, [1, 2, 3], [])
    cleaned = spark.createDataFrame([(DOC, 1, 10, 800, list(range(900))), (DOC, 2, 0, 700, list(range(0, 900, 2)))], "doc string, page int, top int, height int, kept array<int>")
    marks = documents.strip_marks(reading.starts, documents.page_choice(reading, pages), cleaned, 72, 20)
    assert [(r["number"], r["row"]) for r in marks.orderBy("number").collect()] == [(1, 90), (2, 390), (3, 820 + 50)]


def test_page_rows_and_parts(spark):
    profile = spark.createDataFrame([(DOC, 0, y, 0 < y < 10) for y in range(11)], "doc string, page int, y int, blank boolean")
    kept = documents.page_rows(profile, 5).first()
    assert (kept["height"], kept["kept"]) == (7, [0, 1, 2, 7, 8, 9, 10])
    grey = np.full((300, 200), 240)
    grey[100:130, 60:120] = 0
    grey[220:230, 60:120] = 0
    out = raster.prepared(grey)
    assert out.shape == (30 + 45 + 10 + 2 * 10, 60 + 2 * 10) and set(np.unique(out)) == {0, 255}
    rows = spark.createDataFrame([("i", y, [int(v) for v in line]) for y, line in enumerate(grey)], "img string, y int, px array<int>")
    assert bands.prepare_parts(rows).count() == out.shape[0]
    assert bands.erase_rulings(rows).count() == 300
    parts = spark.createDataFrame([("a", 1, 100, 50), ("a", 2, 50, 50)], "doc string, ord int, width int, height int")
    assert [(r["width"], r["height"]) for r in raster.matched(parts, ["doc"]).orderBy("ord").collect()] == [(100, 50), (100, 100)]
    laid = raster.stacked(raster.matched(parts, ["doc"]), ["doc"], "ord", 22, 18).orderBy("ord").collect()
    assert [(r["x"], r["y"], r["canvas_width"], r["canvas_height"]) for r in laid] == [(18, 18, 136, 208), (18, 90, 136, 208)]
    assert [r["band"] for r in aggregates.size_histogram(parts).collect()] == [0.4]


def test_counts_and_positions(spark):
    rows = spark.createDataFrame([(DOC, 3), ("9702_s25_ms_21", 2), ("x", 1)], "name string, pictures int")
    assert [tuple(r) for r in aggregates.pictures_by_syllabus(rows).collect()] == [("9702", 2, 5), ("?", 1, 1)]
    wanted = spark.createDataFrame([(1,)], "position int").withColumn("k", F.lit("a"))
    placed = relations.at_positions(rows.withColumn("k", F.lit("a")), wanted, ["k"], ["name"])
    assert [r["name"] for r in placed.collect()] == [DOC]


def test_items_on_a_strip(spark):
    ink = np.zeros((200, 60), bool)
    ink[10:40, 5:50] = ink[60:100, 5:50] = True
    ink[10:100:10, 15:] = False
    strip = spark.createDataFrame([("i", y, [bool(v) for v in line]) for y, line in enumerate(ink)], "img string, y int, ink array<boolean>")
    marks = spark.createDataFrame([("i", 12, 1), ("i", 62, 2)], "img string, row int, number int")
    assert [(r["number"], r["first"], r["stop"]) for r in documents.item_images(strip, marks, 72, "qp").orderBy("number").collect()] == [(1, 10, 40), (2, 60, 100)]
