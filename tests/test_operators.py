"""Relations, windows, chains, layout and raster kernels on the cases of FIXTURES C4 and C5."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings as relaxed
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiresmith.operators import aggregates, bands, chains, layout, raster, relations, sequences, starts, upsert


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Chains


def longest(values, fits):
    """All chains by brute force: the longest, then the smallest end."""
    best = []
    for k, v in enumerate(values):
        best.append(1 + max([best[j] for j in range(k) if fits(values[j], v)], default=0))
    return max(((n, -v) for n, v in zip(best, values)), default=(0, 0))


@pytest.mark.parametrize(("values", "chain"), [([1, 7, 2, 3, 8, 9, 10, 11], [1, 4, 5, 6, 7]), ([5, 6, 1, 2], [2, 3]), ([], []), ([3, 3, 3], [0])])
def test_counting_chain_cases(values, chain):
    assert chains.counting_chain(values) == chain


def test_rising_chain_case():
    found = chains.rising_chain([1, 2, 7, 3, 8])
    assert len(found) == 4 and found[-1] == 4


@relaxed(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=14))
def test_chains_by_brute_force(values):
    for pick, fits in ((chains.counting_chain, lambda a, b: b == a + 1), (chains.rising_chain, lambda a, b: a < b)):
        found = pick(values)
        assert found == sorted(set(found))
        assert all(fits(values[a], values[b]) for a, b in zip(found, found[1:]))
        assert (len(found), -values[found[-1]] if found else 0) == longest(values, fits)


SPAN = "doc string, kind string, page int, ord int, left double, centre double, y double, text string"


def spans_of(doc, kind, *pages):
    """Spans of pages given as (left, y, text), with a centre that hangs on the text's length unless it is given."""
    return [(doc, kind, p, k, float(left), float(*centre or (left + 3.0 * len(text),)), float(y), text) for p, page in enumerate(pages) for k, (left, y, text, *centre) in enumerate(page)]


LISTED = [(80, 100 + 20 * k, str(k)) for k in range(1, 9)]
#: Pages of a document, its side, and where its items start.
READINGS = {
    "raised digit with words to its left": ("qp", [[(50, 100, "1"), (70, 100, "Mix"), (20, 198, "V / cm"), (50, 200, "3")], [(50, 100, "2"), (50, 300, "3")]], [(0, 100, 1), (1, 100, 2), (1, 300, 3)]),
    "column that spans more pages": ("qp", [[(50, 50, "1"), *LISTED], [(50, 60, "2")], [(50, 60, "3")]], [(0, 50, 1), (1, 60, 2), (2, 60, 3)]),
    "swallowed label past the last": ("qp", [[(50, 100, "9"), (50, 300, "10")], [(50, 80, "11 Functions f and g"), (90, 200, "x")]], [(0, 100, 9), (0, 300, 10), (1, 80, 11)]),
    "swallowed label in between": ("qp", [[(50, 100, "1"), (50, 200, "2 Use the formula")], [(50, 100, "3"), (50, 150, "4"), (50, 200, "2 again")]], [(0, 100, 1), (0, 200, 2), (1, 100, 3), (1, 150, 4)]),
    "missing label": ("qp", [[(50, 100, "1"), (50, 200, "2")], [(50, 100, "4"), (50, 200, "5")]], [(0, 100, 1), (0, 200, 2), (1, 100, 4), (1, 200, 5)]),
    "headings win over lists": ("ms", [[(50, 100, "Question 1 Planning (15 marks)"), *[(50, 140 + 20 * k, str(k)) for k in range(1, 10)]], [(50, 100, "Question 2 Analysis")]], [(0, 100, 1), (1, 100, 2)]),
    "lone item": ("qp", [[(50, 100, "1"), (90, 120, "text")]], []),
    "back to the first part": ("ms", [[(81.6, 100, "1(a)", 90.0), (76.7, 300, "1(d)(i)", 90.0)], [(81.6, 100, "2(a)", 90.0), (76.7, 200, "2(d)(i)", 90.0)]], [(0, 100, 1), (1, 100, 2)]),
    "count on one page of three": ("qp", [[(50, 100, "1"), (50, 200, "2")], [(50, 100, "x")], [(50, 100, "y")]], []),
    "no spans that open": ("qp", [[(50, 100, "x y"), (60, 100, "1"), (60, 104, "2")]], []),
}


def test_starts_of_documents(spark):
    rows_ = [r for doc, (kind, pages, _) in READINGS.items() for r in spans_of(doc, kind, *pages)]
    rows_.append(("nulls", "qp", 0, 0, None, None, None, None))
    found = {}
    for r in starts.find_starts(spark.createDataFrame(rows_, SPAN)).collect():
        found.setdefault(r["doc"], []).append((r["page"], r["y"], r["number"]))
    for doc, (_, _, want) in READINGS.items():
        assert sorted(found.get(doc, [])) == [(p, float(y), n) for p, y, n in want], doc
    assert "nulls" not in found


def test_hunt_in_turn(spark):
    df = spark.createDataFrame(spans_of("a", "qp", [(50, 100, "1"), (50, 150, "3"), (50, 200, "2.")], [(50, 100, "3 x"), (120, 120, "4")]), SPAN)
    wanted = spark.createDataFrame([("a", [1, 2, 3, 4, 5])], "doc string, target array<int>")
    bands = spark.createDataFrame([("a", 38.0, 70.0)], "doc string, low double, high double")
    got = starts.hunt(df, wanted, bands).collect()
    assert sorted((r["page"], r["y"], r["number"]) for r in got) == [(0, 100, 1), (0, 200, 2), (1, 100, 3)]


def test_hunts_of_several_documents(spark):
    rows_ = [r for doc in ("a", "b") for r in spans_of(doc, "qp", [(50, 100, "1"), (50, 200, "2")], [(50, 100, "3")])]
    rows_ += spans_of("c", "qp", [(40, 100, "x"), (60, 200, "3"), (90, 300, "1")])  # nothing is read: the band lies at the edge
    df = spark.createDataFrame(rows_, SPAN).withColumn("target", F.array(F.lit(1), F.lit(3)))
    hunted = starts.hunt_starts(df)
    assert rows(hunted.select("doc", "number"), "doc", "number") == [("a", 1), ("a", 3), ("b", 1), ("b", 3), ("c", 3)]


# Windows


@pytest.fixture(scope="module")
def flags(spark):
    return spark.createDataFrame([("a", k, f) for k, f in enumerate([False, True, True, False, True])], "img string, y int, on boolean")


def test_bands_and_dilation(spark, flags):
    assert rows(sequences.bands(flags, ["img"], "y", "on"), "start") == [("a", 1, 2, 2), ("a", 4, 4, 1)]
    lone = spark.createDataFrame([(k, k == 2) for k in range(5)], "y int, on boolean").withColumn("img", F.lit("a"))
    assert [r["w"] for r in sequences.dilate(lone, ["img"], ["y"], "on", 1, "w").orderBy("y").collect()] == [False, True, True, True, False]
    assert raster.bands_of(np.array([0, 1, 1, 0, 1], bool)) == [(1, 2), (4, 4)]
    assert raster.spread(np.array([0, 0, 1, 0, 0], bool), 1).tolist() == [False, True, True, True, False]


def test_gap_keeps_head_and_tail(spark):
    df = spark.createDataFrame([("a", k, 0 < k < 10) for k in range(11)], "img string, y int, blank boolean")
    kept = [r["y"] for r in sequences.keep_in_gaps(df, ["img"], ["y"], "blank", 5).where("keep").orderBy("y").collect()]
    assert kept == [0, 1, 2, 7, 8, 9, 10]


def test_remap_and_offsets(spark):
    df = spark.createDataFrame([("a", k, f, 10) for k, f in enumerate([True, False, False, True])], "img string, y int, keep boolean, h int")
    assert [r["new_at"] for r in sequences.remap(df, ["img"], ["y"], "keep").orderBy("y").collect()] == [0, 0, 0, 1]
    assert [r["offset"] for r in sequences.running_offset(df, ["img"], ["y"], "h", 5).orderBy("y").collect()] == [0, 15, 30, 45]


@pytest.mark.parametrize(("numbers", "out"), [([1, 2, 3], True), ([1, 3], False), ([1, 2, 2], False), ([], True)])
def test_completeness(spark, numbers, out):
    df = spark.createDataFrame([(numbers,)], "n array<int>")
    assert df.select(sequences.is_complete(F.col("n"))).first()[0] is out


def test_line_openings(spark):
    spans = spark.createDataFrame([("d", 0, 20.0, 98.0), ("d", 0, 50.0, 100.0), ("d", 0, 50.0, 120.0)], "doc string, page int, left double, y double")
    assert [r["opens"] for r in sequences.opens_line(spans).orderBy("y", "left").collect()] == [True, False, True]
    assert [r["opens"] for r in sequences.opens_coarse_line(spans).orderBy("y", "left").collect()] == [True, False, True]


def test_first_places_and_next_free(spark):
    df = spark.createDataFrame([("d", 50.0, 1, 0), ("d", 49.0, 1, 1), ("d", 90.0, 1, 2)], "doc string, x double, n int, ord int")
    assert [r["ord"] for r in sequences.first_places(df, ["doc"], "x", "n", 4.0, ["ord"]).orderBy("ord").collect()] == [0, 2]
    taken = spark.createDataFrame([("a",), ("a-2",), ("b-3",)], "name string")
    new = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "name string")
    assert sorted(r["free"] for r in sequences.next_free(new, taken, "name").collect()) == ["a-3", "a-4", "b", "c"]


def test_trimmed_tail(spark):
    pages = spark.createDataFrame([("a", 0, False, False), ("a", 1, False, True), ("a", 2, True, False), ("a", 3, True, False), ("b", 0, True, False), ("c", 0, False, False), ("c", 1, True, True)], "doc string, page int, e boolean, m boolean")
    assert rows(sequences.trimmed_tail(pages, "e", "m"), "doc") == [("a", 2), ("b", 1), ("c", 2)]


# Aggregates and relations


def test_family_shapes_as_published(spark):
    tallies = {"9700_2": {6: 68}, "9700_5": {2: 60, 3: 5}, "9701_2": {3: 6, 4: 35, 5: 18, 6: 8}, "9702_4": {10: 28, 11: 1, 12: 35, 13: 5, 14: 1}, "9709_5": {6: 11, 7: 44}}
    want = {"9700_2": (6, 1.0, 68, True), "9700_5": (2, 0.923, 65, True), "9701_2": (4, 0.522, 67, False), "9702_4": (12, 0.5, 70, False), "9709_5": (7, 0.8, 55, False)}
    papers = [(f, f"{f}-{n}-{k}", n) for f, tally in tallies.items() for n, hits in tally.items() for k in range(hits)]
    items = spark.createDataFrame(papers, "family string, paper string, n int").select("family", "paper", F.explode(F.sequence(F.lit(1), "n")).alias("number"))
    found = {r["family"]: r for r in aggregates.family_shape(items).collect()}
    assert {f: (r["questions"], r["share"], r["papers"], r["certain"]) for f, r in found.items()} == want
    assert found["9701_2"]["seen"] == tallies["9701_2"]


def test_agreed_shapes_need_both_sides(spark):
    held = [("9702_s25_qp_21", 1), ("9702_s25_qp_21", 2), ("9702_s25_ms_21", 1), ("9702_s25_ms_21", 2), ("9702_s25_qp_22", 1), ("9702_w25_qp_21", 1), ("9702_w25_ms_21", 2), ("cover", 1)]
    found = aggregates.agreed_shapes(spark.createDataFrame(held, "paper string, number int")).collect()
    assert [(r["family"], r["questions"], r["papers"]) for r in found] == [("9702_2", 2, 1)]


def test_consensus_and_stamps(spark):
    edges = spark.createDataFrame([("d", 0, 40.2, None), ("d", 1, 39.8, 700.0), ("d", 2, 90.0, 701.0), ("e", 0, None, None)], "doc string, page int, head double, foot double")
    assert rows(aggregates.consensus_edges(edges, ["doc"]), "doc") == [("d", 40.0, 0.0), ("e", 0.0, 0.0)]
    pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in range(4)], "doc string, page int, width double, height double")
    images = spark.createDataFrame([("d", p, 10.2, 10.0, 60.0, 60.1) for p in range(3)] + [("d", 3, 0.0, 0.0, 600.0, 800.0), ("d", 3, 300.0, 300.0, 310.0, 310.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r["page"] for r in aggregates.repeated_stamps(images, pages).orderBy("page").collect()] == [0, 1, 2]


def test_stratified_rounds(spark):
    df = spark.createDataFrame([("a", f"a{k}") for k in range(1, 5)] + [("b", "b1")], "v string, name string")
    assert sorted(r["name"] for r in aggregates.stratified(df, "v", ["name"], 3, 4).collect()) == ["a1", "a2", "a3", "b1"]


def test_best_by_first_wins(spark):
    df = spark.createDataFrame([("d", 1, 5, "x"), ("d", 2, 5, "y"), ("d", 3, 4, "z")], "doc string, seq int, s int, name string")
    assert aggregates.best_by(df, ["doc"], [F.col("s")], "seq", "name").first()["name"] == "x"


def test_copies_and_partners(spark):
    files = spark.createDataFrame([("a",), ("a (2)",), ("b (1)",)], "name string")
    assert sorted(r["name"] for r in relations.without_copies(files).collect()) == ["a", "b (1)"]
    papers = spark.createDataFrame([("9702_s25_qp_21", 3), ("9702_s25_ms_21", 4), ("x", 1)], "name string, n int")
    assert {r["name"]: r["mate_n"] for r in relations.with_partner(papers).collect()} == {"9702_s25_qp_21": 4, "9702_s25_ms_21": 3, "x": None}


def test_as_of_prefers_priority_then_nearness(spark):
    marks = spark.createDataFrame([("d", 100), ("d", 10)], "doc string, row int")
    lines = spark.createDataFrame([("d", 95, False, True), ("d", 80, True, True), ("d", 70, True, False), ("d", 30, True, True)], "doc string, y int, rule boolean, blank boolean")
    found = relations.as_of(marks, lines, ["doc"], "row", "y", 40, [F.col("rule"), F.col("blank")], ["doc", "row"])
    assert rows(found.select("row", "priority", "found_at"), "row") == [(10, None, None), (100, 0, 80)]


def test_header_search(spark):
    cells = [("s", 2, 1, "Subject"), ("s", 2, 3, "Q filename"), ("s", 2, 4, "Topic"), ("s", 2, 5, "Chapter"), ("s", 1, 1, "Subject"), ("s", 3, 1, "math"), ("s", 3, 3, "f.png"), ("s", 3, 4, "Algebra"), ("t", 1, 1, "nothing")]
    from quiresmith.sources.readers import sheet_rows

    df = spark.createDataFrame(cells, "sheet string, row int, col int, value string")
    got = sheet_rows(df).collect()
    assert [(r["row"], r["subject"], r["q_filename"], r["chapter"]) for r in got] == [(3, "math", "f.png", "Algebra")]


def test_upserts(spark):
    table = spark.createDataFrame([("k1", "hard", "1"), ("k2", "easy", "2")], "stem string, difficulty string, marks string")
    staged = spark.createDataFrame([("k1", "", "9", 1), ("k3", "new", "3", 2), ("k3", "newer", None, 3)], "stem string, difficulty string, marks string, seq int")
    columns = ["difficulty", "marks"]
    assert rows(upsert.upsert_rows_csv(table, staged, columns)) == [("k1", "", "9"), ("k2", "easy", "2"), ("k3", "newer", None)]
    sheet = spark.createDataFrame([("A_Q.png", "", "hard")], "q_filename string, ms_filename string, difficulty string")
    more = spark.createDataFrame([("a_q.PNG", "a_MS.png", "", 1)], "q_filename string, ms_filename string, difficulty string, seq int")
    assert rows(upsert.upsert_sheet(sheet, more, ["q_filename", "ms_filename", "difficulty"])) == [("a_q.PNG", "a_MS.png", "hard")]
    states = spark.createDataFrame([("f1", "in"), ("f2", "in"), ("f3", "in")], "file string, state string")
    plan = spark.createDataFrame([("f1", "clean"), ("f2", None)], "file string, state string")
    assert rows(upsert.moved(states, plan), "file") == [("f1", "clean"), ("f3", "in")]
    assert [r["value"] for r in upsert.manifest(states, "files", F.col("file"), ["file"]).collect()] == ["files: 3", "", "f1", "f2", "f3"]


# Layout


@pytest.mark.parametrize(
    ("text", "box", "rule"),
    [
        ("2", (550, 20, 560, 40), None),
        ("7", (295, 20, 305, 40), "page number"),
        ("Total", (50, 160, 90, 170), None),
        ("Total Marks", (50, 160, 120, 170), "column heading"),
        ("Total", (50, 70, 90, 80), "column heading"),
        ("0 10 20", (100, 200, 110, 400), None),
        ("x", (2, 200, 12, 400), "edge bar"),
        ("\x01" * 13, (50, 70, 300, 80), "code strip"),
        ("* 0000800000004 *", (50, 300, 90, 310), "starred digits"),
        ("Question 3 starts on page 10", (50, 300, 90, 310), "navigation"),
        ("Page 9 of 13", (50, 700, 90, 710), "running line"),
        ("Page 9 of 13", (50, 300, 90, 310), None),
        ("anything", (50, 760, 90, 770), "foot"),
        ("   ", (50, 760, 90, 770), None),
    ],
)
def test_furniture_rules(spark, text, box, rule):
    found = layout.furniture_rule(F.lit(text), *(F.lit(float(v)) for v in box), F.lit(600.0), F.lit(800.0))
    assert spark.range(1).select(found).first()[0] == rule


@pytest.fixture(scope="module")
def page(spark):
    pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in (0, 1)], "doc string, page int, width double, height double")
    blocks = [("d", p, 50.0, 20.0, 200.0, 40.0, "© board") for p in (0, 1)] + [("d", p, 50.0, 100.0, 500.0, 300.0, "content [3]") for p in (0, 1)] + [("d", p, 280.0, 750.0, 320.0, 790.0, "foot") for p in (0, 1)]
    return pages, spark.createDataFrame(blocks, "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string")


def test_bands_and_sweep(page):
    pages, blocks = page
    bands = layout.header_footer_bands(blocks, pages)
    assert rows(bands) == [("d", 40.0, 750.0)]
    areas = layout.redactions(blocks, pages, bands)
    assert {r["text"] for r in layout.swept(blocks, areas).collect()} == {"content [3]"}
    assert layout.swept(blocks, areas).count() == 2


def test_window_grows_to_hold_blocks(spark, page):
    pages, _ = page
    blocks = spark.createDataFrame([("d", 0, 50.0, 775.0, 200.0, 793.0, "[3] x"), ("d", 0, 50.0, 795.0, 60.0, 799.0, "[1] past")], "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    window = layout.page_windows(blocks, pages, {"bottom": 13.0}).where("page = 0").first()
    assert window["foot"] == 794.0 and window["top"] == 0.0
    lost = layout.lost_marks(blocks, layout.page_windows(blocks, pages, {"bottom": 13.0}))
    assert [(r["text"], r["why"]) for r in lost.collect()] == [("[1] past", "outside the window")]


def test_mended_lines_and_facts(spark):
    pieces = [("d", 0, 10.0, 40.0, 100.0, "Que"), ("d", 0, 38.0, 80.0, 100.2, "estion"), ("d", 0, 90.0, 120.0, 100.1, "Answer"), ("d", 0, 130.0, 150.0, 100.0, "Marks"), ("d", 0, 10.0, 20.0, 130.0, "next")]
    lines = layout.mended_lines(spark.createDataFrame(pieces, "doc string, page int, x0 double, x1 double, y double, text string"))
    texts = layout.page_texts(lines)
    assert texts.first()["text"] == "Question Answer Marks next"
    more = spark.createDataFrame([("d", 1, "work .............. [2]"), ("d", 2, "The Periodic Table of Elements"), ("e", 0, "plain")], "doc string, page int, text string")
    facts = {r["doc"]: r for r in layout.document_facts(texts.unionByName(more)).collect()}
    assert (facts["d"]["kind"], facts["d"]["answer_page"], facts["d"]["first_question"], facts["d"]["last_page"]) == ("ms", 0, 1, 2)
    assert (facts["e"]["kind"], facts["e"]["answer_page"], facts["e"]["last_page"]) == ("qp", None, 1)


def test_shredded(spark):
    pieces = [("d", f"w{k}") for k in range(25)] + [("e", "a longer line")] * 30
    assert rows(layout.shredded(spark.createDataFrame(pieces, "doc string, text string")), "doc") == [("d", True), ("e", False)]


# Raster


def image(height=60, width=200):
    return np.zeros((height, width), bool)


def test_edge_rules_are_shaved():
    mask = image()
    mask[2:4] = True  # a rule by the edge
    mask[20:30, 50:90] = True
    assert raster.edge_cut(mask.mean(axis=1)) == 4
    assert raster.box_of(mask.mean(axis=1), mask.mean(axis=0))[1] == 4
    mask[0:3, 10:20] = True  # content first
    assert raster.edge_cut(mask.mean(axis=1)) == 0


def test_rulings_go_and_marks_stay():
    grey = np.full((80, 440), 255)
    grey[40, 10:420:4] = 0  # dots
    grey[30:45, 425:430] = 0  # a tall bracket
    out = raster.without_rulings(grey)
    assert (out[40, 10:400] == 255).all() and (out[30:45, 425:430] == 0).all()
    text = np.full((80, 440), 255)
    text[20:32, 20:420:8] = 0
    assert (raster.without_rulings(text) == text).all()


def test_paginate_by_rows():
    blank = np.ones(100, bool)
    blank[:28] = blank[30:70] = False
    assert raster.paginate(blank, 40) == [(0, 29), (30, 70)]
    with pytest.raises(ValueError):
        raster.paginate(blank, 5)


def test_split_and_edges(spark):
    ink = image(200, 60)
    ink[10:40, 5:50] = True
    ink[60:100, 5:50] = True
    ink[10:100:10, 15:] = False  # thin rows set the floor
    found = raster.Strip.of(ink, 1.0, False).pieces([(12, 1), (62, 2)], keep_head=False)
    assert found == [(1, 10, 40), (2, 60, 100)]
    df = spark.createDataFrame([("i", y, [bool(v) for v in line]) for y, line in enumerate(ink)], "img string, y int, ink array<boolean>")
    marks = spark.createDataFrame([("i", 12, 1), ("i", 62, 2)], "img string, row int, number int")
    assert rows(bands.split_items(df, marks, 1.0, False, False), "number") == [("i", 1, 10, 40), ("i", 2, 60, 100)]
    assert rows(raster.trim_boxes(df, 4)) == [("i", 1, 6, 54, 104)]
    assert rows(raster.blank_images(raster.row_profile(df))) == [("i", False)]
    assert rows(bands.pages_of(df, 50), "first")[0] == ("i", 0, 49)
    cut = image(40, 300)
    cut[0:20, ::10] = True
    clean = cut.copy()
    clean[0] = False
    clean[0, 5] = True
    images = {"cut": cut, "clean": clean, "blank": image()}
    table = spark.createDataFrame([(name, y, [bool(v) for v in row]) for name, m in images.items() for y, row in enumerate(m)], "img string, y int, ink array<boolean>")
    edges = {r["img"]: r["top"] for r in bands.cut_edges(table).collect()}
    assert edges == {"cut": 1.0, "clean": 0.0}


def test_runs_by_brute_force():
    mask = np.random.default_rng(3).random((20, 7)) < 0.6
    want = np.zeros_like(mask, int)
    for x in range(7):
        for a, b in raster.bands_of(mask[:, x]):
            want[a : b + 1, x] = b - a + 1
    for most in (2, 5, 30):
        assert (raster.vertical_runs(mask, most) == np.minimum(want, most + 1)).all()
    assert (raster.horizontal_runs(mask.T) == want.T).all()
    assert (raster.longest_runs(mask.T) == want.max(axis=0)).all()


def test_kept_parts(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("b", 2, True)], "doc string, ord int, blank boolean")
    assert rows(raster.kept_parts(df, ["doc"], "ord", "blank").select("doc", "ord"), "doc") == [("a", 2), ("b", 1)]


def test_random_runs_agree_with_bands(spark):
    rng = random.Random(4)
    values = [(k, rng.random() < 0.5) for k in range(200)]
    df = spark.createDataFrame(values, "y int, on boolean").withColumn("img", F.lit("a"))
    assert [(r["start"], r["end"]) for r in sequences.bands(df, ["img"], "y", "on").orderBy("start").collect()] == raster.bands_of(np.array([v for _, v in values]))
