"""Scalar expressions on the cases of FIXTURES C3."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quiresmith.functions import names, numbers, strings


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first()["v"]


def L(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("text", "number"),
    [("1", 1), ("1(a)", 1), ("2(b)(iv)", 2), ("Q6(i)", 6), (".4", 4), (" 7. ", 7), ("41", None), ("(a)", None), ("cm3", None), ("0", None), ("12 The", None), ("", None), (None, None)],
)
def test_label_number(one, text, number):
    assert value(one, strings.label_number(L(text).cast("string"))) == number


@pytest.mark.parametrize(("a", "b", "out"), [("Que", "estion", "Question"), ("Ma", "arks", "Marks"), ("1(", "(a)(ii)", "1(a)(ii)"), ("ab", "cd", None), ("", "x", None), ("aa", "aa", "aa")])
def test_stitched(one, a, b, out):
    assert value(one, strings.stitched(L(a), L(b))) == out


def test_slug_tags_and_headings(one):
    assert value(one, strings.slug(L("Coordinate Geometry"))) == "coordinate-geometry"
    assert value(one, strings.tidy_tags(L("a ,, B,b , A"))) == "a, B"
    assert value(one, strings.heading_key(L("Mark-Scheme File Name"))) == "markschemefilename"
    assert value(one, strings.picture_stem(L(" x_q1_ms.PNG "))) == "x_q1"
    assert value(one, strings.squash(L("  a \n b  "))) == "a b"


def test_labels_parts_and_marks(one):
    assert value(one, strings.opens_as_label(L("2(a) x"))) and not value(one, strings.opens_as_label(L("2nd")))
    assert value(one, strings.names_a_part(L("3 (b)"))) and not value(one, strings.names_a_part(L("3")))
    assert value(one, strings.heading_number(L("Question 12 Planning"))) == 12
    assert value(one, strings.part_label(L("4 (c) x"))).asDict() == {"number": 4, "part": "c"}
    assert value(one, strings.part_label(L("(c)"))).asDict() == {"number": None, "part": "c"}
    assert value(one, strings.part_label(L("c)"))) is None
    assert value(one, strings.mark_allocations(L("x [3] y [Total: 12] z [abc]"))) == ["[3]", "[Total: 12]"]
    assert value(one, strings.is_code_strip(L("\x01" * 13))) and not value(one, strings.is_code_strip(L("y = \x01(x)\x02")))


@pytest.mark.parametrize(("spec", "out"), [("4-6,20", [3, 4, 5, 19]), ("6-4", [3, 4, 5]), ("", list(range(20))), ("1,1, 2", [0, 1]), ("19-30", [18, 19])])
def test_page_list(one, spec, out):
    assert value(one, numbers.page_list(L(spec), L(20))) == out


def test_page_list_without_pages_is_an_error(one):
    with pytest.raises(Exception, match="no pages are left"):
        value(one, numbers.page_list(L("30"), L(20)))


def test_numbers(one):
    assert [value(one, numbers.half_even(L(x))) for x in (2.5, 1.5, 0.5)] == [2.0, 2.0, 0.0]
    assert [value(one, numbers.size_band(L(h))) for h in (1200, 1201, 6000, 12001)] == [0.40, 0.45, 0.50, 0.60]
    assert value(one, numbers.saved_percent(L(200), L(50))) == 75.0 and value(one, numbers.saved_percent(L(0), L(50))) == 0.0
    assert [value(one, numbers.align_offset(L(10), L(25), L(a))) for a in ("left", "center", "right", "top")] == [0, 7, 15, 0]
    assert value(one, numbers.target_size(L(2000), L(1001), L(1000))).asDict() == {"width": 1000, "height": 500}
    assert value(one, numbers.target_size(L(500), L(100), L(1000))).asDict() == {"width": 500, "height": 100}
    assert value(one, numbers.is_grey(F.array(*[L(0)] * 999, L(40)))) and not value(one, numbers.is_grey(F.array(L(40), L(0))))
    box = F.struct(*[L(v).alias(k) for k, v in {"x0": 10.0, "y0": 20.0, "x1": 30.0, "y1": 60.0}.items()])
    assert tuple(value(one, numbers.as_shown(box, L(100.0), L(200.0), L(90)))) == (140.0, 10.0, 180.0, 30.0)
    assert tuple(value(one, numbers.as_shown(box, L(100.0), L(200.0), L(180)))) == (70.0, 140.0, 90.0, 180.0)
    assert tuple(value(one, numbers.rect_union(box, box))) == (10.0, 20.0, 30.0, 60.0)
    assert value(one, numbers.pixels(L(6.0), L(150))) == 12


def test_names(one):
    assert value(one, names.partner(L("9702_s25_qp_21"))) == "9702_s25_ms_21"
    assert value(one, names.partner(L("9702_S25_MS_21"))) == "9702_S25_qp_21"
    assert value(one, names.partner(L("notes"))) is None
    assert value(one, names.family(L("9702_s25_qp_21"))) == "9702_2" and value(one, names.family(L("x"))) is None
    assert value(one, names.document_name(L("9702_s25_QP_21"))).asDict() == {"syllabus": "9702", "session": "s25", "side": "qp", "variant": "21"}
    assert value(one, names.artifact(L("9702_s25_qp_21_q12"))).asDict() == {"paper": "9702_s25_qp_21", "number": 12}
    assert value(one, names.artifact(L("cover"))).asDict() == {"paper": "cover", "number": None}
    assert value(one, names.question_side(L("a_ms_1_q2.png"))) == "a_qp_1_q2.png"
    assert value(one, names.subject_label(L("9702"), {"9702": "Physics"})) == "Physics" and value(one, names.subject_label(L("1"), {"9702": "Physics"})) == "1"


FORM = {"subject": "physics", "paper": "1", "variant": "1", "chapter": "dynamics", "year": "2025", "season": "mj", "question": "19", "kind": "Q", "subtopic": "a,A", "difficulty": " hard ", "marks": "7", "youtube_url": ""}


def test_form(one):
    row = {k: L(v) for k, v in FORM.items()}
    stem = names.stem(*(row[c] for c in ("subject", "paper", "variant", "chapter", "year", "season", "question")))
    assert value(one, names.file_name(stem, L("Q"))) == "physics_p11_dynamics_2025mj_q19_Q.png"
    assert value(one, names.problems(row)) == []
    bad = row | {"paper": L("8"), "variant": L(""), "season": L("xx"), "kind": L("q")}
    assert value(one, names.problems(bad)) == ["paper", "variant", "season", "kind"]
    cells = one.select(*names.sheet_values(row)).first()
    assert (cells["paper"], cells["year"], cells["marks"], cells["subtopic"], cells["difficulty"]) == (1, 2025, 7, "a", "hard")
