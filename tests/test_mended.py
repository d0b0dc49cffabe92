"""Cases that once went wrong: order of logs, outcomes, match-ups, end matter, helper columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quiresmith.functions.numbers import half_even
from quiresmith.operators import aggregates, layout, raster, relations, sequences
from quiresmith.plans import corpus
from quiresmith.sources import readers, schemas, sinks

QP, MS = "9702_s25_qp_21", "9702_s25_ms_21"


def test_the_last_written_row_holds(spark, tmp_path):
    log = f"{tmp_path}/log"
    schema = "paper string, name string, status string"
    sinks.append_log(spark.createDataFrame([("p", "n", "ok"), ("q", "n", "first")], schema).coalesce(1), log)
    sinks.append_log(spark.createDataFrame([("p", "n", "error" + "!" * 500)], schema).coalesce(1), log)
    sinks.append_log(spark.createDataFrame([("q", "n", "x"), ("q", "n", "y")], schema).coalesce(1), log)
    rows = readers.log_lines(spark, log, schemas.BATCH_LOG, "paper").collect()
    assert {r["paper"]: r["status"][:5] for r in rows} == {"p": "error", "q": "y"}


def test_partners_with_faults_of_pictures_teach(spark):
    rows = spark.createDataFrame([(QP, [1, 2, 3], ["clipped", "pair-mismatch", "stale"], 0), (MS, [2], ["gap", "pair-mismatch"], 1)], "name string, questions array<int>, faults array<string>, ord int")
    assert {r["name"]: (r["target"], r["action"]) for r in corpus.match_ups(rows).collect()} == {MS: ([1, 2, 3], "match")}


def test_outcomes_of_repairs(spark):
    tried = spark.createDataFrame(
        [("empty", [1, 2], [], [1, 2, 3], "partner", None), ("changed", [1, 2], [1, 3], [1, 2, 3], "partner", None), ("nulls", None, [1], None, "gap", None), ("none", None, None, [1], "gap", None)],
        "name string, before array<int>, after array<int>, target array<int>, source string, error string",
    )
    assert {r["name"]: r["outcome"] for r in corpus.repair_outcome(tried).collect()} == {"empty": "no better", "changed": "improved", "nulls": "improved", "none": "no better"}


@pytest.mark.parametrize("last", ["BLANK PAGE", "Additional page", "data booklet", "the periodic table of elements", "Permission to reproduce items", "Copyright Acknowledgements Booklet"])
def test_every_end_matter_is_trimmed(spark, last):
    texts = spark.createDataFrame([("d", 0, "1 State [2]"), ("d", 1, "2 Find"), ("d", 2, f"x {last} y")], "doc string, page int, text string")
    assert layout.document_facts(texts).first()["last_page"] == 2


def test_a_total_without_its_colon_is_no_lost_mark(spark):
    blocks = spark.createDataFrame([("d", 0, "[Total 12]", 5.0, 9.0), ("d", 0, "[Total: 12]", 5.0, 9.0), ("d", 0, "[3]", 50.0, 60.0)], "doc string, page int, text string, y0 double, y1 double")
    windows = spark.createDataFrame([("d", 0, 20.0, 100.0)], "doc string, page int, top double, foot double")
    assert [r["text"] for r in layout.lost_marks(blocks, windows).collect()] == ["[Total: 12]"]


def test_agreed_bands_reach_only_as_far_as_content(spark):
    blocks = spark.createDataFrame([("d", 0, 0, 50.0, 20.0, 300.0, 40.0, "Cambridge International"), ("d", 0, 1, 50.0, 70.0, 300.0, 90.0, "1 State the law"), ("d", 1, 0, 50.0, 52.0, 300.0, 90.0, "2 Find")], "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.createDataFrame([("d", 0), ("d", 1)], "doc string, page int").withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    bands = spark.createDataFrame([("d", 60.0, 0.0)], "doc string, head double, foot double")
    found = {(r["page"], r["y0"], r["y1"]) for r in layout.redactions(blocks, pages, bands).collect()}
    # The heading itself reaches to four points above the content, the agreed band to the content of each page at most.
    assert found == {(0, 0.0, 66.0), (0, 0.0, 62.0), (1, 0.0, 52.0)}


def test_helper_columns_leave_those_of_the_user(spark):
    df = spark.createDataFrame([(1, k, 7, 8, 9, 5, True) for k in range(4)], "key int, at int, _rank int, _start int, _round int, _seen int, flag boolean")
    first = relations.first_by(df, ["key"], "at").first()
    assert first["_rank"] == 7 and set(first.asDict()) == set(df.columns)
    assert relations.flagged(df, df.where("false"), ["key"], "gone").first()["_seen"] == 5
    assert sequences.runs(df, ["key"], ["at"], "flag").first()["_start"] == 8
    assert sequences.first_places(df, ["key"], "at", "at", 4.0, ["at"]).first()["_rank"] == 7
    assert aggregates.stratified(df, "key", ["at"], 2, 9).first()["_round"] == 9
    assert half_even(F.lit(0.5)) is not None


def test_ranges_are_drawn_in_to_their_ink(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(40):
        ink = rng.random((80, 30)) < 0.3
        ink[rng.random(80) < 0.4] = False
        strip = raster.Strip.of(ink, 1.0, False)
        strip.divider[:] = (rng.random(80) < 0.08) & ~strip.blank
        content = strip.content()
        starts = np.sort(rng.choice(70, 3, replace=False))
        stops = np.append(starts[1:], 80)
        for start, stop, first, last in zip(starts, stops, *strip.framed(starts, stops)):
            held = [y for y in range(start, stop) if content[y]]
            if not held:
                assert (first, last) == (start, start)
                continue
            a, b = held[0], held[-1]
            while a > start and not strip.blank[a - 1]:
                a -= 1
            while b + 1 < stop and not strip.blank[b + 1]:
                b += 1
            below = [y for y in range(b + 1, stop) if strip.divider[y]]
            if below:
                b = below[0]
                while b + 1 < stop and strip.divider[b + 1]:
                    b += 1
            assert (first, last) == (a, b + 1)
