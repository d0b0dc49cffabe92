"""Texts that hold no number: they are told by a null, not by a cast that fails."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

SPAN = "doc string, kind string, page int, ord int, left double, centre double, y double, text string"
READ = ["Question 3 Planning", "Question 12", "Question 00", "Question 123", "plain words", "12 words", "3(a)", "007", "40", "41", "Q7", "99999999999", " 5\t", "", None]


def _casts(df) -> int:
    """Casts in a plan that are tried on what a pattern found even if that is nothing."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"(?<!else )try_cast\(regexp_extract\(", plan))


def test_openings_try_no_cast_of_an_empty_text(spark, tmp_path):
    """A cast that fails throws and catches an exception, three and more for a span."""
    from quiresmith.operators import starts

    spark.createDataFrame([("m", "ms", 0, k, 50.0, 53.0, 30.0 * k, text) for k, text in enumerate(READ)], SPAN).write.parquet(f"{tmp_path}/spans")
    spans = spark.read.parquet(f"{tmp_path}/spans")
    assert _casts(starts.openings(spans)) == 0 and _casts(starts._placed(spans, starts.SWEPT)) == 0
    marks = {r["ord"]: (r["label"], r["lead"], r["head"]) for r in starts.openings(spans).collect() if r["here"]}
    assert marks == {0: (-1, -1, 3), 1: (-1, -1, 12), 2: (-1, -1, 0), 5: (-1, 12, -1), 6: (3, 3, -1), 8: (40, 40, -1), 9: (-1, 41, -1), 10: (7, -1, -1), 12: (5, 5, -1)}


@pytest.mark.parametrize(("text", "number"), [("Question 3", 3), ("Question 00", 0), ("Question", None), ("", None), (None, None)])
def test_matched_number(spark, text, number):
    from quiresmith.functions.strings import WORDED_HEADING, matched_number

    assert spark.createDataFrame([(text,)], "text string").select(matched_number(F.col("text"), WORDED_HEADING)).first()[0] == number
