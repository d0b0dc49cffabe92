"""Catalogue plan: forms in, checked rows and the merged catalogue out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.functions.names import file_name, problems, sheet_values, stem
from quiresmith.operators.upsert import upsert_rows_csv
from quiresmith.sources.schemas import CATALOG

FORM = ("subject", "paper", "variant", "chapter", "year", "season", "question", "kind", "subtopic", "difficulty", "marks", "youtube_url")
_NAME = ("subject", "paper", "variant", "chapter", "year", "season", "question")


def checked(forms: DataFrame) -> DataFrame:
    """Forms with ``problems``, ``stem`` and ``file``."""
    row = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FORM}
    name = stem(*(row[c] for c in _NAME))
    return forms.withColumns({"problems": problems(row), "stem": name, "file": file_name(name, row["kind"])})


def staged(forms: DataFrame) -> DataFrame:
    """Catalogue rows of forms without problems; ``seq`` keeps their order."""
    row = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FORM}
    fit = checked(forms).where(F.size("problems") == 0)
    return fit.select("stem", "seq", *sheet_values(row))


def export(forms: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalogue with all sound forms merged in."""
    columns = [c.split()[0] for c in CATALOG.split(", ")]
    rows = staged(forms)
    return upsert_rows_csv(catalog, rows.select("stem", "seq", *(F.col(c).cast("string").alias(c) for c in columns)), columns)
