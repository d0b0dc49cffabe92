"""Settings of a run, by kind of document."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from quiresmith.sources.schemas import FAMILY


@dataclass(frozen=True)
class CleanSettings:
    """Knobs of a document run that depend on its kind; None is not set."""

    kind: str | None = None
    cut_on_rules: bool | None = None
    keep_above_first: bool | None = None
    trim_end_matter: bool | None = None
    remove_answer_lines: bool | None = None
    dpi: int = 150


#: What each kind of document needs.
PROFILES = {
    "qp": CleanSettings("qp", cut_on_rules=False, keep_above_first=True, trim_end_matter=True, remove_answer_lines=True),
    "ms": CleanSettings("ms", cut_on_rules=True, keep_above_first=False, trim_end_matter=False, remove_answer_lines=False),
}


def profile_for(kind: str, base: CleanSettings = CleanSettings()) -> CleanSettings:
    """``base`` with its unset knobs as the kind needs them."""
    wanted = PROFILES.get(kind, PROFILES["qp"])
    unset = {f.name: getattr(wanted, f.name) for f in fields(base) if getattr(base, f.name) is None}
    return replace(base, **unset)


def load_families(spark: SparkSession, path: str) -> DataFrame:
    """The family table from its JSON object, as rows."""
    with open(path, encoding="utf-8") as source:
        table = json.load(source)
    rows = [(k, v["questions"], v["share"], v["papers"], {int(n): c for n, c in v["seen"].items()}, v["certain"]) for k, v in table.items()]
    return spark.createDataFrame(rows, FAMILY)
