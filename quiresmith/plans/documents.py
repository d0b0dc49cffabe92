"""One document, end to end: from blocks, spans and pages to its items, its page list and its audit row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.operators import bands, layout, sequences
from quiresmith.operators import starts as item_starts
from quiresmith.plans import corpus
from quiresmith.session import materialize


@dataclass(frozen=True)
class Reading:
    """Tables that a reading of documents gives."""

    facts: DataFrame
    bands: DataFrame
    areas: DataFrame
    spans: DataFrame
    starts: DataFrame


def block_texts(blocks: DataFrame) -> DataFrame:
    """doc, page, text of a page's blocks in order."""
    joined = blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_b"))
    return joined.select("doc", "page", F.array_join(F.col("_b.text"), " ").alias("text"))


def swept_spans(spans: DataFrame, areas: DataFrame) -> DataFrame:
    """Spans that no area touches; a span is a line as wide as its text."""
    lines = spans.withColumns({"x0": F.col("left"), "x1": 2 * F.col("centre") - F.col("left"), "y0": F.col("y") - 0.5, "y1": F.col("y") + 0.5})
    return layout.swept(lines, areas).drop("x0", "x1", "y0", "y1")


def read(blocks: DataFrame, spans: DataFrame, pages: DataFrame, tolerance: float = 4.0) -> Reading:
    """Facts of the unstripped text, what is furniture, the spans that stay, and where items start.

    The starts are kept as a table, since several plans read them.
    """
    facts = layout.document_facts(block_texts(blocks))
    bands = layout.header_footer_bands(blocks, pages)
    areas = layout.redactions(blocks, pages, bands)
    body = layout.body_spans(swept_spans(spans, areas), pages)
    searchable = materialize(layout.after_preamble(body, facts).join(facts.select("doc", "kind"), "doc"), "searchable")
    starts = materialize(item_starts.find_starts(searchable, tolerance), "starts")
    return Reading(facts, bands, areas, body, starts)


def page_choice(reading: Reading, pages: DataFrame, trim: bool = True) -> DataFrame:
    """doc, page, position of the pages to use: from the first item to the content's end, never short of the last item."""
    found = reading.starts.groupBy("doc").agg(F.min("page").alias("_first"), F.max("page").alias("_last"))
    span = reading.facts.join(found, "doc", "left")
    first = F.coalesce("_first", "answer_page", "first_question")
    stop = F.greatest("last_page", F.coalesce(F.col("_last") + 1, F.lit(1))) if trim else F.lit(1 << 30)
    bounds = span.select("doc", first.alias("_from"), stop.alias("_stop"))
    used = pages.select("doc", "page").join(bounds, "doc").where((F.col("page") >= F.col("_from")) & (F.col("page") < F.col("_stop")))
    return used.select("doc", "page", (F.row_number().over(Window.partitionBy("doc").orderBy("page")) - 1).alias("position"))


def strip_marks(starts: DataFrame, choice: DataFrame, cleaned: DataFrame, dpi: int, gap: int) -> DataFrame:
    """doc, row, number: starts as rows of the strip that the chosen pages make.

    cleaned(doc, page, top, height, kept) has what was trimmed off a page's
    top, its new height, and the sorted rows that gap collapsing kept.
    """
    placed = choice.join(cleaned, ["doc", "page"])
    placed = sequences.running_offset(placed, ["doc"], ["position"], "height", gap)
    row = F.greatest(F.bround(F.col("y") * dpi / 72, 0).cast("int") - F.col("top"), F.lit(0))
    new = F.size(F.filter("kept", lambda k: k <= row)) - 1
    inside = F.least(F.greatest(new, F.lit(0)), F.col("height") - 1)
    return starts.join(placed, ["doc", "page"]).select("doc", (F.col("offset") + inside).cast("int").alias("row"), "number")


def audit(reading: Reading, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Audit rows (name, kind, questions, faults) of a reading."""
    starts = reading.starts
    choice = page_choice(reading, pages).select("doc", "page")
    body = blocks.join(choice, ["doc", "page"], "left_semi")
    clean = layout.swept(body, reading.areas)
    turned = pages.join(choice, ["doc", "page"], "left_semi").groupBy("doc").agg(F.count_distinct("rotation").alias("rotations"))
    left = layout.left_furniture(block_texts(clean), clean, pages).select("doc", F.col("text").alias("furniture"))
    flags = reading.facts.select("doc").join(layout.shredded(body), "doc", "left").join(turned, "doc", "left").join(left, "doc", "left").withColumn("error", F.lit(None).cast("string"))
    return corpus.audit(reading.facts.select("doc", "kind"), starts, corpus.interval_faults(reading.spans, starts), flags)


def page_rows(profile: DataFrame, max_gap: int) -> DataFrame:
    """doc, page, height, kept of a page's profile(doc, page, y, blank) after collapsing its gaps."""
    kept = sequences.keep_in_gaps(profile, ["doc", "page"], ["y"], "blank", max_gap).where("keep")
    return kept.groupBy("doc", "page").agg(F.count(F.lit(1)).cast("int").alias("height"), F.array_sort(F.collect_list("y")).alias("kept"))


def item_images(strips: DataFrame, marks: DataFrame, dpi: int, kind: str) -> DataFrame:
    """img, number, first, stop: where each item lies on its strip, by the settings of its kind."""
    from quiresmith.plans.settings import profile_for

    s = profile_for(kind)
    return bands.split_items(strips, marks, dpi / 72, bool(s.cut_on_rules), bool(s.keep_above_first))
