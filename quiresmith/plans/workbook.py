"""Workbook plan: entries in, cells to write out, so that each entry has its row in its workbook's sheet of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions.formulas import shifted
from quiresmith.functions.strings import heading_key, picture_stem
from quiresmith.operators.relations import first_by, header_columns
from quiresmith.session import materialize
from quiresmith.sources.schemas import HEADINGS

#: Names of the sheet that holds the rows; where none is so called the first sheet does.
SHEETS = ("questions", "question")
FILES = ("q_filename", "ms_filename")


def question_cells(cells: DataFrame) -> DataFrame:
    """Cells of each workbook's sheet of questions."""
    named = heading_key(F.col("sheet")).isin(*SHEETS)
    sheets = cells.where("kind = 'sheet'").select("book", "sheet", "place", named.alias("named"))
    chosen = first_by(sheets, ["book"], F.col("named").desc(), F.col("place")).select("book", "sheet")
    return cells.where("row > 0").join(chosen, ["book", "sheet"], "left_semi")


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def additions(cells: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (``xlsx.CELLS`` without place) to write, and book, sheet, stem, row, updated of the entries.

    ``entries`` has book, seq and the catalogue's columns. An entry's row is
    the first whose question or answer file has its stem, whatever its case;
    new stems come below the last row with data, in order of seq, and look
    like the row above. Blank fields write nothing; of entries with one stem
    the last that is not blank counts, field by field. Where a row that is
    written has nothing in a column that is none of the catalogue's and the
    row above has a formula, the formula is carried down. Workbooks without
    the headings, and entries without a question file or workbook, are left
    out; ties of seq go either way. The cells, the sheets' cells and the placed
    entries are written to the shared folder once, as many steps read them.
    """
    cells = materialize(cells.select("book", "sheet", "place", "row", "col", "kind", "value", "formula", "style"), "cells")
    sheet = F.struct("book", "sheet").alias("sheet")
    body = materialize(question_cells(cells).select(sheet, "row", "col", "value", "formula", "style"), "question-cells")
    header = header_columns(body.select("sheet", "row", "col", "value"), HEADINGS).withColumnRenamed("row", "head")
    heads = header.groupBy("sheet").agg(F.first("head").alias("head"))
    filled = ~_blank(F.col("value")) | F.col("formula").isNotNull()
    mapped = body.join(header, ["sheet", "col"]).where((F.col("row") > F.col("head")) & filled)
    last = heads.join(mapped.groupBy("sheet").agg(F.max("row").alias("last")), "sheet", "left").select("sheet", F.coalesce("last", "head").alias("last"))
    there = mapped.where(F.col("field").isin(*FILES)).groupBy("sheet", F.lower(picture_stem(F.col("value"))).alias("stem")).agg(F.min("row").alias("row")).where("stem <> ''")

    # One entry per stem: each field's last value that is not blank.
    fields = [f for f in HEADINGS if f in entries.columns]
    by_book = heads.select(F.col("sheet.book").alias("book"), "sheet")
    keyed = entries.withColumn("stem", F.lower(picture_stem(F.col("q_filename")))).where("stem <> ''").join(by_book, "book")
    merged = keyed.groupBy("sheet", "stem").agg(F.min("seq").alias("seq"), *(F.max_by(f, F.when(~_blank(F.col(f)), F.col("seq"))).alias(f) for f in fields))
    known = merged.join(there, ["sheet", "stem"], "left").withColumn("updated", F.col("row").isNotNull())
    rank = F.sum((~F.col("updated")).cast("int")).over(Window.partitionBy("sheet").orderBy("seq", "stem"))
    placed = materialize(known.withColumn("rank", rank).join(last, "sheet").withColumn("row", F.coalesce("row", F.col("last") + F.col("rank")).cast("int")), "placed-entries")

    numeric = {f: dict(entries.dtypes)[f] in ("int", "bigint", "double") for f in fields}
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.lit("number" if numeric[f] else "text").alias("kind"), F.col(f).cast("string").alias("value")) for f in fields))
    written = placed.select("sheet", "row", F.explode(values).alias("x")).select("sheet", "row", "x.*").where(~_blank(F.col("value"))).join(header.drop("head"), ["sheet", "field"]).select("sheet", "row", "col", "kind", "value")

    # New rows look like the last row with data, column by column.
    new = placed.where(~F.col("updated")).select("sheet", "row", "last")
    styles = new.join(body.select("sheet", F.col("row").alias("last"), "col", "style").where("style is not null"), ["sheet", "last"]).select("sheet", "row", "col", "style")

    # A formula comes from the row above: of a new row that may be a new row too, so it is the nearest filled cell from the last row on.
    others = body.join(header.select("sheet", "col"), ["sheet", "col"], "left_anti").where(filled).select("sheet", "col", "row", F.struct("formula", "row").alias("own"))
    above = others.join(last, "sheet").where(F.col("row") >= F.col("last"))
    columns = above.select("sheet", "col").distinct()
    grid = new.select("sheet", "row").join(columns, "sheet").join(above.select("sheet", "col", "row", "own"), ["sheet", "col", "row"], "full")
    near = F.last("own", True).over(Window.partitionBy("sheet", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    down = grid.withColumn("near", near).where(F.col("own").isNull())
    changed = placed.where("updated").select("sheet", "row").distinct()
    beside = changed.join(others.select("sheet", "col", (F.col("row") + 1).alias("row"), F.col("own").alias("near")), ["sheet", "row"]).join(others.select("sheet", "col", "row"), ["sheet", "col", "row"], "left_anti")
    carried = down.select("sheet", "col", "row", "near").unionByName(beside.select("sheet", "col", "row", "near")).where("near.formula is not null")
    carried = carried.select("sheet", "row", "col", shifted("near.formula", F.col("row") - F.col("near.row"), F.lit(0)).alias("formula"))

    # What holds a value or a formula is one cell; a style alone changes no content.
    content = written.withColumn("formula", F.lit(None).cast("string")).unionByName(carried.withColumns({"kind": F.lit("number"), "value": F.lit(None).cast("string")}))
    out = content.join(styles, ["sheet", "row", "col"], "full").withColumn("kind", F.coalesce("kind", F.lit("style")))
    result = placed.select("sheet.book", "sheet.sheet", "stem", "row", "updated")
    return out.select("sheet.book", "sheet.sheet", "row", "col", "kind", "value", "formula", "style"), result
