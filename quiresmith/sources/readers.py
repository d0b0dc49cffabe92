"""Scans: files, logs, catalogues, cells and lists, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.functions.names import artifact
from quiresmith.operators.relations import first_by, header_columns, last_by
from quiresmith.sources import png, schemas, xlsx


def _file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def inventory(spark: SparkSession, root: str, pattern: str = "*.pdf", only: str | None = None) -> DataFrame:
    """path, name (stem), bytes of the files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    out = files.select("path", F.regexp_replace(_file(F.col("path")), r"\.[^.]*$", "").alias("name"), F.col("length").alias("bytes"))
    return out.where(F.col("name").contains(only)) if only else out


def artifacts(files: DataFrame, set_aside: Sequence[str] = (), web_suffix: str = "_web") -> DataFrame:
    """folder, file, paper, number, bytes of inventory rows that are item pictures in the working set.

    Pictures need a number; folders that end in ``web_suffix`` and those below
    a set-aside folder are left out.
    """
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    found = files.withColumn("_a", artifact(F.col("name"))).where("_a.number is not null")
    kept = found.where(~F.element_at(folders, -1).endswith(web_suffix))
    if set_aside:
        kept = kept.where(~F.arrays_overlap(folders, F.array(*map(F.lit, set_aside))))
    return kept.select(F.element_at(folders, -1).alias("folder"), _file(F.col("path")).alias("file"), "_a.paper", "_a.number", "bytes")


def located(names: DataFrame, files: DataFrame) -> DataFrame:
    """name, path of wanted names that are in the inventory: the first path of each."""
    return first_by(files.join(names.select("name").distinct(), "name", "left_semi"), ["name"], "path").select("name", "path")


def _written() -> Column:
    """An order of a file scan's rows: files as they were written, and their rows as they stand."""
    at = F.col("_metadata")
    return F.struct(at["file_modification_time"].alias("at"), at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))


def _in_turn(commit: Column, written: Column) -> Column:
    """The order of a log's rows: by the number of their commit; those without one come first, as their files were written."""
    return F.struct(F.coalesce(commit, F.lit(-1)).alias("commit"), F.when(commit.isNull(), written["at"]).alias("at"), *(written[c].alias(c) for c in ("file", "block", "row")))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON documents that hold arrays, with ``ord``, their place."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("*", _written().alias("ord"))


def log_lines(spark: SparkSession, path: str, schema: str, key: str, strict: bool = False) -> DataFrame:
    """Rows of a log of JSON lines, the last of each key by number of commit. Lines that do not parse go, or end a strict scan."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    lines = spark.read.text(path)
    lines = lines.select("value", _written().alias("ord")).where(F.trim("value") != "")
    bad = ", commit long" + ("" if strict else ", _bad string")
    parsed = lines.select(F.from_json("value", schema + bad, {"mode": mode, "columnNameOfCorruptRecord": "_bad"}).alias("r"), "ord").select("r.*", "ord")
    parsed = parsed.withColumn("ord", _in_turn(F.col("commit"), F.col("ord"))).drop("commit")
    if not strict:
        parsed = parsed.where("_bad is null").drop("_bad")
    return last_by(parsed.where(F.col(key).isNotNull()), [key], "ord")


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the catalogue file, with ``stem``, their key; a byte-order mark is dropped."""
    from quiresmith.functions.strings import picture_stem

    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.withColumn("stem", picture_stem(F.coalesce(F.col("q_filename"), F.col("ms_filename"))))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """sheet, row and the catalogue's columns of the rows below the best header of cells(sheet, row, col, value)."""
    header = header_columns(cells, schemas.HEADINGS)
    heads = header.select("sheet", F.col("row").alias("_head"), "field", "col")
    body = cells.join(heads, ["sheet", "col"]).where(F.col("row") > F.col("_head"))
    return body.groupBy("sheet", "row").pivot("field", list(schemas.HEADINGS)).agg(F.first("value")).where(F.coalesce("q_filename", "ms_filename", "subject").isNotNull())


def last_data_row(rows: DataFrame) -> DataFrame:
    """sheet, row of the last row with any value."""
    return rows.groupBy("sheet").agg(F.max("row").alias("row"))


def tokens(spark: SparkSession, *paths: str) -> DataFrame:
    """name: the distinct words of text files."""
    words = spark.read.text(list(paths)).select(F.explode(F.split("value", r"\s+")).alias("name"))
    return words.where("name <> ''").distinct()


def png_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the PNG images below ``root``, as ``png.ROWS``; ``png.greys`` makes grey values of them."""
    png.register(spark)
    return spark.read.format("png").load(root)


def cells(spark: SparkSession, root: str) -> DataFrame:
    """Cells of the workbooks below ``root``, as ``xlsx.CELLS``."""
    xlsx.register(spark)
    return spark.read.format("xlsx").load(root)


def images(spark: SparkSession, root: str) -> DataFrame:
    """img, y, px (grey values) of images of other formats below ``root``, by Spark's image source; transparency lies on white."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.*")
    step = F.col("nChannels") * F.col("width")
    rows = raw.select(F.col("origin").alias("img"), "nChannels", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.substring("data", (y * step + 1).cast("int"), step.cast("int")))).alias("y", "line"))

    def at(line: Column, k: Column) -> Column:
        return F.conv(F.hex(F.substring(line, k.cast("int"), F.lit(1))), 16, 10).cast("int")

    def grey(x: Column) -> Column:
        base, n = x * F.col("nChannels") + 1, F.col("nChannels")
        line = F.col("line")
        mono = at(line, base)
        colour = F.round(0.114 * at(line, base) + 0.587 * at(line, base + 1) + 0.299 * at(line, base + 2)).cast("int")
        solid = at(line, base + 3) / 255.0
        return F.when(n == 1, mono).when(n == 3, colour).otherwise(F.round(colour * solid + 255 * (1 - solid)).cast("int"))

    places = F.sequence(F.lit(0), (F.length("line") / F.col("nChannels")).cast("int") - 1)
    return rows.select("img", "y", F.transform(places, grey).alias("px"))


def working_files(files: DataFrame, done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Inventory rows still to do: no second downloads, none done, in order, and no more than ``limit``."""
    from quiresmith.operators.relations import without, without_copies

    left = without_copies(files)
    left = without(left, done, "path") if done is not None else left
    left = left.orderBy("path")
    return left.limit(limit) if limit else left
