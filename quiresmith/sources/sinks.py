"""Writers. Plans give tables; only these touch files, and only when asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.sources import png, xlsx
from quiresmith.sources.schemas import CATALOG

CATALOG_COLUMNS = tuple(c.split()[0] for c in CATALOG.split(", "))


def next_commit(spark: SparkSession, path: str) -> int:
    """The number of a new commit to the log at ``path``, reserved by a marker that is made only if it is not there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    store.mkdirs(folder)
    number = 1 + max((int(f.getPath().getName()) for f in store.listStatus(folder) if f.getPath().getName().isdigit()), default=-1)
    while True:
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}")
        try:
            store.create(marker, False).close()
            return number
        except Exception as taken:
            if not store.exists(marker):
                raise taken
        number += 1


def append_log(rows: DataFrame, path: str) -> int:
    """Add rows to a log of JSON lines, with the number of this commit as ``commit``, which orders them after those of all commits before.

    The number is reserved before anything is written; one whose rows never
    came is skipped. Rows of one commit are in the order of its parts.
    """
    number = next_commit(rows.sparkSession, path)
    rows.drop("commit").withColumn("commit", F.lit(number).cast("long")).write.mode("append").json(path)
    return number


def rewrite_json(rows: DataFrame, path: str) -> None:
    """Replace a JSON table."""
    rows.write.mode("overwrite").json(path)


def write_catalog(rows: DataFrame, path: str) -> None:
    """Replace the catalogue, sorted by question file: parts in order, each with a header."""
    rows.select(*CATALOG_COLUMNS).orderBy("q_filename").write.mode("overwrite").option("header", True).csv(path)


def write_manifest(lines: DataFrame, path: str, *order: str) -> None:
    """Replace a text manifest (value), in ``order``: parts in order."""
    lines.orderBy(*(order or ["value"])).select("value").write.mode("overwrite").text(path)


def write_png(lines: DataFrame, path: str, replace: bool = False, dpi: int = 200) -> None:
    """Write images as PNG files below ``path``, by a commit that shows all of them or none.

    ``lines`` are rows as format ``png`` reads them (``png.ROWS``), or
    rows(img, y, px) of grey images, px a byte for each pixel. With
    ``replace`` an image takes the place of one of its name; otherwise its
    name gets the first free suffix. Lines of an image must be complete, from
    0, each once. Without rows no file is written.
    """
    png.register(lines.sparkSession)
    if "line" not in lines.columns:
        size = lines.groupBy("img").agg((F.max("y") + 1).cast("int").alias("height"), F.max(F.length("px")).alias("width"))
        grey = lines.select("img", F.col("y").cast("int").alias("y"), F.col("px").alias("line")).join(size, "img")
        none = F.lit(None).cast("binary")
        lines = grey.withColumns({"colour": F.lit(0), "depth": F.lit(8), "palette": none, "alpha": none})
    whole = lines.select(*[c.split()[0] for c in png.ROWS.split(", ")]).repartition("img").sortWithinPartitions("img", "y")
    whole.write.format("png").mode("append").option("path", path).option("replace", replace).option("dpi", dpi).save()


def write_cells(cells: DataFrame, path: str, base: str | None = None) -> None:
    """Write cells (``xlsx.CELLS``; place is not needed) to workbooks below ``path``, by a commit that shows all of them or none.

    A workbook of that name below ``base`` (by default ``path``) keeps all
    but these cells; any other is made of them, its sheets in order of name.
    A cell that is written twice ends as either. Workbooks are dealt to
    several tasks a core: cells are few bytes and slow to write, so tasks are
    not put together by their size.
    """
    spark = cells.sparkSession
    xlsx.register(spark)
    tasks = max(32, 4 * spark.sparkContext.defaultParallelism)
    names = [c.split()[0] for c in xlsx.CELLS.split(", ")]
    whole = cells.withColumn("place", F.lit(None).cast("int")).select(*names).repartition(tasks, "book").sortWithinPartitions("book", "sheet", "row", "col")
    whole.write.format("xlsx").mode("append").option("path", path).option("base", base or path).save()
