"""Counts, modes, percentiles and consensus over corpus tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions.numbers import half_even, size_band
from quiresmith.operators.columns import fresh
from quiresmith.operators.relations import texts

#: The share and the number of documents that make a family's shape certain.
SURE, ENOUGH = 0.90, 12


def counts_by(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    """Rows per key, the most first, then by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).orderBy(F.col(out).desc(), *keys)


def fault_counts(rows: DataFrame, harmless: Sequence[str] = ()) -> DataFrame:
    """fault, n over rows(faults), without the harmless ones."""
    left = F.array_except("faults", texts(harmless)) if harmless else F.col("faults")
    return rows.select(F.explode(left).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "fault")


def pictures_by_syllabus(rows: DataFrame, name: str = "name", size: str = "pictures") -> DataFrame:
    """syllabus, papers, pictures of rows(name, pictures)."""
    from quiresmith.functions.names import document_name

    syllabus = F.coalesce(document_name(F.col(name))["syllabus"], F.lit("?"))
    return rows.groupBy(syllabus.alias("syllabus")).agg(F.count(F.lit(1)).alias("papers"), F.sum(size).alias("pictures")).orderBy("syllabus")


def family_shape(items: DataFrame) -> DataFrame:
    """family, questions, share, papers, seen, certain for items(family, paper, number).

    A paper's size is its number of distinct items; a family's shape is the
    size most of its papers have, the smaller on ties.
    """
    # The items of one paper are few, so their set is cheaper than a distinct count and its two more shuffles.
    sizes = items.groupBy("family", "paper").agg(F.size(F.collect_set("number")).cast("long").alias("questions"))
    tally = sizes.groupBy("family", "questions").agg(F.count(F.lit(1)).alias("hits"))
    total = F.sum("hits").over(Window.partitionBy("family"))
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.col("hits").desc(), "questions"))
    seen = F.collect_list(F.struct("questions", "hits")).over(Window.partitionBy("family"))
    best = tally.select("family", "questions", "hits", total.alias("papers"), rank.alias("_rank"), seen.alias("_seen")).where("_rank = 1")
    share = F.col("hits") / F.col("papers")
    return best.select(
        "family",
        "questions",
        F.round(share, 3).alias("share"),
        "papers",
        F.map_from_entries(F.array_sort("_seen")).alias("seen"),
        ((share >= SURE) & (F.col("papers") >= ENOUGH)).alias("certain"),
    )


def agreed_shapes(artifacts: DataFrame) -> DataFrame:
    """Family shapes of artifacts(paper, number), from papers whose two sides hold the same numbers."""
    from quiresmith.functions.names import document_name

    named = artifacts.withColumn("d", document_name(F.col("paper"))).where("d is not null")
    key = F.concat_ws("_", "d.syllabus", "d.session", "d.variant")
    family = F.concat(F.col("d.syllabus"), F.lit("_"), F.left("d.variant", F.lit(1)))
    sides = named.groupBy(key.alias("paper"), family.alias("family")).agg(
        F.array_sort(F.collect_set(F.when(F.col("d.side") == "qp", F.col("number")))).alias("qp"),
        F.array_sort(F.collect_set(F.when(F.col("d.side") == "ms", F.col("number")))).alias("ms"),
    )
    agreed = sides.where((F.size("qp") > 0) & (F.col("qp") == F.col("ms")))
    return family_shape(agreed.select("family", "paper", F.explode("qp").alias("number")))


def size_histogram(pictures: DataFrame, height: str = "height") -> DataFrame:
    """band, n over pictures; bands without any do not show."""
    return pictures.groupBy(size_band(F.col(height)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def status_report(log: DataFrame) -> DataFrame:
    """papers, ok, failed, questions and seconds of a batch log."""
    return log.agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        F.coalesce(F.sum("questions"), F.lit(0)).alias("questions"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
    )


def consensus_edges(edges: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """keys, head, foot: the deepest head and the highest foot (rounded) seen on ``least`` pages or more; 0 where there is none.

    ``edges`` has a page's head and foot edge, or null.
    """
    def agreed(edge: str) -> DataFrame:
        seen = edges.where(F.col(edge).isNotNull()).groupBy(*keys, half_even(F.col(edge)).alias("at")).agg(F.count(F.lit(1)).alias("n"))
        return seen.where(F.col("n") >= least)

    head = agreed("head").groupBy(*keys).agg(F.max("at").alias("head"))
    foot = agreed("foot").groupBy(*keys).agg(F.min("at").alias("foot"))
    every = edges.select(*keys).distinct().join(head, list(keys), "left").join(foot, list(keys), "left")
    return every.select(*keys, F.coalesce("head", F.lit(0.0)).alias("head"), F.coalesce("foot", F.lit(0.0)).alias("foot"))


def repeated_stamps(images: DataFrame, pages: DataFrame, share: float = 0.60, area: float = 0.08) -> DataFrame:
    """doc, page and box of images(doc, page, x0..y1) that most pages(doc, page, width, height) repeat at one place."""
    box = [half_even(F.col(c)).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    sized = images.join(pages.select("doc", "page", "width", "height"), ["doc", "page"])
    small = sized.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= area * F.col("width") * F.col("height"))
    places = small.select("doc", "page", *box).distinct()
    total = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("_pages"))
    often = places.groupBy("doc", "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("_n")).join(total, "doc")
    often = often.where(F.col("_n") >= F.greatest(F.lit(2.0), share * F.col("_pages")))
    return places.join(often.select("doc", "x0", "y0", "x1", "y1"), ["doc", "x0", "y0", "x1", "y1"], "left_semi")


def stratified(df: DataFrame, stratum: str, order: Sequence[str], each: int, most: int) -> DataFrame:
    """Up to ``each`` rows per stratum, taken in rounds, and ``most`` in all."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    own = fresh(df, "_round")
    return df.withColumn(own, rank).where(F.col(own) <= each).orderBy(own, *order).limit(most).drop(own)


def best_by(df: DataFrame, keys: Sequence[str], score: Sequence[Column], seq: str, *columns: str) -> DataFrame:
    """The row of each key with the highest score, field by field; of equals the first by ``seq``."""
    order = F.struct(*(s.alias(f"_{k}") for k, s in enumerate(score)), (-F.col(seq)).alias("_seq"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_best")).select(*keys, "_best.*")
