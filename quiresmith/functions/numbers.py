"""Numeric, geometric and page-list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (height up to, width share) of the web copies, and the share beyond the last.
SIZE_BANDS = ((1200, 0.40), (3000, 0.45), (6000, 0.50), (12000, 0.55))
LAST_BAND = 0.60


def half_even(x: Column, scale: int = 0) -> Column:
    """Rounding with halves to the even neighbour."""
    return F.bround(x, scale)


def size_band(height: Column) -> Column:
    """Share of the width that a picture of a height is shrunk to."""
    out = None
    for limit, share in SIZE_BANDS:
        out = F.when(height <= limit, share) if out is None else out.when(height <= limit, share)
    return out.otherwise(LAST_BAND)


def saved_percent(before: Column, after: Column) -> Column:
    """Share of the height that was saved; 0 where there was none."""
    return F.when(before > 0, 100.0 * (before - after) / before).otherwise(0.0)


def pixels(points: Column, dpi: Column) -> Column:
    """Points as pixels."""
    return half_even(points * dpi / 72).cast("int")


def align_offset(inner: Column, outer: Column, align: Column) -> Column:
    """Offset of a part within the larger side: half the rest if centred, all of it at the right or bottom, else 0."""
    rest = outer - inner
    return F.when(align.isin("center", "middle"), F.floor(rest / 2)).when(align.isin("right", "bottom"), rest).otherwise(0).cast("int")


def target_size(width: Column, height: Column, wanted: Column, upscale: bool = False) -> Column:
    """struct(width, height) after fitting to a width; smaller pictures stay unless they may grow."""
    keep = wanted.isNull() | (wanted <= 0) | (width == wanted)
    keep = keep if upscale else keep | (width < wanted)
    scaled = F.greatest(F.lit(1), half_even(height * wanted / width).cast("int"))
    return F.when(keep, F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))).otherwise(F.struct(wanted.cast("int").alias("width"), scaled.alias("height")))


def is_grey(spreads: Column, most: int = 12, share: float = 0.002) -> Column:
    """Whether nearly no pixel has a channel spread above ``most``."""
    odd = F.size(F.filter(spreads, lambda s: s > most))
    return odd < share * F.size(spreads)


def rect_union(a: Column, b: Column) -> Column:
    """The smallest rectangle around two."""
    return F.struct(
        F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1")
    )


def as_shown(rect: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A rectangle of an unrotated page of a width and height, where the page shows it."""
    def made(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))

    turned = F.pmod(rotation, F.lit(360))
    x0, y0, x1, y1 = rect["x0"], rect["y0"], rect["x1"], rect["y1"]
    return (
        F.when(turned == 90, made(height - y1, x0, height - y0, x1))
        .when(turned == 180, made(width - x1, height - y1, width - x0, height - y0))
        .when(turned == 270, made(y0, width - x1, y1, width - x0))
        .otherwise(made(x0, y0, x1, y1))
    )


def page_list(spec: Column, total: Column) -> Column:
    """Zero-based pages of a list such as "4-6,20": sorted, each once, within the document.

    Ends may be swapped and an empty list is every page. A list that leaves no
    page is an error.
    """
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def pages(part: Column) -> Column:
        ends = F.transform(F.split(part, "-"), lambda x: F.trim(x).try_cast("int"))
        low, high = F.array_min(ends), F.array_max(ends)
        low, high = F.greatest(low, F.lit(1)), F.least(high, total)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))
    chosen = F.transform(listed, lambda p: p - 1)
    none = F.raise_error(F.concat(F.lit("no pages are left by "), spec)).cast("array<int>")
    return F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, every).when(F.size(chosen) > 0, chosen).otherwise(none)
