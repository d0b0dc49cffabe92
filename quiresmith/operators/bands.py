"""Pixel work on images of any size: bands of lines, and facts of lines and columns.

Images are rows(img, y, px), px a byte for each pixel of a line (grey; arrays
of numbers, and ``ink`` arrays of booleans, are packed first). No task holds an
image: lines and columns become facts, whose number grows with an image's
height and width alone, or bands of lines that overlap by as much as a step
looks around, so that each band gives its own lines as the whole image would.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quiresmith.operators.raster import Settings, Strip, box_of, erased, kept_rows, longest_runs, paginate, spread, thickness_of
from quiresmith.operators.sequences import like_neighbours
from quiresmith.session import discard, materialize

#: Pixels of a band, about, and lines at least; lines that a kernel looks at together.
BAND_PIXELS, BAND_LINES, STEP = 4_000_000, 64, 256

_FACT = "img string, y int, width int, ink int, longest int, first int, last int, columns binary"


def _arrow(schema: str) -> pa.Schema:
    """A schema for kernels; made before they run, as it asks the session."""
    return to_arrow_schema(T._parse_datatype_string(schema))


def _hex(values: Column, each: Callable[[Column], Column]) -> Column:
    return F.unhex(F.array_join(F.transform(values, each), ""))


def lines_of(rows: DataFrame) -> DataFrame:
    """img, y, px of rows whose pixels are bytes, an array of grey values, or an array ``ink`` of booleans (black and white)."""
    if "px" not in rows.columns:
        px = _hex(F.col("ink"), lambda v: F.when(v, "00").otherwise("FF"))
    elif isinstance(rows.schema["px"].dataType, T.BinaryType):
        px = F.col("px")
    else:
        px = _hex(F.col("px"), lambda v: F.lpad(F.hex(v.cast("long")), 2, "0"))
    return rows.select("img", F.col("y").cast("int").alias("y"), px.alias("px"))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Images and widths of a batch, a few lines at a time: image, places, pixels, and the rows themselves."""
    for at in range(0, batch.num_rows, STEP):
        some = batch.slice(at, STEP)
        names, lines = some.column("img").to_pylist(), some.column("px").to_pylist()
        kinds = [(n, len(x)) for n, x in zip(names, lines)]
        for kind in dict.fromkeys(kinds):
            mine = [k for k, x in enumerate(kinds) if x == kind]
            pixels = np.frombuffer(b"".join(lines[k] for k in mine), np.uint8).reshape(len(mine), kind[1])
            part = some.take(pa.array(mine))
            yield kind[0], part.column("y").to_numpy(), pixels, part


def facts(rows: DataFrame, threshold: int = 200, without: DataFrame | None = None) -> DataFrame:
    """``_FACT`` of lines(img, y, px): ink, longest run, and first and last ink of each line; rows of y = -1 have counts of ink by column (32 bits), of some lines each.

    ``without``(img, borders: a byte for each column) are columns that do not
    count; then ``longest`` is the number of pieces that a line's ink falls in.
    """

    schema, bordered = _arrow(_FACT), without is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, y, pixels, part in _groups(batch):
                mask, width = pixels < threshold, pixels.shape[1]
                if bordered:
                    mask &= np.frombuffer(part.column("borders")[0].as_py(), np.uint8)[None] == 0
                    opens = mask.copy()
                    opens[:, 1:] &= ~mask[:, :-1]
                    longest = opens.sum(axis=1)
                else:
                    longest = longest_runs(mask)
                n, inked = len(y), mask.any(axis=1)
                first = np.where(inked, mask.argmax(axis=1) if width else 0, -1)
                last = np.where(inked, width - 1 - mask[:, ::-1].argmax(axis=1) if width else 0, -1)
                columns = [None] * n + [mask.sum(axis=0).astype("<i4").tobytes()]
                numbers = ([*y, -1], [width] * (n + 1), [*mask.sum(axis=1), n], [*longest, 0], [*first, 0], [*last, 0])
                yield pa.record_batch([pa.array([img] * (n + 1), pa.string()), *(pa.array(np.array(x, np.int32)) for x in numbers), pa.array(columns, pa.binary())], schema=schema)

    return (rows if without is None else rows.join(without, "img")).mapInArrow(run, _FACT)


class Profile:
    """Facts of an image's lines, in order, and of its columns."""

    def __init__(self, table: pa.Table):
        lines = table.filter(pc.greater_equal(table.column("y"), 0)).sort_by("y")
        self.y, self.ink, self.longest, self.first, self.last = (lines.column(c).to_numpy() for c in ("y", "ink", "longest", "first", "last"))
        self.width = int(lines.column("width")[0].as_py()) if lines.num_rows else 0
        parts = [np.frombuffer(x, "<i4") for x in table.column("columns").to_pylist() if x is not None]
        if any(len(x) != self.width for x in parts):
            raise ValueError(f"lines of image {table.column('img')[0].as_py()} have several widths")
        self.columns = np.sum(parts, axis=0, dtype=np.int64) if parts else np.zeros(0, np.int64)


def _emit(schema: pa.Schema, img: str | None, found: Iterable[tuple]) -> pa.Table:
    out = [(img, *r) for r in found]
    return pa.table({f.name: pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)}, schema=schema)


def per_profile(found: DataFrame, kernel: Callable[[Profile], Iterable[tuple]], schema: str) -> DataFrame:
    """``kernel`` over the facts of each image, as rows of ``schema``, which starts with img. What it holds grows with height and width, not with their product."""
    target = _arrow(schema)
    return found.groupBy("img").applyInArrow(lambda key, table: _emit(target, key[0].as_py(), kernel(Profile(table))), schema)


def borders(found: DataFrame, least_height: int = 0, by: int = 0) -> DataFrame:
    """img, borders: columns that are ink over most of the height, and ``by`` columns either way; none in images of up to ``least_height`` lines."""

    def kernel(p: Profile) -> Iterable[tuple]:
        flags = spread(p.columns > 0.5 * len(p.y), by) & (len(p.y) > least_height)
        return [(flags.astype(np.uint8).tobytes(),)]

    return per_profile(found, kernel, "img string, borders binary")


def cut_edges(rows: DataFrame, pieces: tuple[int, int] = (10, 150), least: float = 0.8, threshold: int = 200) -> DataFrame:
    """img, top, foot: how much of a full line the first and the last inked row carry, where they look cut.

    A row through a line's middle falls in as many pieces as letters have
    strokes, has the ink of the rows further in, and about that of the fullest
    rows; any other edge counts 0. Columns that are ink over most of a height
    beyond twenty rows do not count. Images without ink have no row.
    """
    lines = lines_of(rows)
    inner = facts(lines, threshold, borders(facts(lines, threshold), 20)).where("y >= 0").select("img", "y", F.col("ink").alias("ink_count"), F.col("longest").alias("pieces"))
    for inward, order in (("_down", "y"), ("_up", F.col("y").desc())):
        inner = like_neighbours(inner, ["img"], [order], "ink_count").withColumnRenamed("like_inward", inward)
    image = Window.partitionBy("img")
    inked = F.when(F.col("ink_count") > 0, F.col("ink_count"))
    share = F.col("ink_count") / F.percentile(inked, F.lit(0.98)).over(image)
    fit = F.col("pieces").between(*pieces) & (share >= least)
    edge = inner.withColumns({"_top": F.when(fit & F.col("_down"), share).otherwise(0.0), "_foot": F.when(fit & F.col("_up"), share).otherwise(0.0)}).where("ink_count > 0")
    ends = edge.groupBy("img").agg(F.min_by("_top", "y").alias("top"), F.max_by("_foot", "y").alias("foot"), F.count(F.lit(1)).alias("_n"))
    return ends.select("img", "top", F.when(F.col("_n") == 1, F.col("top")).otherwise(F.col("foot")).alias("foot"))


def pages_of(rows: DataFrame, page_rows: int, threshold: int = 200) -> DataFrame:
    """img, first, stop of the pages of every image."""
    return per_profile(facts(lines_of(rows), threshold), lambda p: paginate(p.ink == 0, page_rows), "img string, first int, stop int")


def split_items(rows: DataFrame, marks: DataFrame, scale: float, on_rules: bool, keep_head: bool, threshold: int = 200) -> DataFrame:
    """img, number, first, stop of the items of every image, at marks(img, row, number).

    Images without marks and marks without an image have no items.
    """
    lines = lines_of(rows)
    found = facts(lines, threshold)
    inner = facts(lines, threshold, borders(found, 0, 3)).where("y >= 0").select("img", "y", F.col("ink").alias("inner"))
    both = found.where("y >= 0").select("img", "y", "width", "ink", "longest").join(inner, ["img", "y"])
    schema = "img string, number int, first int, stop int"
    target = _arrow(schema)

    def run(key: tuple[pa.Scalar, ...], image: pa.Table, asked: pa.Table) -> pa.Table:
        if not image.num_rows or not asked.num_rows:
            return _emit(target, None, [])
        image, asked = image.sort_by("y"), asked.sort_by([("row", "ascending"), ("number", "ascending")])
        width, ink, longest, inside = (image.column(c).to_numpy() for c in ("width", "ink", "longest", "inner"))
        strip = Strip.from_facts(ink, longest, inside, int(width[0]), scale, on_rules)
        return _emit(target, key[0].as_py(), strip.pieces(list(zip(asked.column("row").to_pylist(), asked.column("number").to_pylist())), keep_head))

    return both.groupBy("img").cogroup(marks.select("img", "row", "number").groupBy("img")).applyInArrow(run, schema)


def halo(width: int, s: Settings) -> tuple[int, int]:
    """Lines of a band, and how many more of either side it needs for rulings.

    A ruling is at most 2.5 times a stroke's thickness tall, and whether a line
    is one depends on strokes up to 6 times that; so no run that reaches
    further changes anything.
    """
    t = thickness_of(width, s)
    return max(BAND_LINES, BAND_PIXELS // max(1, width)), math.ceil(2.5 * t) + 6 * t + 2


def erase_rulings(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """img, y, px (bytes) of every image of rows(img, y, px) without its answer rulings."""
    lines = lines_of(rows)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for y, px in zip(batch.column("y").to_pylist(), batch.column("px")):
                size, more = halo(len(px.as_buffer()), s)
                parts.append(list(range(max(0, y - more) // size, (y + more) // size + 1)))
            yield pa.record_batch([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], [*batch.schema.names, "bands"])

    dealt = lines.mapInArrow(reach, "img string, y int, px binary, bands array<int>").select("img", "y", "px", F.explode("bands").alias("band"))

    def banded(of: DataFrame, give: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterable[tuple]], schema: str) -> DataFrame:
        target = _arrow(schema)

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by("y")
            y, px = table.column("y").to_numpy(), table.column("px").to_pylist()
            grey = np.frombuffer(b"".join(px), np.uint8).reshape(len(px), -1)
            mine = y // halo(grey.shape[1], s)[0] == key[1].as_py()
            if not mine.any():
                return _emit(target, None, [])
            out, gone = erased(grey, s)
            return _emit(target, key[0].as_py(), give(y[mine], grey[mine], out[mine], gone[mine]))

        return of.groupBy("img", "band").applyInArrow(run, schema)

    # Only an image that has ink to lose anywhere is changed; then lightly grey pixels of its rulings go as well.
    changed = banded(dealt, lambda y, grey, out, gone: [(True,)] if gone.any() else [], "img string, some boolean").distinct().select("img")
    cleaned = banded(dealt.join(changed, "img", "left_semi"), lambda y, grey, out, gone: zip(y.tolist(), (x.tobytes() for x in out)), "img string, y int, px binary")
    return lines.join(changed, "img", "left_anti").unionByName(cleaned)


def _cut(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """img, y, px of lines in kept(img, y, to, left, width), cut to its columns and numbered anew."""
    return lines.join(kept, ["img", "y"]).select("img", F.col("to").alias("y"), F.substring("px", F.col("left") + 1, F.col("width")).alias("px"))


_KEPT = "img string, y int, to int, left int, width int"


def prepare_parts(rows: DataFrame, s: Settings = Settings(), passthrough: bool = False) -> DataFrame:
    """img, y, px (bytes) of every image of rows(img, y, px), made ready: edge rules, rulings, white margins and gaps go, in this order, and near white becomes white."""
    lines = lines_of(rows)
    if passthrough:
        return lines

    def shaved(p: Profile) -> Iterable[tuple]:
        left, top, right, foot = box_of(p.ink / max(1, p.width), p.columns / max(1, len(p.y)), s)
        return [(y, y - top, left, right - left) for y in range(top, foot)]

    def trimmed(p: Profile) -> Iterable[tuple]:
        inked, columns = np.flatnonzero(p.ink), np.flatnonzero(p.columns)
        top, foot, left, right = 0, len(p.y), 0, p.width
        if len(inked):
            top, foot = max(0, int(inked[0]) - s.padding), min(foot, int(inked[-1]) + 1 + s.padding)
            left, right = max(0, int(columns[0]) - s.padding), min(right, int(columns[-1]) + 1 + s.padding)
        kept = top + np.flatnonzero(kept_rows(p.ink[top:foot] == 0, s.max_gap))
        return [(int(y), k, left, right - left) for k, y in enumerate(kept)]

    # Each phase reads its lines several times, so they are written once.
    within = materialize(_cut(lines, per_profile(facts(lines, s.ink_threshold), shaved, _KEPT)), "part-within")
    clean = materialize(erase_rulings(within, s), "part-clean")
    discard(within)
    out = _cut(clean, per_profile(facts(clean, s.ink_threshold), trimmed, _KEPT))
    white = bytes(255 if v >= s.white_from else v for v in range(256))

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x.translate(white) for x in batch.column(2).to_pylist()], pa.binary())], ["img", "y", "px"])

    return out.mapInArrow(whiten, "img string, y int, px binary")

