"""Pictures put together and scaled, of any size: lines come together by their place on a canvas, and scaling works on bands of lines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresmith.functions.numbers import target_size
from quiresmith.operators.bands import BAND_PIXELS, STEP, facts, lines_of, prepare_parts
from quiresmith.operators.raster import Settings, kept_parts, matched, stacked
from quiresmith.session import materialize

#: Reach of the scaling filter, and radius, share and threshold of the sharpening.
REACH, RADIUS, PERCENT, THRESHOLD = 3, 1.0, 60, 3
#: Lines on either side that sharpening looks at.
HALO = 3


def _white(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("FF"), F.greatest(F.lit(0), n).cast("int")))


def fused(parts: DataFrame, gap: int = 22, margin: int = 18, align: str = "left", across: bool = False, match: bool = False) -> DataFrame:
    """img, y, px of each picture made of the parts of rows(img, part, y, px), in order of part, one below the other or side by side.

    ``gap`` lies between parts and ``margin`` around them; what does not reach
    is white on the side that ``align`` leaves; with ``match`` parts are first
    scaled to the widest, or the tallest. Where parts overlap (a gap below
    zero) the later one is on top. px is a byte for each pixel; an empty table
    gives no rows. Lines meet by their place, so no task holds a picture.
    """
    lines = parts.select("img", "part", F.col("y").cast("int").alias("y"), "px")
    sizes = lines.groupBy("img", "part").agg(F.max(F.length("px")).alias("width"), (F.max("y") + 1).alias("height"))
    if match:
        sizes = matched(sizes, ["img"], across)
        key = F.to_json(F.struct("img", "part")).alias("img")
        sizes = materialize(sizes, "part-sizes")
        scaled = resized(lines.select(key, "y", "px"), sizes.select(key, F.col("width").alias("to_width"), F.col("height").alias("to_height")), sharpen=False)
        scaled = materialize(scaled, "parts-scaled")
        lines = scaled.withColumnRenamed("img", "key").join(sizes.select("img", "part", key.alias("key")), "key").drop("key")
    layout = stacked(sizes, ["img"], "part", gap, margin, align, across)
    placed = lines.join(layout.select("img", "part", "x", F.col("y").alias("top"), "canvas_width"), ["img", "part"])
    placed = placed.select("img", (F.col("top") + F.col("y")).cast("int").alias("y"), "canvas_width", F.struct("part", F.col("x").cast("int").alias("x"), "px").alias("piece"))
    bare = layout.groupBy("img").agg(F.first("canvas_width").alias("canvas_width"), F.first("canvas_height").alias("canvas_height"))
    bare = bare.select("img", F.explode(F.sequence(F.lit(0), F.col("canvas_height").cast("int") - 1)).alias("y"), "canvas_width")
    whole = placed.unionByName(bare, allowMissingColumns=True).groupBy("img", "y").agg(F.first("canvas_width").alias("width"), F.array_sort(F.collect_list("piece")).alias("pieces"))

    def put(line: Column, piece: Column) -> Column:
        x, end = piece["x"], piece["x"] + F.length(piece["px"])
        head = F.concat(F.substring(line, F.lit(1), x), _white(x - F.length(line)))
        return F.concat(head, piece["px"], F.when(F.length(line) > end, F.substring(line, end + 1, F.length(line) - end)).otherwise(F.unhex(F.lit(""))))

    line = F.aggregate("pieces", F.unhex(F.lit("")), put)
    return whole.select("img", "y", "width", line.alias("line")).select("img", "y", F.concat("line", _white(F.col("width") - F.length("line"))).alias("px"))


@lru_cache(maxsize=64)
def weights(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``to`` places the first of the ``size`` places it is made of, and their weights: a windowed sinc, as wide as the picture shrinks, whose weights add up to one."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    first = np.maximum(0, (centre - REACH * wide + 0.5).astype(int))
    past = np.minimum(size, (centre + REACH * wide + 0.5).astype(int))
    at = first[:, None] + np.arange((past - first).max())
    x = (at + 0.5 - centre[:, None]) / wide
    w = np.where((at < past[:, None]) & (np.abs(x) < REACH), np.sinc(x) * np.sinc(x / REACH), 0.0)
    return first, w / w.sum(axis=1, keepdims=True)


def scaled_columns(pixels: np.ndarray, to: int) -> np.ndarray:
    """Lines scaled to a width."""
    first, w = weights(pixels.shape[1], to)
    out = np.zeros((len(pixels), to))
    for k in range(w.shape[1]):
        out += pixels[:, np.minimum(first + k, pixels.shape[1] - 1)] * w[:, k]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def scaled_rows(pixels: np.ndarray, start: int, height: int, to: int, low: int, high: int) -> np.ndarray:
    """Lines ``low`` to ``high`` of a picture of ``height`` lines scaled to ``to``; ``pixels`` are those from ``start`` on."""
    first, w = weights(height, to)
    out = np.zeros((high - low, pixels.shape[1]))
    for k in range(w.shape[1]):
        at = np.clip(first[low:high] + k - start, 0, len(pixels) - 1)  # beyond a window the weight is 0
        out += pixels[at] * w[low:high, k, None]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def sharpened(pixels: np.ndarray) -> np.ndarray:
    """A picture with its differences from a blurred one enlarged, where they are not slight."""
    taps = np.exp(-0.5 * (np.arange(-HALO, HALO + 1) / RADIUS) ** 2)
    taps /= taps.sum()
    height, width = pixels.shape
    wide = np.pad(pixels.astype(float), HALO, mode="edge")
    wide = sum(t * wide[:, k : k + width] for k, t in enumerate(taps))
    blurred = np.floor(sum(t * wide[k : k + height] for k, t in enumerate(taps)) + 0.5)
    off = pixels - blurred
    more = np.clip(pixels + np.trunc(off * PERCENT / 100), 0, 255)
    return np.where(np.abs(off) > THRESHOLD, more, pixels).astype(np.uint8)


def resized(rows: DataFrame, sizes: DataFrame, sharpen: bool = True, band_pixels: int = BAND_PIXELS) -> DataFrame:
    """img, y, px of pictures scaled to sizes(img, to_width, to_height); those of that size, and those without one, stay as they are.

    First all lines are scaled, then all columns, in bands of lines that know
    the lines around that they are made of. Pictures that shrink are
    sharpened after, if asked for.
    """
    lines = lines_of(rows)
    have = lines.groupBy("img").agg((F.max("y") + 1).alias("height"), F.max(F.length("px")).alias("width"))
    change = have.join(sizes.select("img", F.col("to_width").cast("int"), F.col("to_height").cast("int")), "img").where("to_width <> width or to_height <> height")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                px, to, height, to_height, y = (some.column(c).to_pylist() for c in ("px", "to_width", "height", "to_height", "y"))
                out, bands = [b""] * len(px), []
                for kind in set(zip(map(len, px), to)):
                    mine = [k for k in range(len(px)) if (len(px[k]), to[k]) == kind]
                    made = scaled_columns(np.frombuffer(b"".join(px[k] for k in mine), np.uint8).reshape(len(mine), kind[0]), kind[1])
                    for k, line in zip(mine, made):
                        out[k] = line.tobytes()
                for k in range(len(px)):
                    scale, size = height[k] / to_height[k], _band_lines(to[k], band_pixels)
                    reach = REACH * max(scale, 1.0) + 1
                    low, high = math.floor((y[k] - reach) / scale) - HALO - 1, math.ceil((y[k] + reach) / scale) + HALO + 1
                    bands.append(list(range(max(0, low) // size, min(max(0, high), to_height[k] - 1) // size + 1)))
                yield pa.record_batch([some.column("img"), some.column("y"), some.column("height"), some.column("to_height"), pa.array(out, pa.binary()), pa.array(bands, pa.list_(pa.int32()))], ["img", "y", "height", "to_height", "px", "bands"])

    shrinks = F.col("to_width") < F.col("width")
    dealt = lines.join(change, "img").select("img", "y", "px", "to_width", "height", "to_height", shrinks.alias("shrinks"))
    wide = dealt.mapInArrow(across, "img string, y int, height int, to_height int, px binary, bands array<int>").withColumn("band", F.explode("bands")).drop("bands")
    wide = wide.join(change.select("img", shrinks.alias("shrinks")), "img")

    def down(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        y, px = table.column("y").to_numpy(), table.column("px").to_pylist()
        height, to, band = table.column("height")[0].as_py(), table.column("to_height")[0].as_py(), key[1].as_py()
        pixels = np.frombuffer(b"".join(px), np.uint8).reshape(len(px), -1)
        size = _band_lines(pixels.shape[1], band_pixels)
        low, high = band * size, min(to, band * size + size)
        first, last = max(0, low - HALO), min(to, high + HALO)
        made = scaled_rows(pixels, int(y[0]), height, to, first, last)
        if sharpen and table.column("shrinks")[0].as_py():
            made = sharpened(made)
        made = made[low - first : high - first]
        return pa.table({"img": pa.array([key[0].as_py()] * len(made), pa.string()), "y": pa.array(np.arange(low, high, dtype=np.int32)), "px": pa.array([x.tobytes() for x in made], pa.binary())})

    done = wide.groupBy("img", "band").applyInArrow(down, "img string, y int, px binary")
    return lines.join(change.select("img"), "img", "left_anti").unionByName(done)


def _band_lines(width: int, pixels: int) -> int:
    return max(16, pixels // max(1, width))


def to_width(rows: DataFrame, width: int, upscale: bool = False, sharpen: bool = True) -> DataFrame:
    """Pictures fitted to a width; smaller ones stay unless they may grow, and 0 keeps every one."""
    lines = lines_of(rows)
    have = lines.groupBy("img").agg((F.max("y") + 1).alias("height"), F.max(F.length("px")).alias("width"))
    size = target_size(F.col("width"), F.col("height"), F.lit(width), upscale)
    return resized(lines, have.select("img", size["width"].alias("to_width"), size["height"].alias("to_height")), sharpen)


def built(parts: DataFrame, s: Settings = Settings(), gap: int = 22, margin: int = 18, align: str = "left", across: bool = False, match: bool = False, width: int = 0) -> DataFrame:
    """img, y, px of each picture from its raw parts(img, part, y, px): parts are made ready, blank ones dropped (but for the first where all are), put together, and fitted to a width."""
    key = F.to_json(F.struct("img", "part"))
    keyed = parts.select("img", "part", key.alias("key"), "y", "px")
    # Each phase reads its lines several times, so they are written once.
    ready = materialize(prepare_parts(keyed.select(F.col("key").alias("img"), "y", "px"), s), "parts-ready")
    ink = facts(ready, s.ink_threshold).where("y >= 0").select("img", F.col("ink").alias("ink_count"))
    blank = ink.groupBy("img").agg((F.sum("ink_count") == 0).alias("blank")).withColumnRenamed("img", "key")
    names = materialize(keyed.select("img", "part", "key").distinct().join(blank, "key"), "parts-blank")
    kept = kept_parts(names, ["img"], "part", "blank").select("img", "part", "key")
    lines = ready.withColumnRenamed("img", "key").join(kept, "key").select("img", "part", "y", "px")
    whole = materialize(fused(lines, gap, margin, align, across, match), "pictures")
    return to_width(whole, width) if width > 0 else whole
