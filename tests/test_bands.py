"""Banded pixel work against one pixel at a time, for every height of band."""

from __future__ import annotations

import numpy as np
import pytest

from quiresmith.operators import bands, raster
from quiresmith.operators.raster import Settings


def pages(seed, height=150, width=90):
    """Grey images with text, dotted and solid rulings of some thickness, brackets across them, and edge rules."""
    rng = np.random.default_rng(seed)
    grey = np.full((height, width), 255)
    for y in range(8, height - 12, 17):
        kind = rng.integers(0, 6)
        if kind < 2:
            grey[y : y + 7, 5:80] = np.where(rng.random((7, 75)) < 0.4, rng.integers(0, 190, (7, 75)), 255)
        elif kind == 2:
            grey[y : y + 1 + rng.integers(0, 3), 4 : 86 : 2 + rng.integers(0, 2)] = 40
        elif kind == 3:
            grey[y : y + 2, 6:84] = 10
        elif kind == 4:
            grey[y, 3:85:2] = 0
            grey[y : y + 11, 60] = 0
        else:
            grey[y, 4:84:3] = 90
            grey[y + 1, 4:84] = np.where(rng.random(80) < 0.2, 215, 255)
    if seed % 3 == 0:
        grey[30:110, 40] = 0  # a stroke across many lines
    if seed % 2:
        grey[:2] = grey[-3:] = 5
        grey[:, :2] = 0
    return grey


def naive_rulings(grey, s):
    """The rule for rulings, a pixel at a time."""
    height, width = grey.shape
    ink = [[v < s.ink_threshold for v in row] for row in grey.tolist()]
    t = s.answer_line_thickness or max(3, round(width / 220))

    def run(y, x, dy, dx):
        n = 1
        for way in (1, -1):
            a, b = y + way * dy, x + way * dx
            while 0 <= a < height and 0 <= b < width and ink[a][b]:
                n, a, b = n + 1, a + way * dy, b + way * dx
        return n

    tall = {(y, x): run(y, x, 1, 0) for y in range(height) for x in range(width) if ink[y][x]}
    ruled, gone = {}, set()
    for y in range(height):
        places = [x for x in range(width) if ink[y][x]]
        if not places:
            continue
        n, span = len(places), places[-1] - places[0] + 1
        if span < s.answer_line_min_span * width or sum(tall[y, x] <= t for x in places) < 0.8 * n or any(tall[y, x] > 6 * t for x in places):
            continue
        if n / span <= s.answer_line_max_density:
            ruled[y] = "dotted"
        elif s.remove_solid_rules and n / span >= 0.85 and span >= 0.7 * width:
            ruled[y] = "solid"
        gone |= {(y, x) for x in places if y in ruled and tall[y, x] <= t and (ruled[y] == "solid" or run(y, x, 0, 1) <= 1.5 * t)}
    out = grey.copy()
    if gone:
        for y in ruled:
            top = bottom = y
            while top - 1 in ruled:
                top -= 1
            while bottom + 1 in ruled:
                bottom += 1
            if bottom - top <= 2.5 * t:
                kept = {x for x in range(width) for r in range(top, bottom + 1) if ink[r][x] and (r, x) not in gone}
                for x in range(width):
                    if not any(abs(x - k) <= t for k in kept):
                        out[y, x] = 255
    return out


def naive_prepared(grey, s):
    """The steps of a part, each as it is worded."""

    def cut(rows):
        cover, limit, at, done = [float(np.mean(r < s.ink_threshold)) for r in rows], max(1, int(len(rows) * s.edge_line_depth)), 0, 0
        while at < limit:
            while at < limit and cover[at] == 0:
                at += 1
            if at >= limit or cover[at] < s.edge_line_coverage:
                break
            while at < len(rows) and cover[at] >= 0.6 * s.edge_line_coverage:
                at += 1
            done = at
        return done

    top, foot, left, right = cut(grey), cut(grey[::-1]), cut(grey.T), cut(grey.T[::-1])
    if grey.shape[1] - left - right >= 10 and grey.shape[0] - top - foot >= 10:
        grey = grey[top : grey.shape[0] - foot, left : grey.shape[1] - right]
    grey = naive_rulings(grey, s)
    inked = np.argwhere(grey < s.ink_threshold)
    if len(inked):
        (y0, x0), (y1, x1) = inked.min(axis=0), inked.max(axis=0)
        grey = grey[max(0, y0 - s.padding) : y1 + 1 + s.padding, max(0, x0 - s.padding) : x1 + 1 + s.padding]
    keep, y = [], 0
    while y < len(grey):
        stop = y
        while stop < len(grey) and not (grey[stop] < s.ink_threshold).any():
            stop += 1
        gap = list(range(y, stop))
        keep += gap if len(gap) <= s.max_gap else gap[: s.max_gap // 2] + gap[len(gap) - (s.max_gap - s.max_gap // 2) :]
        keep += [stop] if stop < len(grey) else []
        y = stop + 1
    return np.where(grey[keep] >= s.white_from, 255, grey[keep])


def table(spark, images):
    return spark.createDataFrame([(name, y, bytearray(int(v) for v in line)) for name, m in images.items() for y, line in enumerate(m)], "img string, y int, px binary").repartition(5, "y")


def images_of(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["img"], {})[r["y"]] = list(r["px"])
    return {k: np.array([v[y] for y in range(len(v))]) for k, v in found.items()}


@pytest.mark.parametrize("s", [Settings(max_gap=9, padding=3), Settings(remove_solid_rules=True, answer_line_thickness=2, max_gap=4)])
def test_one_image_by_one_pixel_at_a_time(s):
    changed = 0
    for seed in range(14):
        grey = pages(seed)
        assert (raster.without_rulings(grey, s) == naive_rulings(grey, s)).all()
        want = naive_prepared(grey, s)
        got = raster.prepared(grey, s)
        assert got.shape == want.shape and (got == want).all()
        changed += (raster.without_rulings(grey, s) != grey).any()
    assert changed > 6


@pytest.mark.parametrize("lines", [7, 16, 64, 1000])
def test_bands_of_any_height(spark, monkeypatch, lines):
    monkeypatch.setattr(bands, "BAND_LINES", lines)
    monkeypatch.setattr(bands, "BAND_PIXELS", 1)
    images = {f"i{k}": pages(k) for k in range(7)} | {"white": np.full((40, 30), 255), "black": np.zeros((40, 30), int), "line": pages(1)[:1], "light": np.full((50, 60), 230)}
    s = Settings(max_gap=9, padding=3)
    df = table(spark, images)
    got = images_of(bands.erase_rulings(df, s))
    assert set(got) == set(images) and all((got[k] == raster.without_rulings(m, s)).all() for k, m in images.items())
    made = images_of(bands.prepare_parts(df, s))
    assert set(made) == set(images) and all(made[k].shape == raster.prepared(m, s).shape and (made[k] == raster.prepared(m, s)).all() for k, m in images.items())
    assert images_of(bands.prepare_parts(df, s, passthrough=True)).keys() == images.keys()
    assert bands.prepare_parts(df.where("false"), s).count() == bands.erase_rulings(df.where("false"), s).count() == 0


def test_split_pages_and_edges_from_facts(spark):
    rng = np.random.default_rng(6)
    images = {f"i{k}": np.where(rng.random((160, 50)) < 0.25, 0, 255) for k in range(5)}
    for m in images.values():
        m[rng.random(160) < 0.3] = 255
        m[::40, 5:48] = 0
        m[:, 1] = 0 if m[3, 3] else 255
    df = table(spark, images)
    marks = spark.createDataFrame([(k, row, n) for k in images for n, row in enumerate(range(12, 150, 31), 1)] + [("none", 3, 1)], "img string, row int, number int")
    for on_rules in (False, True):
        for keep_head in (False, True):
            got = {(r["img"], r["number"], r["first"], r["stop"]) for r in bands.split_items(df, marks, 1.0, on_rules, keep_head).collect()}
            assert got == {(k, *x) for k, m in images.items() for x in raster.Strip.of(m < 200, 1.0, on_rules).pieces([(row, n) for n, row in enumerate(range(12, 150, 31), 1)], keep_head)}
    got = {tuple(r) for r in bands.pages_of(df, 40).collect()}
    assert got == {(k, *x) for k, m in images.items() for x in raster.paginate(~(m < 200).any(axis=1), 40)}


def test_lines_of_several_widths_are_an_error(spark):
    df = spark.createDataFrame([("a", 0, bytearray(b"\0\0")), ("a", 1, bytearray(b"\0"))], "img string, y int, px binary")
    with pytest.raises(Exception, match="several widths"):
        bands.pages_of(df, 20).collect()


def test_a_band_of_the_largest_page_fits_a_task():
    """A3 at 400 dots an inch and beyond: what a band takes does not grow with the page."""
    import tracemalloc

    width = 11_700
    size, more = bands.halo(width, Settings())
    assert (size + 2 * more) * width < 3 * bands.BAND_PIXELS + 2 * more * width
    grey = np.full((size + 2 * more, width), 255, np.uint8)
    grey[::50, 100:11_000:4] = 0
    tracemalloc.start()
    raster.erased(grey)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * grey.nbytes < 900e6
