"""Pictures put together and scaled, against a pixel at a time."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quiresmith.operators import bands, canvas, raster
from quiresmith.operators.raster import Settings


def table(spark, images, schema="img string, y int, px binary"):
    return spark.createDataFrame([(*(k if isinstance(k, tuple) else (k,)), y, bytearray(int(v) for v in line)) for k, m in images.items() for y, line in enumerate(m)], schema).repartition(4)


def images_of(df):
    found = {}
    for r in df.collect():
        assert found.setdefault(r["img"], {}).setdefault(r["y"], list(r["px"])) == list(r["px"])
    return {k: np.array([v[y] for y in range(len(v))]) for k, v in found.items()}


def offset(free, align):
    return free // 2 if align in ("center", "middle") else free if align in ("right", "bottom") else 0


def naive_fused(parts, gap, margin, align, across):
    """Parts pasted on white one after the other."""
    if across:
        parts = [p.T for p in parts]
    wide, tall = max(p.shape[1] for p in parts), sum(p.shape[0] for p in parts) + gap * (len(parts) - 1)
    out, y = np.full((tall + 2 * margin, wide + 2 * margin), 255), margin
    for p in parts:
        x = margin + offset(wide - p.shape[1], align)
        out[y : y + p.shape[0], x : x + p.shape[1]] = p
        y += p.shape[0] + gap
    return out.T if across else out


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("align", ["left", "center", "right"])
def test_fused_by_pasting(spark, across, align):
    rng = np.random.default_rng(5)
    pictures = {f"i{k}": [rng.integers(0, 256, (rng.integers(4, 12), rng.integers(4, 15))) for _ in range(1 + k)] for k in range(4)}
    df = table(spark, {(k, 10 * n): p for k, ps in pictures.items() for n, p in enumerate(ps)}, "img string, part int, y int, px binary")
    align = {"left": "top", "center": "middle", "right": "bottom"}[align] if across else align
    for gap, margin in ((3, 2), (0, 0), (-2, 4)):
        got = images_of(canvas.fused(df, gap, margin, align, across))
        assert set(got) == set(pictures)
        for k, ps in pictures.items():
            want = naive_fused(ps, gap, margin, align, across)
            assert got[k].shape == want.shape and (got[k] == want).all(), (k, gap)
    assert canvas.fused(df.where("false"), 3, 2).count() == 0


def naive_scaled(grey, width, height):
    """Each pixel as the sum over its window, lines first, with whole grey levels between."""

    def line(values, to):
        scale = len(values) / to
        wide, out = max(scale, 1.0), []
        for o in range(to):
            c = (o + 0.5) * scale
            total = norm = 0.0
            for x in range(max(0, int(c - 3 * wide + 0.5)), min(len(values), int(c + 3 * wide + 0.5))):
                t = (x + 0.5 - c) / wide
                w = 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3) if abs(t) < 3 else 0.0
                total, norm = total + w * values[x], norm + w
            out.append(min(255, max(0, math.floor(total / norm + 0.5))))
        return out

    across = [line(row, width) for row in grey.tolist()]
    return np.array([line(col, height) for col in zip(*across)]).T


@pytest.mark.parametrize("band", [1, 300, 10**6])
def test_scaled_within_a_grey_level(spark, band):
    rng = np.random.default_rng(7)
    images = {"a": rng.integers(0, 256, (70, 45)), "b": np.where(rng.random((33, 80)) < 0.3, 0, 255), "c": rng.integers(0, 256, (9, 5)), "same": rng.integers(0, 256, (12, 20)), "none": rng.integers(0, 256, (3, 4)), "line": rng.integers(0, 256, (1, 30))}
    sizes = {"a": (20, 31), "b": (120, 50), "c": (3, 2), "same": (20, 12), "line": (11, 4)}
    to = spark.createDataFrame([(k, *v) for k, v in sizes.items()], "img string, to_width int, to_height int")
    got = images_of(canvas.resized(table(spark, images), to, sharpen=False, band_pixels=band))
    assert set(got) == set(images) and (got["same"] == images["same"]).all() and (got["none"] == images["none"]).all()
    for k in ("a", "b", "c", "line"):
        want = naive_scaled(images[k], *sizes[k])
        assert got[k].shape == want.shape and np.abs(got[k] - want).max() <= 1, k
    sharp = images_of(canvas.resized(table(spark, images), to, band_pixels=band))
    assert (sharp["a"] == canvas.sharpened(got["a"].astype(np.uint8))).all() and (sharp["a"] != got["a"]).any()
    assert (sharp["b"] == got["b"]).all()  # it grows


def test_sharpening_a_pixel_at_a_time():
    grey = np.random.default_rng(2).integers(0, 256, (9, 11)).astype(np.uint8)
    taps = [math.exp(-0.5 * k * k) for k in range(-3, 4)]
    taps = [t / sum(taps) for t in taps]
    out = canvas.sharpened(grey)
    for y in range(9):
        for x in range(11):
            blur = sum(taps[i] * taps[j] * float(grey[min(8, max(0, y + i - 3)), min(10, max(0, x + j - 3))]) for i in range(7) for j in range(7))
            off = int(grey[y, x]) - math.floor(blur + 0.5)
            want = min(255, max(0, int(grey[y, x]) + math.trunc(off * 60 / 100))) if abs(off) > 3 else int(grey[y, x])
            assert abs(int(out[y, x]) - want) <= 1


def test_width_policy(spark):
    images = {"wide": np.full((40, 100), 9), "small": np.full((10, 20), 9)}
    shapes = lambda df: {k: m.shape for k, m in images_of(df).items()}
    df = table(spark, images)
    assert shapes(canvas.to_width(df, 50)) == {"wide": (20, 50), "small": (10, 20)}
    assert shapes(canvas.to_width(df, 50, upscale=True)) == {"wide": (20, 50), "small": (25, 50)}
    assert shapes(canvas.to_width(df, 0)) == {"wide": (40, 100), "small": (10, 20)}


def test_built_from_raw_parts(spark):
    rng = np.random.default_rng(3)
    parts = {("i", 1): np.full((40, 60), 255), ("i", 2): np.full((30, 50), 240), ("i", 3): np.full((30, 50), 255), ("j", 1): np.full((20, 20), 255), ("j", 2): np.full((20, 20), 255)}
    parts["i", 1][10:20, 20:50] = np.where(rng.random((10, 30)) < 0.5, 0, 230)
    parts["i", 2][5:25, 10:20] = 30
    s = Settings(padding=2, max_gap=5)
    df = table(spark, parts, "img string, part int, y int, px binary")
    got = images_of(canvas.built(df, s, gap=4, margin=3, align="center"))
    ready = {k: raster.prepared(m, s) for k, m in parts.items()}
    assert (got["i"] == naive_fused([ready["i", 1], ready["i", 2]], 4, 3, "center", False)).all()
    assert (got["j"] == naive_fused([ready["j", 1]], 4, 3, "center", False)).all()  # all blank: the first stays
    one = images_of(canvas.built(df, s, gap=4, margin=3, match=True, width=24))
    assert one["i"].shape[1] == 24 and bands.facts(table(spark, one)).count() > 0
