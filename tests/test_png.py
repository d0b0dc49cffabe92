"""PNG as a table: images of all kinds, by all filters, written and read back; damaged files; names at the commit."""

from __future__ import annotations

import io
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiresmith.sources import png, readers, sinks

KINDS = [(c, d) for c, depths in png.DEPTHS.items() for d in depths]


def naive_filter(kind, x, above, step):
    """One line under one filter, a byte at a time, as the format words it."""
    out = []
    for k, v in enumerate(x):
        a = x[k - step] if k >= step else 0
        b, c = above[k], above[k - step] if k >= step else 0
        p = a + b - c
        paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
    return bytes([kind, *out])


def naive_png(head, lines, rng, interlaced=False):
    """A file with filters at random and its data in several chunks."""
    data = b""
    for width, part in lines:
        above = [0] * head.line_bytes(width)
        for line in part:
            data += naive_filter(rng.randrange(5), list(line), above, head.step)
            above = list(line)
    packed = zlib.compress(data)
    cut = len(packed) // 2
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", head.width, head.height, head.depth, head.colour, 0, 0, interlaced)), (b"gAMA", struct.pack(">I", 45455))]
    chunks += [(n, d) for n, d in ((b"PLTE", head.palette), (b"tRNS", head.alpha)) if d is not None]
    return png.SIGNATURE + b"".join(png._chunk(n, d) for n, d in [*chunks, (b"IDAT", packed[:cut]), (b"IDAT", packed[cut:]), (b"tEXt", b"k\0v"), (b"IEND", b"")])


def image(colour, depth, seed=1, width=13, height=11):
    rng = np.random.default_rng(seed)
    palette = rng.integers(0, 256, 3 * (1 << min(depth, 8))).astype(np.uint8).tobytes() if colour == 3 else None
    head = png.Header(width, height, colour, depth, False, palette, bytes([0, 128]) if colour == 3 else None)
    values = rng.integers(0, 1 << depth, (height, width, png.SAMPLES[colour]))
    return head, values, png.packed(values, depth)


@pytest.mark.parametrize(("colour", "depth"), KINDS)
def test_decode_all_kinds(colour, depth, monkeypatch):
    rng = random.Random(depth)
    head, values, lines = image(colour, depth)
    assert np.array_equal(png.samples(lines, 13, colour, depth), values)
    for band in (256, 3):
        monkeypatch.setattr(png, "BAND_LINES", band)
        found = list(png.decode(io.BytesIO(naive_png(head, [(13, [x.tobytes() for x in lines])], rng))))
        assert np.array_equal(np.concatenate([x for _, _, x in found]), lines) and found[0][0] == head
        assert [y for _, y, _ in found] == list(range(0, 11, band))
    passes = []
    for x, y, right, down in png.PASSES:
        part = values[y::down, x::right]
        if part.size:
            passes.append((part.shape[1], [p.tobytes() for p in png.packed(part, depth)]))
    found = list(png.decode(io.BytesIO(naive_png(head, passes, rng, True))))
    assert np.array_equal(np.concatenate([x for _, _, x in found]), lines)
    out = io.BytesIO()
    coder = png.Encoder(out, head)
    for y, line in enumerate(lines):
        coder.add(y, line.tobytes())
    coder.close()
    out.seek(0)
    assert np.array_equal(np.concatenate([x for _, _, x in png.decode(out)]), lines)


def test_filters_are_those_of_the_format():
    rng = np.random.default_rng(3)
    for step in (1, 2, 3, 4, 6, 8):
        lines, above = rng.integers(0, 256, (9, 6 * step)).astype(np.uint8), rng.integers(0, 256, 6 * step).astype(np.uint8)
        lines[4:] = lines[4] // 2 + np.arange(6 * step, dtype=np.uint8)
        data = np.frombuffer(png.filtered(lines, above, step, False), np.uint8).reshape(9, -1)
        before = above
        for row, line in zip(data, lines):
            assert row.tobytes() == naive_filter(int(row[0]), line.tolist(), before.tolist(), step)
            before = line
        assert np.array_equal(png.unfiltered(data[:, 0], data[:, 1:], above, step), lines)


def test_damaged_files_end_with_the_reason():
    head, _, lines = image(2, 8)
    good = naive_png(head, [(13, [x.tobytes() for x in lines])], random.Random(1))
    for bad, reason in ((b"GIF89a" + good, "not a PNG"), (good[:60], "ends early"), (good[:-30], "ends early|damaged|missing"), (good[:20] + b"\x01" + good[21:], "damaged|no PNG"), (good.replace(b"IDAT", b"jDAT"), "no image data|damaged")):
        with pytest.raises((ValueError, zlib.error), match=reason):
            list(png.decode(io.BytesIO(bad)))


def test_write_and_read(spark, tmp_path):
    rows, want = [], {}
    for k, (colour, depth) in enumerate(KINDS):
        head, _, lines = image(colour, depth, seed=k, width=5 + k, height=3 + 7 * (k % 3))
        name = f"set{k % 2}/p_{colour}_{depth}"
        for y, line in enumerate(lines):
            rows.append((name, y, head.width, head.height, colour, depth, head.palette, head.alpha, line.tobytes()))
            want[name, y] = line.tobytes()
    df = spark.createDataFrame(rows, png.ROWS).repartition(7, "y")
    root = f"file://{tmp_path}/images"
    sinks.write_png(df, root)
    got = readers.png_lines(spark, root)
    assert {(r["img"], r["y"]): bytes(r["line"]) for r in got.collect()} == want
    assert {tuple(r) for r in got.drop("line", "y").distinct().collect()} == {tuple(r) for r in df.drop("line", "y").distinct().collect()}
    # Names that are taken get suffixes; with ``replace`` the image is a new one.
    one = df.where("img = 'set0/p_0_1'")
    sinks.write_png(one, root)
    sinks.write_png(one, root)
    sinks.write_png(one.withColumn("img", F.lit("set1/p_0_2")), root, replace=True)
    files = {os.path.relpath(os.path.join(d, f), tmp_path / "images") for d, _, names in os.walk(tmp_path / "images") for f in names if not f.endswith(".crc")}
    assert files == {f"set{k % 2}/p_{c}_{d}.png" for k, (c, d) in enumerate(KINDS)} | {"set0/p_0_1-2.png", "set0/p_0_1-3.png"}
    assert readers.png_lines(spark, root).where("img = 'set1/p_0_2'").count() == one.count()
    assert [r["img"] for r in readers.png_lines(spark, f"{root}/set0/p_0_1.png").select("img").distinct().collect()] == ["p_0_1"]
    # An image with a line missing writes nothing at all.
    with pytest.raises(Exception, match="not the next one|missing"):
        sinks.write_png(df.where("y <> 1"), f"file://{tmp_path}/broken")
    assert not [f for _, _, names in os.walk(tmp_path / "broken") for f in names]
    sinks.write_png(df.where("false"), f"file://{tmp_path}/none")


def test_greys_lie_on_white(spark, tmp_path):
    rgba = [(0, 0, 0, 0), (0, 0, 0, 255), (255, 0, 0, 255), (10, 20, 30, 128)]
    rows = [("a", 0, 4, 1, 6, 8, None, None, bytes(v for p in rgba for v in p)), ("b", 0, 4, 1, 3, 2, bytes([0, 0, 0, 255, 255, 255, 0, 0, 255, 9, 9, 9]), bytes([255, 255, 0]), bytes([0b00011011])), ("c", 0, 2, 1, 0, 16, None, None, bytes([1, 255, 200, 0])), ("d", 0, 3, 1, 0, 2, None, None, bytes([0b00011100]))]
    found = {r["img"]: list(r["px"]) for r in png.greys(spark.createDataFrame(rows, png.ROWS)).collect()}
    assert found["a"][:3] == [255, 0, 76] and found["a"][3] == round(0.299 * 132 + 0.587 * 137 + 0.114 * 142)
    assert found["b"] == [0, 255, 255, 9] and found["c"] == [1, 200] and found["d"] == [0, 85, 255]


def test_lines_of_a_large_image_come_in_bands():
    head = png.Header(4000, 1500, 2, 8)
    rng = np.random.default_rng(2)
    line = np.cumsum(rng.integers(-2, 3, 12_000)).astype(np.uint8)
    out = io.BytesIO()
    coder = png.Encoder(out, head, level=1)
    for y in range(1500):
        coder.add(y, (line + y // 3 % 256).astype(np.uint8).tobytes())
    coder.close()
    out.seek(0)
    most, seen = 0, 0
    for _, y, band in png.decode(out):
        most, seen = max(most, band.nbytes), seen + len(band)
        assert np.array_equal(band[0], (line + y // 3 % 256).astype(np.uint8))
    assert seen == 1500 and most <= png.BAND_BYTES
