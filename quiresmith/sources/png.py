"""PNG images as tables: a data source that reads and writes rows of pixels.

``spark.read.format("png")`` gives a row for each line of every image below a
path, with the image's header and the line's bytes as they are stored, and
writing such rows makes the same images again, bit for bit. Files are dealt to
tasks by size; within a file, lines are decoded and encoded in bands, so that
memory does not grow with the image (interlaced images are held whole).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quiresmith.sources.stores import dealt, move_in, store_of

#: A line of an image: its place, the image's header, its palette and transparency chunks, and the samples of the line, packed as PNG packs them.
ROWS = "img string, y int, width int, height int, colour int, depth int, palette binary, alpha binary, line binary"
#: Fixed values of the format: signature, samples of a pixel by colour type, depths that each may have, and the passes of an interlaced image (x, y, step right, step down).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Bytes of lines that are decoded together, lines at most, bytes that are read at once, and bytes of files that a task reads, about.
BAND_BYTES, BAND_LINES, PIECE, TASK_BYTES = 1 << 22, 256, 1 << 16, 64 << 20


@dataclass(frozen=True)
class Header:
    """What an image's lines have in common."""

    width: int
    height: int
    colour: int
    depth: int
    interlaced: bool = False
    palette: bytes | None = None
    alpha: bytes | None = None

    def __post_init__(self) -> None:
        if self.width < 1 or self.height < 1 or self.depth not in DEPTHS.get(self.colour, ()):
            raise ValueError(f"no PNG has width {self.width}, height {self.height}, colour type {self.colour} and depth {self.depth}")

    @property
    def step(self) -> int:
        """Bytes from a sample to the same one of the pixel before, 1 at least."""
        return max(1, SAMPLES[self.colour] * self.depth // 8)

    def line_bytes(self, width: int | None = None) -> int:
        return (SAMPLES[self.colour] * self.depth * (self.width if width is None else width) + 7) // 8


def unfiltered(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Lines without their filters; ``above`` is the line before the first.

    Lines that look at most up are sums. Where a line's filter looks left and
    up, the band is decoded along its diagonals: all pixels of one depend only
    on the two before, so that each is a few operations on whole arrays.
    """
    if kinds.max(initial=0) > 4:
        raise ValueError("a line has an unknown filter")
    n, size = lines.shape
    if not (kinds > 2).any():
        out = np.empty_like(lines)
        for k in range(n):
            if kinds[k] == 1:
                padded = np.zeros(-(-size // step) * step, np.uint8)
                padded[:size] = lines[k]
                out[k] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:size]
            elif kinds[k] == 2:
                out[k] = lines[k] + above
            else:
                out[k] = lines[k]
            above = out[k]
        return out
    wide = -(-size // step)
    raw = np.zeros((n, wide * step), np.int16)
    raw[:, :size] = lines
    raw = raw.reshape(n, wide, step)
    # skewed[t, k + 1] is pixel t - k - 1 of line k; line 0 of the skew is the line above.
    skewed = np.zeros((wide + n + 2, n + 1, step), np.int16)
    first = np.zeros(wide * step, np.int16)
    first[:size] = above
    skewed[1 : wide + 1, 0] = first.reshape(wide, step)
    kind = kinds[:, None]
    up_left, average, up, left = kind == 4, kind == 3, kind == 2, kind == 1
    for t in range(2, wide + n + 1):
        # Pixel x of line k lies at t = x + k + 2; at t - 1 are its left neighbour (column k + 1) and the one above (column k), at t - 2 the one above left (column k).
        low, high = max(0, t - 1 - wide), min(n, t - 1)
        at = slice(low, high)
        a, b, c = skewed[t - 1, low + 1 : high + 1], skewed[t - 1, at], skewed[t - 2, at]
        p = a + b - c
        pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        guess = np.where(up_left[at], paeth, np.where(average[at], (a + b) >> 1, np.where(up[at], b, np.where(left[at], a, 0))))
        lines_at = np.arange(low, high)
        skewed[t, low + 1 : high + 1] = (raw[lines_at, t - 2 - lines_at] + guess) & 255
    k, x = np.arange(n)[:, None], np.arange(wide)[None]
    return skewed[x + k + 2, k + 1].astype(np.uint8).reshape(n, -1)[:, :size]


def filtered(lines: np.ndarray, above: np.ndarray, step: int, plain: bool) -> bytes:
    """Lines with, each, the filter that leaves the least sum of differences; ``plain`` (palettes, few bits) leaves them as they are."""
    n, size = lines.shape
    out = np.zeros((n, size + 1), np.uint8)
    if plain:
        out[:, 1:] = lines
        return out.tobytes()
    x = lines.astype(np.int16)
    b = np.concatenate((above[None].astype(np.int16), x[:-1]))
    a, c = np.zeros_like(x), np.zeros_like(x)
    a[:, step:], c[:, step:] = x[:, :-step], b[:, :-step]
    p = a + b - c
    far = np.abs(np.stack((p - a, p - b, p - c)))
    paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), a, np.where(far[1] <= far[2], b, c))
    ways = np.stack([x, x - a, x - b, x - ((a + b) >> 1), x - paeth]).astype(np.uint8)
    cost = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    out[:, 0] = best
    out[:, 1:] = ways[best, np.arange(n)]
    return out.tobytes()


def samples(lines: np.ndarray, width: int, colour: int, depth: int) -> np.ndarray:
    """Samples (line, pixel, sample) of packed lines."""
    n, each = len(lines), SAMPLES[colour]
    if depth == 16:
        return lines.reshape(n, -1).view(">u2").reshape(n, width, each)
    if depth == 8:
        return lines.reshape(n, width, each)
    bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(n, width, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8))[:, :, None].astype(np.uint8)


def packed(values: np.ndarray, depth: int) -> np.ndarray:
    """Packed lines of samples."""
    n = len(values)
    if depth == 16:
        return np.frombuffer(values.astype(">u2").tobytes(), np.uint8).reshape(n, -1)
    if depth == 8:
        return values.astype(np.uint8).reshape(n, -1)
    bits = (values.reshape(n, -1, 1) >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(n, -1), axis=1)


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise ValueError("the file ends early")
    return data


def _chunks(stream) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """Chunks of a PNG stream: names and pieces of their data. Sums are checked as the pieces are read."""
    if stream.read(8) != SIGNATURE:
        raise ValueError("not a PNG file")
    name = b""
    while name != b"IEND":
        size, name = struct.unpack(">I4s", _exactly(stream, 8))

        def pieces(left: int = size, name: bytes = name) -> Iterator[bytes]:
            crc = zlib.crc32(name)
            while left:
                data = _exactly(stream, min(left, PIECE))
                crc, left = zlib.crc32(data, crc), left - len(data)
                yield data
            if crc != struct.unpack(">I", _exactly(stream, 4))[0]:
                raise ValueError(f"chunk {name.decode('latin-1')} is damaged")

        yield name, pieces()


def _image_data(chunks: Iterator[tuple[bytes, Iterator[bytes]]], first: Iterator[bytes]) -> Iterator[bytes]:
    """The unpacked stream of the image data, in pieces of bounded size."""
    unzip, mine = zlib.decompressobj(), first
    while True:
        for piece in mine:
            while piece:
                data = unzip.decompress(piece, PIECE * 16)
                if data:
                    yield data
                piece = unzip.unconsumed_tail
        name, mine = next(chunks, (b"IEND", iter(())))
        if name != b"IDAT":
            for _ in mine:
                pass
            break
    yield unzip.flush()


class _Source:
    """Bytes by number from an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                raise ValueError("lines are missing")
            self.held += piece
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _bands(data: _Source, width: int, height: int, head: Header) -> Iterator[np.ndarray]:
    """Bands of unfiltered lines of an image, or of a pass, of this width and height."""
    size = head.line_bytes(width)
    band = max(1, min(BAND_LINES, BAND_BYTES // (size + 1)))
    above = np.zeros(size, np.uint8)
    for at in range(0, height, band):
        n = min(band, height - at)
        lines = np.frombuffer(data.take(n * (size + 1)), np.uint8).reshape(n, size + 1)
        out = unfiltered(lines[:, 0], lines[:, 1:], above, head.step)
        above = out[-1]
        yield out


def _interlaced(data: _Source, head: Header) -> np.ndarray:
    """All lines of an interlaced image."""
    whole = np.zeros((head.height, head.width, SAMPLES[head.colour]), np.uint16 if head.depth == 16 else np.uint8)
    for x, y, right, down in PASSES:
        width, height = -(-(head.width - x) // right), -(-(head.height - y) // down)
        if width > 0 and height > 0:
            lines = np.concatenate(list(_bands(data, width, height, head)))
            whole[y::down, x::right] = samples(lines, width, head.colour, head.depth)
    return packed(whole, head.depth)


def decode(stream) -> Iterator[tuple[Header, int, np.ndarray]]:
    """Header, place of the first line and lines (packed) of each band of a PNG stream."""
    chunks, head, palette, alpha = _chunks(stream), None, None, None
    for name, pieces in chunks:
        if name == b"IDAT":
            if head is None:
                raise ValueError("image data come before the header")
            head = Header(*head, palette, alpha)
            data, y = _Source(_image_data(chunks, pieces)), 0
            bands = iter([_interlaced(data, head)]) if head.interlaced else _bands(data, head.width, head.height, head)
            for band in bands:
                for at in range(0, len(band), BAND_LINES):
                    yield head, y, band[at : at + BAND_LINES]
                    y += len(band[at : at + BAND_LINES])
            for _ in data.pieces:
                pass
            for _, rest in chunks:  # up to the end, so that a file cut short is found out
                for _ in rest:
                    pass
            return
        data = b"".join(pieces) if name in (b"IHDR", b"PLTE", b"tRNS") else [None for _ in pieces]
        if name == b"IHDR":
            width, height, depth, colour, packing, filters, interlaced = struct.unpack(">IIBBBBB", data)
            if packing or filters or interlaced > 1:
                raise ValueError("an unknown way to pack an image")
            head = (width, height, colour, depth, bool(interlaced))
        elif name == b"PLTE":
            palette = data
        elif name == b"tRNS":
            alpha = data
    raise ValueError("there are no image data")


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(name)))


class Encoder:
    """Writes one image, line by line, to a stream: nothing but the band at hand is held."""

    def __init__(self, stream, head: Header, dpi: int = 200, level: int = 9):
        self.stream, self.head, self.zip, self.y = stream, head, zlib.compressobj(level), 0
        self.above, self.band = np.zeros(head.line_bytes(), np.uint8), []
        self.most = max(1, min(BAND_LINES, BAND_BYTES // (head.line_bytes() + 1)))
        metre = round(dpi / 0.0254)
        stream.write(SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", head.width, head.height, head.depth, head.colour, 0, 0, 0)) + _chunk(b"pHYs", struct.pack(">IIB", metre, metre, 1)))
        for name, data in ((b"PLTE", head.palette), (b"tRNS", head.alpha)):
            if data is not None:
                stream.write(_chunk(name, data))

    def add(self, y: int, line: bytes) -> None:
        if y != self.y + len(self.band) or y >= self.head.height or len(line) != len(self.above):
            raise ValueError(f"line {y} is not the next one, or has {len(line)} bytes for {len(self.above)}")
        self.band.append(line)
        if len(self.band) >= self.most:
            self._flush()

    def _flush(self) -> None:
        lines = np.frombuffer(b"".join(self.band), np.uint8).reshape(len(self.band), len(self.above))
        data = self.zip.compress(filtered(lines, self.above, self.head.step, self.head.colour == 3 or self.head.depth < 8))
        self.above, self.y, self.band = lines[-1], self.y + len(lines), []
        if data:
            self.stream.write(_chunk(b"IDAT", data))

    def close(self) -> None:
        if self.band:
            self._flush()
        if self.y != self.head.height:
            raise ValueError(f"{self.head.height - self.y} lines are missing")
        self.stream.write(_chunk(b"IDAT", self.zip.flush()) + _chunk(b"IEND", b""))


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str]]  # path, name of the image


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Files]:
        return [_Files(x) for x in dealt(self.path, ".png", TASK_BYTES)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        for path, name in partition.files:
            with store.open_input_stream(path) as stream:
                try:
                    for head, y, lines in decode(stream):
                        n = len(lines)
                        one = lambda v, kind: pa.array([v] * n, kind)
                        yield pa.record_batch(
                            [one(name, pa.string()), pa.array(np.arange(y, y + n, dtype=np.int32)), *(one(v, pa.int32()) for v in (head.width, head.height, head.colour, head.depth)), one(head.palette, pa.binary()), one(head.alpha, pa.binary()), pa.array([x.tobytes() for x in lines], pa.binary())],
                            [c.split()[0] for c in ROWS.split(", ")],
                        )
                except (ValueError, zlib.error, struct.error) as bad:
                    raise ValueError(f"{path}: {bad}") from bad


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # temporary path, name of the image


class _Writer(DataSourceArrowWriter):
    """Tasks write to a folder beside the images; the commit moves what the successful ones wrote to its names."""

    def __init__(self, options: dict[str, str]):
        import uuid

        self.path, self.replace = options["path"], options.get("replace", "false").lower() == "true"
        self.dpi, self.level = int(options.get("dpi", 200)), int(options.get("level", 9))
        self.folder = f"_images-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = store_of(self.path)
        task, out, stream, encoder = TaskContext.get(), _Written(), None, None
        store.create_dir(f"{root}/{self.folder}", recursive=True)

        def done() -> None:
            if encoder is not None:
                encoder.close()
                stream.close()

        for batch in iterator:
            for r in batch.to_pylist():
                if not out.files or out.files[-1][1] != r["img"]:
                    done()
                    at = f"{root}/{self.folder}/{task.taskAttemptId()}-{len(out.files)}"
                    out.files.append((at, r["img"]))
                    stream = store.open_output_stream(at)
                    encoder = Encoder(stream, Header(r["width"], r["height"], r["colour"], r["depth"], False, r["palette"], r["alpha"]), self.dpi, self.level)
                encoder.add(r["y"], r["line"])
        done()
        return out

    def commit(self, messages: list[_Written | None]) -> None:
        move_in(self.path, self.folder, ".png", [x for m in messages if m for x in m.files], self.replace)

    def abort(self, messages: list[_Written | None]) -> None:
        move_in(self.path, self.folder, ".png", [], self.replace)


class PngSource(DataSource):
    """Format ``png``. Reading: ``path`` is a folder, searched throughout, or a file.

    Writing (mode append) takes rows with each image's lines together and in
    order; see ``sinks.write_png``. Option ``replace``: an image takes the
    place of one of its name; otherwise its name gets the first free of the
    suffixes -2, -3, ... A folder without images has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format ``png`` known to a session."""
    spark.dataSource.register(PngSource)


def on_white(values: np.ndarray, colour: int, depth: int, palette: bytes | None, alpha: bytes | None) -> np.ndarray:
    """Grey values of samples (line, pixel, sample): colours by weight, what is transparent on white, sixteen bits by the upper eight."""
    clear = None
    if colour == 3:
        table = np.zeros((256, 3), np.uint8)
        table[: len(palette or b"") // 3] = np.frombuffer(palette or b"", np.uint8).reshape(-1, 3)
        shade = np.full(256, 255, np.uint8)
        shade[: len(alpha or b"")] = np.frombuffer(alpha or b"", np.uint8)
        rgb, clear = table[values[:, :, 0]], shade[values[:, :, 0]]
    else:
        eight = (values >> 8).astype(np.uint8) if depth == 16 else values if depth == 8 else (values * (255 // ((1 << depth) - 1))).astype(np.uint8)
        rgb = eight[:, :, :3] if colour in (2, 6) else np.repeat(eight[:, :, :1], 3, axis=2)
        clear = eight[:, :, -1] if colour in (4, 6) else None
    if clear is not None:
        mixed = rgb.astype(np.int32) * clear[:, :, None] + 255 * (255 - clear[:, :, None].astype(np.int32)) + 128
        rgb = ((mixed >> 8) + mixed) >> 8
    # The weights of red, green and blue, in 65,536ths.
    return ((rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + 32768) >> 16).astype(np.uint8)


def greys(rows: DataFrame) -> DataFrame:
    """img, y, px (a byte for each pixel) of rows as the source reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                line = np.frombuffer(r["line"], np.uint8)[None]
                out.append(on_white(samples(line, r["width"], r["colour"], r["depth"]), r["colour"], r["depth"], r["palette"], r["alpha"])[0].tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["img", "y", "px"])

    return rows.select("img", "y", "width", "colour", "depth", "palette", "alpha", "line").mapInArrow(run, "img string, y int, px binary")
