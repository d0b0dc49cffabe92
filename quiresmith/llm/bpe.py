"""Byte-level BPE encoding and decoding in linear time.

A text is cut by the tokenizer's pattern; each match is encoded on its own. Its
bytes, as Latin-1 characters, are covered by longest vocabulary matches of an
Aho-Corasick automaton; where a token cannot follow the one before, shorter
prefixes are tried and, failing these, the last token is taken back. Two
tokens can stand side by side iff merging their joined bytes gives just these
two; that is looked up once per pair. A cover whose neighbours are all
compatible is the cover that the merges make, and no end that failed is tried
twice, so the work is linear in the bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.common import in_small_batches, rows_of

_CACHED = 500_000
_NEVER = 1 << 60
#: Bytes of a piece that are matched ahead, and ids that are decoded at a time.
_WINDOW, _STEP = 2048, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token, space, rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """The merges as defined, lowest rank first and leftmost on ties, down to ``least`` parts; quadratic, for tokens."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > least:
        rank, at = min((ranks.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == _NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _Memo(dict):
    """A function's values by key, computed once while they are few enough."""

    def __init__(self, compute, most: int) -> None:
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class _Pieces(_Memo):
    """Packed ids of pieces; long pieces are rare and not kept."""

    def __missing__(self, piece: str) -> bytes:
        value = self.compute(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value


@lru_cache(maxsize=2)
def character_classes(top: int = 0x110000) -> dict[str, str]:
    r"""Ranges of the characters below ``top`` that the target library counts as \p{L}, \p{N} and \s, for a character class of ``re``.

    Its Unicode version differs from that of Python's libraries.
    """
    import tiktoken

    every = "".join(map(chr, chain(range(min(top, 0xD800)), range(0xE000, top))))
    single = {bytes([k]): k for k in range(256)}
    found = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        target = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        codes = np.frombuffer(bytes(target.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4").astype(np.int64)
        breaks = np.flatnonzero(np.diff(codes) != 1)
        firsts, lasts = codes[np.append(0, breaks + 1)], codes[np.append(breaks, len(codes) - 1)]
        found[kind] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts.tolist(), lasts.tolist()))
    return found


def spelled_out(pattern: str, top: int = 0x110000) -> str:
    r"""A pattern with \p{L}, \p{N}, \s and \S as the target library reads them, for ``re``; other named classes are an error."""
    classes, out, inside = character_classes(top), [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in classes:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif re.match(r"\\[pPSwWdDbB]", part):
            raise ValueError(f"no spelling for {part} in {pattern}")
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    return "".join(out)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], patterns: tuple[str, str]) -> None:
        import ahocorasick

        if any(bytes([k]) not in ranks for k in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), ranks[token])
        self.automaton.make_automaton()
        self.patterns = tuple(map(re.compile, patterns))
        self.spines: dict[int, tuple[tuple, tuple] | None] = {}
        self.fits = _Memo(self._fits, 2 * _CACHED)
        self.shorter = _Memo(self._prefix, len(ranks) + 1)
        self.pieces = _Pieces(self._piece, _CACHED)
        # For decoding: all tokens' bytes in one, where each token's start, and how many they are.
        top = max(ranks.values()) + 1
        self.sizes, self.reach = [len(self.tokens.get(k, b"")) for k in range(top)], max(map(len, ranks))
        self.lengths = np.array(self.sizes)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens.get(k, b"") for k in range(top)), np.uint8)

    def split(self, text: str) -> list[str]:
        """The pattern's matches in a text; most texts have no character that needs the larger classes."""
        narrow, wide = self.patterns
        plain = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (narrow if plain else wide).findall(text)

    def _spine(self, token: int) -> tuple[tuple, tuple] | None:
        """The merges along a token's left and right edge: (part, rank of the merge that ends it), from the byte up.

        None if the merges of the token's bytes do not give the token, which then takes part in no cover.
        """
        if token not in self.spines:
            text = self.tokens[token]
            halves = merge(text, self.ranks, 2)
            left = right = ()
            if len(halves) == 2 and halves[0] + halves[1] == text and self.ranks.get(text) is not None:
                first, second = (self._spine(self.ranks[h]) if h in self.ranks else None for h in halves)
                if first and second:
                    left = (*first[0][:-1], (halves[0], token))
                    right = (*second[1][:-1], (halves[1], token))
            known = len(text) == 1 or bool(left)
            self.spines[token] = ((*left, (text, _NEVER)), (*right, (text, _NEVER))) if known else None
        return self.spines[token]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the second token can follow the first (-1: a piece starts): no merge crosses the border between them.

        The parts at the border grow along the right edge of one and the left
        edge of the other. Two parts that meet join if their rank comes before
        the merge that ends either; on equal ranks the leftmost goes first.
        """
        before, token = pair
        own = self._spine(token)
        if own is None or before < 0:
            return own is not None
        rank_of = self.ranks.get
        left, right = iter(self._spine(before)[1]), iter(own[0])
        (x, x_ends), (y, y_ends) = next(left), next(right)
        while True:
            rank = rank_of(x + y)
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == _NEVER:
                    return True
                x, x_ends = next(left)
            else:
                y, y_ends = next(right)

    def _prefix(self, token: int) -> int | None:
        """The longest proper prefix that is a token."""
        text = self.tokens[token]
        return next((c for k in range(len(text) - 1, 0, -1) if (c := self.ranks.get(text[:k])) is not None), None)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        latin, fits = raw.decode("latin-1"), self.fits
        cover = [token for _, token in self.automaton.iter_long(latin)]
        if not all(map(fits.__getitem__, pairwise((-1, *cover)))):
            cover = self._backtracked(latin, cover)
        return array("I", cover).tobytes()

    def _backtracked(self, latin: str, longest: list[int]) -> list[int]:
        """The cover whose neighbours all fit: longest matches as far as they do, then shorter ones, then a step back.

        ``longest`` are the longest matches one after the other, of which some neighbours do not fit.
        """
        fits, shorter, size, n = self.fits, self.shorter, self.sizes, len(latin)
        before, at, taken = -1, 0, 0
        for token in longest:
            if not fits[before, token]:
                break
            before = token
            at += size[token]
            taken += 1
        cover, failed = longest[:taken], set()
        token = shorter[token]
        while True:
            while token is not None and (not fits[before, token] or (failed and at + size[token] in failed)):
                token = shorter[token]
            if token is None:
                failed.add(at)
                token = cover.pop()
                at -= size[token]
                before = cover[-1] if cover else -1
                token = shorter[token]
                continue
            cover.append(token)
            before = token
            at += size[token]
            # Longest matches again, in windows, so that a step back does not read all that follows.
            again = True
            while again:
                sure = n if at + _WINDOW >= n else at + _WINDOW - self.reach
                for _, token in self.automaton.iter_long(latin[at : at + _WINDOW]):
                    if at > sure or not fits[before, token] or (failed and at + size[token] in failed):
                        break
                    cover.append(token)
                    before = token
                    at += size[token]
                again = sure < at < n
            if at == n:
                return cover
            token = shorter[token]

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null as empty."""
        return b"".join(map(self.pieces.__getitem__, self.split(text or "")))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; null as empty."""
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids."""
        return b"".join([self._gathered(ids[k : k + _STEP]) for k in range(0, len(ids), _STEP)])

    def _gathered(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        # From a byte's place in the result to its place in the tokens' bytes.
        shift = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.bytes[shift + np.arange(len(shift))].tobytes()


@lru_cache(maxsize=2)
def _codec(path: str, patterns: tuple[str, str]) -> Codec:
    return Codec(read_ranks(path), patterns)


@lru_cache(maxsize=2)
def _patterns(pattern: str) -> tuple[str, str]:
    return spelled_out(pattern, 0x10000), spelled_out(pattern)


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, made once per worker."""
    return _codec(path, _patterns(pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids for docs(doc_id, text): ids packed as little-endian unsigned 32-bit integers.

    ``path`` names the vocabulary, which every worker can open. Whole texts
    are encoded, null ones as empty; repeated rows and null ids stay as they
    are; an empty table gives no rows.
    """

    patterns = _patterns(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codec(path, patterns)
        for batch in rows_of(batches):
            ids = [own.packed(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded(doc_id, ids) with ``decoded``, the bytes of the ids (null ids: empty)."""

    patterns = _patterns(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codec(path, patterns)
        for batch in rows_of(batches):
            texts = [own.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded for docs(doc_id, text): ``encode`` and ``decode`` in one pass, so that each core needs one worker."""

    patterns = _patterns(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codec(path, patterns)
        for batch in rows_of(batches, 64):
            packed = [own.packed(t.as_py()) for t in batch.column(1)]
            texts = [own.decode(np.frombuffer(x, "<u4")) for x in packed]
            yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decoded(doc_id, ids, decoded), and the columns of ``more``."""
    return decoded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
