"""Quality scores: naive Bayes support vectors over hashed n-gram indicators.

Indicators are word unigrams and bigrams, and n-grams of token shapes at the
levels of a text that they make up. Each is scaled by the log of the ratio of
its smoothed shares in the two classes; a linear hinge-loss model over the
scaled indicators is fit by dual coordinate descent; an isotonic fit on rows
that it has not seen makes its margin a probability.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import in_small_batches, rows_of, without
from quiresmith.llm.learning import held_out, isotonic, labelled_sample

#: At most so many labelled rows teach the model.
MAX_ROWS = 12_000
BITS = 18
THRESHOLD = 0.3
#: A shape n-gram is noted at each of these shares of a text that it reaches.
LEVELS = (1 / 128, 1 / 32, 1 / 8, 1 / 2)
_CACHED = 100_000


def shape(token: str) -> str:
    """Kinds of a token's characters, each run once: X upper, x lower or other letters, 0 digits, signs as they are."""
    out = []
    for c in token:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class _Codes(dict):
    """Token -> word hash and shape hash in one number."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHED:
            self.clear()
        word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass"))
        value = self[token] = word | (zlib.crc32(shape(token).encode("utf-8", "surrogatepass")) >> 1) << 32
        return value


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slot(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values.astype(np.uint64) + np.uint64(salt)) * _MIX
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int32)


def indicators(text: str | None, codes: _Codes | None = None) -> np.ndarray:
    """Hashed positions, each once, of the indicators that a text has; an empty text has none."""
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.int32)
    codes = _Codes() if codes is None else codes
    both = np.fromiter([codes[t] for t in tokens], np.int64, n)
    word, kind = both & 0xFFFFFFFF, both >> 32
    kind[1:][word[1:] == word[:-1]] = 1  # a repeat of the word before has a shape of its own
    found = [_slot(word, 1)]
    if n > 1:
        found.append(_slot(word[:-1] * 1_000_003 + word[1:], 2))
    grams = kind
    for size in (1, 2, 3):
        if n < size:
            break
        grams = kind if size == 1 else grams[:-1] * 31 + kind[size - 1 :]
        values, counts = np.unique(grams, return_counts=True)
        share = counts / len(grams)
        for level, least in enumerate(LEVELS):
            found.append(_slot(values[share >= least], 16 * size + level))
    return np.unique(np.concatenate(found))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of each indicator's smoothed share in class 1 over that in class 0."""
    counts = [np.bincount(np.concatenate([r for r, c in zip(rows, y) if c == k] or [np.empty(0, np.int32)]), minlength=1 << BITS) + smooth for k in (0, 1)]
    seen = (counts[0] + counts[1]) > 2 * smooth
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return np.where(seen, ratio, 0.0)


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over unit rows of scaled indicators, by dual coordinate descent.

    A row of the rarer class costs more, so that both classes weigh alike.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    share = max(1e-9, (y == 1).mean())
    bound = np.where(y == 1, cost * 0.5 / share, cost * 0.5 / max(1e-9, 1 - share))
    values = [ratio[r] / max(1e-12, np.sqrt(ratio[r] @ ratio[r])) for r in rows]
    alpha, w, bias = np.zeros(len(y)), np.zeros(len(ratio)), 0.0
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(len(y)):
            r, v = rows[k], values[k]
            slope = sign[k] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[k] - slope / square[k], 0.0), bound[k])
            step = (new - alpha[k]) * sign[k]
            if step:
                alpha[k] = new
                w[r] += step * v
                bias += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


class Model:
    """Log ratios, weights and calibration, as plain arrays."""

    def __init__(self, ratio: np.ndarray, w: np.ndarray, bias: float, knots: tuple[np.ndarray, np.ndarray]) -> None:
        self.scaled, self.square, self.bias, self.knots = (ratio * w).astype(np.float32), (ratio * ratio).astype(np.float32), bias, knots

    def margin(self, row: np.ndarray) -> float:
        """Signed distance of a row of indicators."""
        length = float(self.square[row].sum(dtype=float)) ** 0.5
        return float(self.scaled[row].sum(dtype=float)) / max(1e-12, length) + self.bias

    def score(self, texts: list[str | None], codes: _Codes | None = None) -> np.ndarray:
        """Probability that each text is of label 1."""
        codes = _Codes() if codes is None else codes
        return np.clip(np.interp([self.margin(indicators(t, codes)) for t in texts], *self.knots), 0.0, 1.0)


def train(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Model | None:
    """Model of rows of indicators; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    margin = np.zeros(len(y))
    for f in np.unique(fold):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(set(y[rest].tolist())) == 2:
            some = [rows[k] for k in rest]
            ratio = log_ratios(some, y[rest])
            part = Model(ratio, *descend(some, y[rest], ratio), ((0.0,), (0.0,)))
            margin[own] = [part.margin(rows[k]) for k in own]
    ratio = log_ratios(rows, y)
    return Model(ratio, *descend(rows, y, ratio), isotonic(margin, y))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = 2) -> Model | None:
    """Learn from labels(doc_id, quality) of documents that are not held out, in one task over the bounded sample."""
    sample = labelled_sample(docs, labels, "quality", max_rows)

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in rows_of(batches):
            rows = [indicators(t, codes) for t in batch.column("text").to_pylist()]
            fold = [zlib.crc32(r.tobytes()) % folds for r in rows]
            ids = batch.column("doc_id").cast(pa.string())
            yield pa.record_batch([ids, pa.array([r.tobytes() for r in rows], pa.binary()), batch.column("y"), pa.array(fold, pa.int32())], ["id", "row", "y", "fold"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("y", "ascending")])
        rows = [np.frombuffer(r.as_py(), np.int32) for r in table.column("row")]
        model = train(rows, table.column("y").to_numpy(), table.column("fold").to_numpy())
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    noted = sample.mapInArrow(note, "id string, row binary, y int, fold int")
    found = noted.groupBy().applyInArrow(learn, "model binary").first()
    return pickle.loads(found[0]) if found else None  # noqa: S301 - written by the task above


def score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs(text, ...) with a ``column`` of scores added; without a model every score is 1.

    Whole texts of any length are scored; null and empty ones have the score
    of the bare bias. Nulls in other columns and repeated rows stay; a column
    of that name gives way to the scores; an empty table gives no rows.
    """
    docs = without(docs, column)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes = shared.value, _Codes()
        for batch in rows_of(batches):
            texts = batch.column("text").to_pylist()
            scores = own.score(texts, codes) if own else np.ones(len(texts))
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return in_small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
