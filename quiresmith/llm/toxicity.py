"""Toxicity scores: boosted trees over dense features, with isotonic calibration.

A lexicon of words that mark toxic documents is learned from labelled rows.
Each text then has densities of lexicon words, how close they stand to
words of the second person, and rates of capitals, punctuation and
disguised spellings; trees over these features give a margin, and an isotonic
fit on rows that the trees have not seen makes it a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import in_small_batches, rows_of, without
from quiresmith.llm.learning import Trees, held_out, isotonic, labelled_sample
from quiresmith.session import materialize

#: At most so many labelled rows teach the model; its lexicon is of their words.
MAX_ROWS = 20_000
LEAST_DOCS = 5
THRESHOLD = 0.5
#: Words of the second person in the corpus languages, and letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu te ti tú usted ustedes vosotros vous toi ton ta tes votre vos du dich dir dein deine euch ihr".split())
LEET = str.maketrans("013457@$!|+", "oieastasiit")
_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*#%&$|~_=+/\\"
_INNER = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|[013457@$!|+][^\W\d_]|[^\W\d_][013457@$!|+]")
_DROP = re.compile(r"[\W\d_]+")
_REPEAT = re.compile(r"(.)\1{2,}")
FEATURES = ("strong", "weak", "heaviest", "kinds", "share", "near", "second", "capitals", "shouted", "marks", "noise", "disguised", "disguised_hits", "words")


def plain_words(text: str) -> list[str]:
    """Lower-case tokens without the signs around them."""
    return [w.strip(_EDGES) for w in text.lower().split()]


def revealed(word: str) -> tuple[str, str]:
    """A disguised word with its stand-ins read as letters, and with all other signs left out."""
    return _DROP.sub("", word.translate(LEET)), _DROP.sub("", word)


def features(text: str | None, lexicon: dict[str, float], strong: float) -> list[float]:
    """The dense features of a text; an empty one has zeros."""
    text = text or ""
    words = plain_words(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [(k, lexicon[w]) for k, w in enumerate(words) if w in lexicon]
    odd = disguised = 0
    known = dict(zip(reversed(words), range(n - 1, -1, -1)))  # where each stands first
    for w in known:
        if not w.isalpha() and len(w) > 2 and _INNER.search(w):
            odd += 1
            found = next((x for x in revealed(w) if x in lexicon), None)
            if found:
                disguised += 1
                hits.append((known[w], lexicon[found]))
        elif w not in lexicon and _REPEAT.search(w):
            short = _REPEAT.sub(r"\1", w)
            if short in lexicon:
                disguised += 1
                hits.append((known[w], lexicon[short]))
    heavy = [k for k, v in hits if v >= strong]
    persons = [k for k, w in enumerate(words) if w in SECOND_PERSON] if not SECOND_PERSON.isdisjoint(known) else []
    near = 0.0
    if heavy and persons:
        places, marked = np.array([-n, *persons, 2 * n]), np.array(heavy)
        after = np.searchsorted(places, marked)
        near = 1.0 / (1 + int(np.minimum(places[after] - marked, marked - places[after - 1]).min()))
    size = max(1, len(text))
    upper = sum(map(str.isupper, text.split()))
    marks = text.count("!") + text.count("?")
    noise = sum(map(text.count, "*#%&$@|"))
    return [
        1000.0 * len(heavy) / n,
        1000.0 * (len(hits) - len(heavy)) / n,
        max((v for _, v in hits), default=0.0),
        float(len({words[k] for k in heavy})),
        float(len(heavy)),
        near,
        1000.0 * len(persons) / n,
        sum(map(str.isupper, text)) / size,
        upper / n,
        marks / size,
        noise / size,
        odd / n,
        float(disguised),
        float(np.log1p(n)),
    ]


def learn_lexicon(sample: DataFrame, folds: int = 2) -> list[tuple[str, list[float]]]:
    """Words and their log odds of toxicity: learned from all of sample(text, y, fold), then with each fold left out.

    A text counts each word once, and equal texts count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            word, y, fold = [], [], []
            for r in batch.to_pylist():
                for w in {*plain_words(r["text"] or "")} - {""}:
                    word.append(w)
                    y.append(r["y"])
                    fold.append(r["fold"])
            yield pa.record_batch([pa.array(word, pa.string()), pa.array(y, pa.int32()), pa.array(fold, pa.int32())], ["word", "y", "fold"])

    one = sample.groupBy(F.xxhash64("text"), F.length("text")).agg(F.first("text").alias("text"), F.max("y").alias("y"), F.min("fold").alias("fold"))
    cells = [F.count_if((F.col("y") == c) & (F.col("fold") == f)).alias(f"n{c}{f}") for c in (0, 1) for f in range(folds)]
    totals = one.agg(*cells).first()
    counted = one.select("text", "y", "fold").mapInArrow(run, "word string, y int, fold int").groupBy("word").agg(*cells)
    toxic = sum(F.col(f"n1{f}") for f in range(folds))
    clean = sum(F.col(f"n0{f}") for f in range(folds))
    lead = counted.where((toxic >= LEAST_DOCS) & (toxic * (sum(totals[:folds]) + 1) > 2 * clean * (sum(totals[folds:]) + 1)))
    best = lead.orderBy("word").collect()  # few: each is in LEAST_DOCS labelled rows at least
    found = []
    for r in best:
        odds = []
        for out in (None, *range(folds)):
            a = [sum(r[f"n{c}{f}"] for f in range(folds) if f != out) for c in (0, 1)]
            n = [sum(totals[f"n{c}{f}"] for f in range(folds) if f != out) for c in (0, 1)]
            least = LEAST_DOCS if out is None else LEAST_DOCS * (folds - 1) / folds
            # A word of few documents is held near even odds.
            odds.append(float(np.log((a[1] + 0.5) / (n[1] + 1)) - np.log((a[0] + 0.5) / (n[0] + 1))) if a[1] >= least else 0.0)
        found.append((r["word"], odds))
    return found


class Model:
    """Lexicon, trees and calibration; plain arrays, so that it can be broadcast."""

    def __init__(self, lexicon: dict[str, float], strong: float, trees: Trees, knots: tuple[np.ndarray, np.ndarray]) -> None:
        self.lexicon, self.strong, self.trees, self.knots = lexicon, strong, trees, knots

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is toxic."""
        x = np.array([features(t, self.lexicon, self.strong) for t in texts], float).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


_SOFT = 2.0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, strong: float = _SOFT, folds: int = 2) -> Model | None:
    """Learn from labels(doc_id, toxic) of documents that are not held out; None without labels of both kinds."""
    sample = in_small_batches(labelled_sample(docs, labels, "toxic", max_rows)).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int"))
    sample = materialize(sample, "toxicity-sample")  # a bounded table, so that documents are read once
    words = learn_lexicon(sample, folds)
    tables = [{w: odds[k] for w, odds in words if odds[k] > 1.0} for k in range(folds + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = batch.to_pylist()
            x = [features(r["text"], tables[1 + r["fold"]], strong) for r in rows]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column("y"), batch.column("fold"), batch.column("doc_id")], ["x", "y", "fold", "doc_id"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"x array<double>, y int, fold int, doc_id {kind}").orderBy("doc_id").collect()
    if len({r["y"] for r in rows}) < 2:
        return None
    x, y, fold = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows])
    margin = np.zeros(len(y))
    for f in range(folds):
        rest = fold != f
        if rest.any() and not rest.all():
            margin[~rest] = Trees().fit(x[rest], y[rest]).margin(x[~rest])
    return Model(tables[0], strong, Trees().fit(x, y), isotonic(margin, y))


def score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs(text, ...) with a ``column`` of scores added; without a model every score is 0.

    Whole texts of any length are scored, in time that grows with their
    words; null and empty ones have the score of an empty text. Nulls in other
    columns and repeated rows stay; a column of that name gives way to the
    scores; an empty table gives no rows.
    """
    docs = without(docs, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = batch.column("text").to_pylist()
            scores = model.score(texts) if model else np.zeros(len(texts))
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return in_small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
