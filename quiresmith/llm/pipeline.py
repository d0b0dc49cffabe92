"""The corpus pipeline: documents in, encoded training texts out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents, unchanged, whatever further columns there are and
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.llm import bpe, mixing, quality, simhash, toxicity
from quiresmith.operators.columns import fresh
from quiresmith.session import load, materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _scored(docs: DataFrame, score: Callable[[DataFrame, str], DataFrame], keep: Callable[[Column], Column]) -> DataFrame:
    """Documents whose score, in a column of its own for the time being, is to be kept."""
    name = fresh(docs, "score")
    return score(docs, name).where(keep(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold.

    Null and empty texts have the score of an empty text; whole texts of any
    length are scored; equal texts have equal scores, so repeated rows stay or
    go together; without labels of both kinds, and of an empty table, every
    document stays.
    """
    model = toxicity.fit(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"))
    return _scored(docs, lambda d, name: toxicity.score(d, model, name), lambda score: score < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold.

    Null and empty texts have the score of the bare bias; whole texts of any
    length are scored; repeated rows stay or go together; without labels of
    both kinds, and of an empty table, every document stays.
    """
    model = quality.fit(docs, load(spark, sf_dir, "labels", "doc_id", "quality"))
    return _scored(docs, lambda d, name: quality.score(d, model, name), lambda score: score >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Of rows that share it, the text's hash decides, then that of all columns.
    Rows without an id stand behind all others. Null and empty texts are one
    group; whole texts of any length count; an empty table stays empty.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' weights take them, none for some and up to three times for others.

    Null sources are a source; null, empty and very long texts have the size
    that they have; null ids and repeated rows are documents like any other;
    an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the packed ids of every text.

    Null texts are encoded as empty ones, whole texts of any length; null ids
    and repeated rows stay as they are; an empty table gives no rows.
    """
    import public_tokenizers

    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe.digests(bpe.round_trip(docs, path, pattern), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifiers and the sampling have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
