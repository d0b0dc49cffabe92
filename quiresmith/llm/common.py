"""What several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the ASCII white space that separates words.
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), without an array of them."""
    marked = F.regexp_replace(text, WORD, "w")
    return F.coalesce(F.length(F.translate(marked, WHITE, "")), F.lit(0)).cast("long")


def id_crc(column: str) -> Column:
    """CRC-32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


#: Rows of an Arrow batch; texts may be long, and every running task holds a few batches.
BATCH_ROWS = 1024


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python batches of ``BATCH_ROWS`` from now on, unless the user set a size, whatever it is."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in conf.getAll:  # the user's own settings
        conf.set(name, str(BATCH_ROWS))
    return df


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``step`` rows, so that long texts are few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def tiled(rows: DataFrame, keys: list[str], member: str, chunk: int) -> DataFrame:
    """Deal groups into tiles of about ``2 * chunk`` rows that hold every pair of a group together once.

    Adds ``part`` (the row's part of its group), ``tile_i`` and ``tile_j``. A
    group of up to ``2 * chunk`` rows is one tile (0, 0). A larger one is cut
    into parts by the hash of ``member``; each row goes to every tile that
    pairs its part with another, and the tile (i, i) holds part i alone. So a
    hot group is spread over many tasks, and no row is left out.
    """
    hot = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 2 * chunk)
        .select(*keys, F.ceil(F.col("_n") / chunk).cast("int").alias("_parts"))
    )
    dealt = rows.join(hot, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(member), F.col("_parts")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    return (
        dealt.withColumn("_other", other)
        .withColumn("tile_i", F.least("part", "_other"))
        .withColumn("tile_j", F.greatest("part", "_other"))
        .drop("_parts", "_other")
    )


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator puts its own in place of."""
    mine = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores as set it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_rows(docs: DataFrame) -> DataFrame:
    """id, hash, row of docs(doc_id, text, ...): what tells documents apart without their texts, and the whole row as one.

    A row without an id takes one from its text, behind any id in use.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    without_id = digest.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), without_id).alias("id"), digest.alias("hash"), whole.alias("row"))


def one_row_each(rows: DataFrame, keys: list[str], repeated: DataFrame) -> DataFrame:
    """``rows`` with one row for each key; ``repeated`` holds the keys of several rows.

    Of these the row with the smallest hash of all its columns stays. Only they are shuffled.
    """
    some = rows.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return rows.join(repeated, keys, "left_anti").select(*keys, "row").unionByName(some)


#: Keys that hold more than this share of the rows are told to all tasks; there are at most as many as its inverse.
HOT = 1 / 1000


def joined_hot(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has a row for every key and the number ``n`` of its rows.

    The few keys that hold a large share of ``total`` rows are broadcast, so
    their rows stay where they are; the rows of all others are shuffled. Where
    there are no more rows than ``total``, at most 1 / HOT keys are hot.
    """
    hot = facts.where(F.col(n) > HOT * total)
    found = rows.join(F.broadcast(hot.drop(n)), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return found.unionByName(rest.join(facts.where(F.col(n) <= HOT * total).drop(n), key))


def streamed(held: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """Rows of ``held`` (kind 0) and ``asked`` (kind 1) by shard, a shard's held rows first: what a task needs to keep what is held and let the rest stream by.

    Both have a column ``shard`` from 0; other columns are those of either, null where the other has them not.
    """
    both = held.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind")
