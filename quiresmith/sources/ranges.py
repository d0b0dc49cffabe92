"""Tables that are kept in ranges of their key, so that a change rewrites the ranges that it touches and no others.

A table is a folder: ``data`` has a folder for each range as it was written,
and ``versions`` a short list for each version, with the ranges that make it
up: their folders, first keys and numbers of rows. A version appears by a
rename, under a number that no other writer can have; readers take the
highest. What no version needs any more goes with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiresmith.operators.columns import fresh
from quiresmith.operators.upsert import upsert
from quiresmith.session import discard, materialize

#: Rows of a range, about; one that has grown to more than twice as many is cut.
ROWS = 1 << 20


@dataclass(frozen=True)
class Range:
    """A range of keys, from ``first`` (null: from the start) to the next one's, as it stands in ``folder``."""

    folder: str
    first: str | None
    rows: int


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read, in order."""
    store, folder = _store(spark, path), _path(spark, path, "versions")
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")


def _listed(spark: SparkSession, path: str, version: int) -> dict:
    stream = _store(spark, path).open(_path(spark, path, "versions", f"{version:012d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def ranges(spark: SparkSession, path: str, version: int | None = None) -> list[Range]:
    """The ranges of a version, the last by default, in order of keys."""
    known = versions(spark, path)
    return [Range(**r) for r in _listed(spark, path, known[-1] if version is None else version)["ranges"]] if known else []


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at a version, the last by default."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"there is no table at {path}")
    listed = _listed(spark, path, known[-1] if version is None else version)
    folders = [f"{path}/data/{r['folder']}" for r in listed["ranges"]]
    return spark.read.schema(listed["schema"]).parquet(*folders) if folders else spark.createDataFrame([], listed["schema"])


def _publish(spark: SparkSession, path: str, made: list[Range], schema: str, key: str, after: int) -> int:
    """Makes the version that follows ``after``; an error if there is one already."""
    store, name = _store(spark, path), f"{after + 1:012d}.json"
    draft, final = _path(spark, path, "versions", f".{name}-{uuid.uuid4().hex}"), _path(spark, path, "versions", name)
    store.mkdirs(final.getParent())
    stream = store.create(draft, False)
    stream.write(bytearray(json.dumps({"key": key, "schema": schema, "ranges": [asdict(r) for r in made]}).encode()))
    stream.close()
    # The marker is made by one writer only, so the rename has no rival.
    marker = _path(spark, path, "versions", f".{name}.taken")
    try:
        store.create(marker, False).close()
    except Exception as taken:
        store.delete(draft, False)
        if store.exists(marker):
            raise RuntimeError(f"another writer has made version {after + 1} of {path}") from taken
        raise
    store.rename(draft, final)
    return after + 1


def _place(text: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds a text is not below; 0 for null. Each is a search, however many bounds there are."""

    @F.arrow_udf("int")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([0 if t is None else bisect_right(bounds, t) for t in texts.to_pylist()], pa.int32())

    return found(text) if bounds else F.lit(0)


def _lot(key: str, firsts: list[str | None]) -> Column:
    """Number of the range that a key belongs to, by a search in the first keys."""
    return _place(F.col(key).cast("string"), firsts[1:])


def _cuts(marked: DataFrame, lot: str, key: str, sizes: dict[int, int], rows: int) -> dict[int, list[str]]:
    """Keys at which lots that are too long are cut in pieces of ``rows`` rows; one job for all of them, whose tasks hold ``ROWS`` rows or so."""
    long = {k: n for k, n in sizes.items() if n > 2 * rows}
    if not long:
        return {}
    parts = max(1, -(-sum(long.values()) // ROWS))
    dealt = marked.select(lot, F.col(key).cast("string").alias("k")).join(F.broadcast(marked.sparkSession.createDataFrame([(k,) for k in long], f"`{lot}` int")), lot, "left_semi")
    held = dealt.where("k is not null").repartitionByRange(parts, lot, "k").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part", lot).orderBy("k")) - 1
    found = held.withColumn("n", place).where(F.col("n") % rows == 0).select(lot, "k").distinct().collect()  # a row for each piece
    cuts: dict[int, list[str]] = {}
    for k, first in sorted(map(tuple, found)):
        cuts.setdefault(k, []).append(first)
    return {k: firsts[1:] for k, firsts in cuts.items()}


def _written(table: DataFrame, path: str, key: str, lot: Column, firsts: list[str | None], rows: int) -> list[Range]:
    """Writes rows by lot, a lot cut in pieces of about ``rows`` rows where it has more than twice as many."""
    own, piece = fresh(table, "lot_"), fresh(table, "piece_")
    marked = materialize(table.withColumn(own, lot.cast("int")), "ranges-new")
    sizes = {r[own]: r["count"] for r in marked.groupBy(own).count().collect()}  # a row for each range that is touched
    cuts = _cuts(marked, own, key, sizes, rows)
    # A row's piece follows from its place among the cuts of all lots, which are in order of keys, less those of the lots before.
    every = [c for k in sorted(cuts) for c in cuts[k]]
    before, passed = {}, 0
    for k in sorted(sizes):
        before[k] = passed
        passed += len(cuts.get(k, []))
    spark, batch = table.sparkSession, uuid.uuid4().hex
    starts = F.broadcast(spark.createDataFrame(list(before.items()), f"`{own}` int, `{piece}` int"))
    keyed = marked.join(starts, own) if before else marked.withColumn(piece, F.lit(0))
    keyed = keyed.withColumn(piece, F.greatest(_place(F.col(key).cast("string"), every) - F.col(piece), F.lit(0)))
    out = keyed.withColumn("range", F.concat_ws("-", F.lit(batch), own, piece)).drop(own, piece)
    out.repartition("range").sortWithinPartitions("range", key).write.partitionBy("range").mode("append").parquet(f"{path}/data")
    made = sorted(tuple(r) for r in keyed.groupBy(own, piece).count().collect())
    discard(marked)
    return [Range(f"range={batch}-{k}-{p}", cuts[k][p - 1] if p else firsts[k], n) for k, p, n in made]


def create(table: DataFrame, path: str, key: str, rows: int = ROWS) -> int:
    """Makes a table of ranges of about ``rows`` rows; the number of its first version. Keys are compared as texts; null comes first."""
    spark = table.sparkSession
    made = _written(table, path, key, F.lit(0), [None], rows)
    return _publish(spark, path, made, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema), key, -1)


def upsert_into(staged: DataFrame, path: str, columns: list[str], blanks_overwrite: bool, rows: int = ROWS) -> int:
    """Merges rows(key, seq, columns) into a table as ``upsert`` does, and makes the next version of it.

    Only ranges that hold or should hold a staged key are read and written;
    the version names the others as they are. Without staged rows the version
    stays. Of two writers at once the second ends with an error, and nothing
    of it shows.
    """
    spark, last = staged.sparkSession, versions(staged.sparkSession, path)[-1]
    listed = _listed(spark, path, last)
    key, known = listed["key"], [Range(**r) for r in listed["ranges"]]
    firsts = [r.first for r in known] or [None]
    touched = sorted(r[0] for r in staged.select(_lot(key, firsts).alias("lot")).distinct().collect())
    if not touched:
        return last
    mine = [known[k] for k in touched if k < len(known)]
    old = spark.read.schema(listed["schema"]).parquet(*(f"{path}/data/{r.folder}" for r in mine)) if mine else spark.createDataFrame([], listed["schema"])
    merged = upsert(old, staged, key, columns, blanks_overwrite).select(*old.columns)
    made = _written(merged, path, key, _lot(key, firsts), firsts, rows)
    left = [r for k, r in enumerate(known) if k not in touched]
    order = sorted([*left, *made], key=lambda r: (r.first is not None, r.first or ""))
    return _publish(spark, path, order, listed["schema"], key, last)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all but the last ``keep`` versions and the ranges that only they had; the number of ranges removed."""
    store, known = _store(spark, path), versions(spark, path)
    stay = known[-keep:]
    needed = {r.folder for v in stay for r in ranges(spark, path, v)}
    gone = {f.getPath().getName() for f in store.listStatus(_path(spark, path, "data")) if f.getPath().getName().startswith("range=")} - needed
    for v in set(known) - set(stay):
        store.delete(_path(spark, path, "versions", f"{v:012d}.json"), False)
    for folder in gone:
        store.delete(_path(spark, path, "data", folder), True)
    return len(gone)
