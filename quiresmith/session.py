"""Session helpers: where shared files go, and how a lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only a local
    session, whose one JVM sees one disk, may go without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *facts: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut lineage that outlives executors.

    ``facts`` are aggregates that are taken while it is written; the table's
    ``facts`` has them by name.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    seen = Observation() if facts else None
    (df.observe(seen, *facts) if facts else df).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path, table.facts = path, seen.get if facts else {}
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` gave and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.shared_path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of the data folder, cut to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
