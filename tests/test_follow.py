"""Logs in order of their commits; the follower that stops at the marker and starts again where it was."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quiresmith.sources import readers, schemas, sinks
from quiresmith.streaming import logs

KIND = "paper string, name string, status string"


def test_commits_order_rows_whatever_their_files_are(spark, tmp_path):
    log = f"{tmp_path}/log"
    numbers = [sinks.append_log(spark.createDataFrame([("p", "n", f"turn {k}"), (f"q{k}", "n", "once")], KIND).repartition(2), log) for k in range(3)]
    assert numbers == [0, 1, 2] and logs.commits(spark, log) == 3
    for file in os.listdir(log):  # one tick for all of them, and the last written first by name
        if file.endswith(".json"):
            os.utime(f"{log}/{file}", (1, 1))
    rows = {r["paper"]: r["status"] for r in readers.log_lines(spark, log, schemas.BATCH_LOG, "paper").collect()}
    assert rows["p"] == "turn 2" and len(rows) == 4
    # A number that was taken is never given again, also when its rows never came.
    os.makedirs(f"{log}/_commits", exist_ok=True)
    open(f"{log}/_commits/{7:012d}", "w").close()
    assert sinks.append_log(spark.createDataFrame([("p", "n", "late")], KIND), log) == 8
    assert "commit" not in readers.log_lines(spark, log, schemas.BATCH_LOG, "paper").columns
    # A log by other hands has no numbers: its files' times count, and ours come after.
    (tmp_path / "log" / "old.json").write_text('{"paper": "p", "name": "n", "status": "old"}\n{"paper": "o", "name": "n", "status": "old"}\n')
    rows = {r["paper"]: r["status"] for r in readers.log_lines(spark, log, schemas.BATCH_LOG, "paper").collect()}
    assert rows["p"] == "late" and rows["o"] == "old"


def test_follower(spark, tmp_path):
    log, own, state, marker = (f"{tmp_path}/{x}" for x in ("log", "own", "state", "stdout.txt"))
    seen: list[str] = []

    def handle(work):
        seen.extend(r["name"] for r in work.collect())
        return work.select("name", F.lit(1).alias("was"))

    def follow(**more):
        logs.follow_log(spark, log, own, handle, state, every=1, **more)

    sinks.append_log(spark.createDataFrame([("1", "a", "ok"), ("2", "b", "error"), ("3", "c", "ok"), ("3", "c", "ok")], KIND), log)
    follow(once=True)
    assert sorted(seen) == ["a", "c"] and logs.commits(spark, own) == 1
    follow(once=True)  # nothing new
    sinks.append_log(spark.createDataFrame([("2", "b", "ok"), ("1", "a", "ok")], KIND), log)
    sinks.append_log(spark.createDataFrame([("4", "d", "ok")], KIND), log)
    assert not logs.ended(spark, marker)
    with open(marker, "w") as file:
        file.write("batch finished" + "." * 500)
    assert not logs.ended(spark, marker)
    with open(marker, "a") as file:
        file.write("\nbatch finished: 4 papers\n")
    follow(marker=marker)  # comes back because the batch has ended
    assert sorted(seen) == ["a", "b", "c", "d"]
    # A new checkpoint reads all again; the follower's own log still knows the names.
    logs.follow_log(spark, log, own, handle, f"{tmp_path}/fresh", once=True)
    assert sorted(seen) == ["a", "b", "c", "d"] and sorted(r["name"] for r in spark.read.json(own).collect()) == ["a", "b", "c", "d"]


def test_a_batch_that_fails_comes_again(spark, tmp_path):
    log, own, state = (f"{tmp_path}/{x}" for x in ("log", "own", "state"))
    sinks.append_log(spark.createDataFrame([("1", "a", "ok")], KIND), log)

    def broken(work):
        raise RuntimeError("no disk")

    with pytest.raises(Exception, match="no disk"):
        logs.follow_log(spark, log, own, broken, state, once=True)
    seen: list[str] = []
    logs.follow_log(spark, log, own, lambda work: (seen.extend(r["name"] for r in work.collect()), work.select("name"))[1], state, once=True)
    assert seen == ["a"]
