"""Corpus plans, sources and the streaming scan on the cases of FIXTURES C6."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quiresmith.operators.raster import row_classes, row_profile
from quiresmith.plans import catalog, corpus, settings
from quiresmith.sources import readers, schemas, sinks
from quiresmith.streaming import logs

AUDIT = "name string, questions array<int>, faults array<string>, ord int"


def audit_rows(spark, *rows):
    return spark.createDataFrame([(n, q, f, k) for k, (n, q, f) in enumerate(rows)], AUDIT)


def held(spark, **papers):
    return spark.createDataFrame([(p, n) for p, numbers in papers.items() for n in numbers], "paper string, number int")


QP, MS = "9702_s25_qp_21", "9702_s25_ms_21"


@pytest.mark.parametrize(
    ("rows", "pictures", "want"),
    [
        ([(QP, [1, 3], ["gap"]), (MS, [1, 2], [])], {QP: [1, 2], MS: [1, 2]}, {QP: ("clean", []), MS: ("clean", [])}),
        ([(QP, [1, 3], ["clipped", "gap"]), (MS, [1, 2], [])], {QP: [1, 2], MS: [1, 2]}, {QP: ("review", ["clipped", "gap"]), MS: ("review", ["no usable partner"])}),
        ([(QP, [1], ["shredded"]), (MS, [1], [])], {QP: [1], MS: [1]}, {QP: ("clean", []), MS: ("clean", [])}),
        ([(QP, [1], []), (MS, [1], [])], {QP: [1]}, {QP: ("review", ["no usable partner"])}),
        ([("9701_s24_qp_22", [1], ["stale"]), ("9701_s24_ms_22", [1], ["stale"])], {"9701_s24_qp_22": [1, 2, 3, 4, 5], "9701_s24_ms_22": [1, 2, 3, 4]}, {"9701_s24_qp_22": ("clean", []), "9701_s24_ms_22": ("clean", [])}),
        ([(QP, [1], ["gap"]), (QP, [1], []), ("notes", [], [])], {QP: [1, 2], "notes": [1]}, {QP: ("review", ["gap"]), "notes": ("clean", [])}),
    ],
)
def test_classification(spark, rows, pictures, want):
    found = corpus.classify(audit_rows(spark, *rows), held(spark, **pictures)).collect()
    assert {r["name"]: (r["verdict"], r["reasons"]) for r in found} == want


def test_repair_targets(spark):
    rows = audit_rows(
        spark,
        (QP, list(range(1, 12)), ["pair-mismatch"]),
        (MS, list(range(2, 12)), ["gap", "pair-mismatch"]),
        ("9700_s25_qp_51", [], ["no-questions"]),
        ("9709_s25_qp_11", [1, 2, 4], ["gap"]),
        ("9709_s25_qp_12", [2, 1], ["missing-part"]),
        ("9709_s25_qp_13", [1], ["clipped"]),
        ("cover", [], ["gap"]),
    )
    families = spark.createDataFrame([("9700_5", 2, True), ("9709_1", 11, False)], "family string, questions int, certain boolean")
    found = {r["name"]: (r["target"], r["source"]) for r in corpus.repair_targets(rows, families).collect()}
    assert found == {MS: (list(range(1, 12)), "partner"), "9700_s25_qp_51": ([1, 2], "family"), "9709_s25_qp_11": ([1, 2, 3, 4], "gap")}
    done = spark.createDataFrame([(MS,)], "name string")
    there = spark.createDataFrame([("9700_s25_qp_51",)], "name string")
    assert [r["name"] for r in corpus.repair_targets(rows, families, done, there).collect()] == ["9700_s25_qp_51"]


def test_repair_outcomes(spark):
    tried = spark.createDataFrame(
        [("a", [1, 2, 3], [1, 2], [1, 2, 3], "partner", None), ("b", [1, 2, 3], [1, 2], [1, 2], "family", None), ("c", [1], [1, 2], [1, 2], "gap", None), ("d", [1], [1, 2], [1, 2, 3], "gap", None), ("e", [1], [1], [1, 2], "gap", None), ("f", [1], [], [1], "gap", "boom")],
        "name string, before array<int>, after array<int>, target array<int>, source string, error string",
    )
    assert {r["name"]: r["outcome"] for r in corpus.repair_outcome(tried).collect()} == {"a": "worse", "b": "repaired", "c": "repaired", "d": "improved", "e": "no better", "f": "error"}


def test_match_up_and_revert(spark):
    rows = audit_rows(spark, (QP, [1, 2], ["pair-mismatch"]), (MS, [2], ["gap", "pair-mismatch"]), ("9702_w25_qp_21", [2], ["gap", "pair-mismatch"]), ("9702_w25_ms_21", [3], ["gap", "pair-mismatch"]))
    found = {r["name"]: (r["target"], r["action"]) for r in corpus.match_ups(rows).collect()}
    assert found == {MS: ([1, 2], "match"), "9702_w25_qp_21": (None, "stuck"), "9702_w25_ms_21": (None, "stuck")}
    clean = audit_rows(spark, (MS, [1, 2], ["shredded"]), ("9702_w25_ms_21", [1], ["gap"]))
    repaired = spark.createDataFrame([(QP, [], [1, 2, 3]), ("9702_w25_qp_21", [], [1])], "name string, before array<int>, after array<int>")
    assert {r["name"]: r["action"] for r in corpus.revert_plan(repaired, clean).collect()} == {QP: "keep", "9702_w25_qp_21": "undo"}


def test_double_check_requeue_and_hands(spark):
    papers = spark.createDataFrame([("a", [1, 2], [1, 2], 0, 0), ("b", [1, 3], [1, 2, 3], 1, 1), ("c", [], None, 0, 0)], "name string, numbers array<int>, mate_numbers array<int>, cut int, empty int")
    found = {r["name"]: r["reasons"] for r in corpus.double_check(papers).collect()}
    assert found == {"a": [], "b": ["not one to n", "partner has another count", "cut edges", "empty pictures"], "c": ["not one to n"]}
    log = spark.createDataFrame([("x",), ("y",)], "name string")
    names, left = corpus.requeue(audit_rows(spark, ("x", [1], ["gap"]), ("y", [1], ["shredded"])), log)
    assert [r["name"] for r in names.collect()] == ["x"] and [r["name"] for r in left.collect()] == ["y"]
    hands = corpus.by_hand(spark.createDataFrame([("9702_w16_ms_51",), ("z",)], "name string")).collect()
    assert [(r["name"], r["target"]) for r in hands] == [("9702_w16_ms_51", [1, 2])]


def test_hand_over(spark):
    whole = [(f"9702_{s}_{side}_{v}", n, size) for s, v in (("s25", 21), ("w25", 21), ("s24", 22)) for side in ("qp", "ms") for size in ("web", "full") for n in (1, 2)]
    whole += [("9702_s23_qp_21", n, size) for size in ("web", "full") for n in (1, 2)]
    artifacts = spark.createDataFrame(whole, "paper string, number int, size string")
    pending = spark.createDataFrame([("9702_w25_ms_21",)], "name string")
    rows = audit_rows(spark, ("9702_s25_qp_21", [1, 2], ["stale"]), ("9702_s24_qp_22", [1, 2], ["gap"]))
    assert [(r["session"], r["variant"], r["questions"]) for r in corpus.hand_over(artifacts, rows, pending).collect()] == [("s25", "21", 2)]


def test_audit_faults(spark):
    spans = [("d", 0, 0, 50.0, 100.0, "1"), ("d", 0, 1, 60.0, 100.5, "(b)"), ("d", 0, 2, 50.0, 150.0, "2"), ("d", 0, 3, 200.0, 160.0, "(l)"), ("d", 1, 0, 50.0, 100.0, "2"), ("d", 1, 1, 60.0, 99.0, "(a)"), ("d", 2, 0, 50.0, 100.0, "4")]
    spans_df = spark.createDataFrame(spans, "doc string, page int, ord int, left double, y double, text string")
    starts = spark.createDataFrame([("d", 0, 100.0, 1), ("d", 1, 100.0, 2), ("d", 2, 100.0, 4)], "doc string, page int, y double, number int")
    parts = corpus.interval_faults(spans_df, starts)
    assert {r["number"]: (r["first_part"], r["foreign"]) for r in parts.collect()} == {1: ("b", True), 2: ("a", False), 4: (None, False)}
    documents = spark.createDataFrame([("d", "qp"), ("e", "ms")], "doc string, kind string")
    flags = spark.createDataFrame([("d", True, 2, None, None)], "doc string, shredded boolean, rotations int, furniture string, error string")
    rows = corpus.audit(documents, starts, parts, flags)
    assert {r["name"]: r["faults"] for r in rows.collect()} == {"d": ["foreign-label", "gap", "missing-part", "mixed-rotation", "shredded"], "e": ["no-questions"]}
    full = corpus.audit_outputs(rows, held(spark, d=[1, 2]), spark.createDataFrame([("d", 0.9)], "paper string, worst double"), held(spark, d=[1]))
    assert {r["name"]: set(r["faults"]) for r in full.collect()} == {"d": {"foreign-label", "gap", "missing-part", "mixed-rotation", "shredded", "clipped", "stale"}, "e": {"no-questions", "no-output"}}


def test_row_classes(spark):
    ink = [("i", 0, [False] * 10), ("i", 1, [True] * 8 + [False] * 2), ("i", 2, [True] + [False] * 9)]
    rows = row_classes(row_profile(spark.createDataFrame(ink, "img string, y int, ink array<boolean>")), True).orderBy("y").collect()
    assert [(r["blank"], r["seam"], r["divider"], r["longest"]) for r in rows] == [(True, True, False, 0), (False, False, True, 8), (False, True, False, 1)]


def test_sources(spark, tmp_path):
    for name in ("a/9702_s25_qp_21_q1.png", "a/9702_s25_qp_21_q2.png", "a_web/9702_s25_qp_21_q1.png", "old/x/9702_s25_qp_21_q3.png", "a/cover.png", "a/notes.txt"):
        path = tmp_path / "out" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    files = readers.inventory(spark, str(tmp_path / "out"), "*.png")
    kept = readers.artifacts(files, set_aside=("old",))
    assert sorted((r["folder"], r["number"]) for r in kept.collect()) == [("a", 1), ("a", 2)]
    assert readers.inventory(spark, str(tmp_path / "out"), "*.png", only="cover").count() == 1
    wanted = spark.createDataFrame([("9702_s25_qp_21_q1",), ("none",)], "name string")
    assert [r["path"].split("/")[-2] for r in readers.located(wanted, files).collect()] == ["a"]
    (tmp_path / "todo.txt").write_text("a b\n  b c\n")
    assert sorted(r["name"] for r in readers.tokens(spark, str(tmp_path / "todo.txt")).collect()) == ["a", "b", "c"]
    log = tmp_path / "log.jsonl"
    log.write_text('{"paper": "p1", "status": "ok"}\nnot json\n{"paper": "p1", "status": "error"}\n{"paper": "p2", "status": "error"}\n')
    rows = readers.log_lines(spark, str(log), schemas.BATCH_LOG, "paper")
    assert {r["paper"]: r["status"] for r in rows.collect()} == {"p1": "error", "p2": "error"}
    with pytest.raises(Exception):  # noqa: B017 - a strict scan ends with Spark's own error
        readers.log_lines(spark, str(log), schemas.BATCH_LOG, "paper", strict=True).collect()
    todo = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "path string")
    assert [r["path"] for r in logs.resume(todo, rows).collect()] == ["p3"]


def test_json_and_catalog(spark, tmp_path):
    (tmp_path / "audit.json").write_text(json.dumps([{"name": "a", "kind": "qp", "questions": [1], "faults": ["gap"], "detail": {"rotations": [0, 90]}}, {"name": "b", "faults": []}]))
    rows = readers.json_document(spark, str(tmp_path / "audit.json"), schemas.AUDIT).collect()
    assert [(r["name"], r["faults"]) for r in rows] == [("a", ["gap"]), ("b", [])] and rows[0]["detail"]["rotations"] == [0, 90]
    form = {"subject": "physics", "paper": "1", "variant": "1", "chapter": "dynamics", "year": "2025", "season": "mj", "question": "19", "kind": "Q", "subtopic": "x", "difficulty": "", "marks": "7", "youtube_url": ""}
    forms = spark.createDataFrame([{**form, "seq": 1}, {**form, "paper": "9", "seq": 2}])
    assert [len(r["problems"]) for r in catalog.checked(forms).orderBy("seq").collect()] == [0, 1]
    empty = spark.createDataFrame([], "stem string, " + schemas.CATALOG)
    merged = catalog.export(forms, empty)
    assert [(r["stem"], r["marks"]) for r in merged.collect()] == [("physics_p11_dynamics_2025mj_q19", "7")]
    sinks.write_catalog(merged, str(tmp_path / "rows"))
    back = readers.catalog_csv(spark, str(tmp_path / "rows")).collect()
    assert [(r["stem"], r["q_filename"]) for r in back] == [("physics_p11_dynamics_2025mj_q19", "physics_p11_dynamics_2025mj_q19_Q.png")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "name string, n int")
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.rewrite_json(rows, str(tmp_path / "table"))
    sinks.rewrite_json(rows, str(tmp_path / "table"))
    assert spark.read.json(str(tmp_path / "table")).count() == 1


def test_stream_hands_over_each_ok_row_once(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "1.json").write_text('{"name": "a", "status": "ok"}\n{"name": "b", "status": "error"}\n')
    seen = []
    run = lambda: logs.process(logs.finished(logs.follow(spark, str(folder))), lambda df, _: seen.extend(r["name"] for r in df.collect()), str(tmp_path / "state"), once=True).awaitTermination(120)
    run()
    (folder / "2.json").write_text('{"name": "a", "status": "ok"}\n{"name": "b", "status": "ok"}\n')
    run()
    assert seen == ["a", "b"]


def test_settings_and_changes(spark, tmp_path):
    base = settings.CleanSettings(cut_on_rules=True)
    assert settings.profile_for("qp", base).cut_on_rules is True and settings.profile_for("qp").trim_end_matter is True
    (tmp_path / "f.json").write_text(json.dumps({"9700_2": {"questions": 6, "share": 1.0, "papers": 68, "seen": {"6": 68}, "certain": True}}))
    assert settings.load_families(spark, str(tmp_path / "f.json")).first()["seen"] == {6: 68}
    log = spark.createDataFrame([("a", 2), ("b", 1)], "name string, questions int")
    changed = corpus.changed_counts(audit_rows(spark, ("a", [1, 2], []), ("b", [1, 2], [])), log)
    assert [tuple(r) for r in changed.collect()] == [("b", 1, 2)]
    assert logs.latest(spark.createDataFrame([("a", 1), ("a", 2)], "name string, ord int")).first()["ord"] == 2


def test_entry_stands_without_the_training_data_part(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quiresmith", tmp_path / "quiresmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'family_shape' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_registered_sql_runs_and_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    from quiresmith.plans import registry

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    db = duckdb.connect()
    for table in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else str(v)
    for name in ("family_shape", "sequence_complete", "runs_islands", "consensus_having", "classify_clean", "repair_target", "asof_backward_tolerance", "page_spec", "furniture_geometry", "stacked_layout"):
        df = registry.QUERIES[name](spark, str(folder))
        columns = sorted(df.columns)
        ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
        theirs = sorted(tuple(map(plain, r)) for r in db.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall())
        assert ours == theirs, name
