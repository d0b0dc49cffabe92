"""The pipeline's stages against brute-force versions of their decisions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quiresmith.llm import bpe, mixing, quality, toxicity
from quiresmith.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    syllables = "the of and to in is ti on er re st nd ou ea ha th es en".split()
    rows, labels = [], []
    for k in range(400):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(15, 60))]
        toxic, poor = k % 6 == 0, k % 5 == 1
        if toxic:
            words[3:3] = ["vile", "rotten", "vile"]
        if poor:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), "en", f"s{k % 3}", 0))
        labels.append((k, int(not poor), int(toxic)))
    rows += [(500 + k, rows[k + 2][1], "en", "s0", 0) for k in range(0, 30, 6)]
    rows += [(600, None, None, None, None), (601, "", "en", "s1", 0), (602, "", "en", "s1", 0), (None, "a row without an id", "en", "s1", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, {k: (q, t) for k, q, t in labels}


def test_stages(spark, folder):
    path, rows, truth = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "mixing", "bpe"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, path), f"test-{name}")
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == COLUMNS
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{path}/labels.parquet"))
            want = [r["doc_id"] for r in before.collect() if model.score([r["text"]])[0] < toxicity.THRESHOLD]
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter(want)
            assert not {k for k, (_, t) in truth.items() if t} & {r["doc_id"] for r in docs.collect()}
        if name == "quality":
            model = quality.fit(before, spark.read.parquet(f"{path}/labels.parquet"))
            want = [r["doc_id"] for r in before.collect() if model.score([r["text"]])[0] >= quality.THRESHOLD]
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter(want)
            clean = {k for k, (q, t) in truth.items() if q and not t}
            assert len(clean & {r["doc_id"] for r in docs.collect()}) >= 0.98 * len(clean)
        if name == "simhash":
            texts = [r["text"] or "" for r in docs.collect()]
            assert len(texts) == len(set(texts)) and set(texts) <= {r["text"] or "" for r in before.collect()}
            assert all(r["doc_id"] is None or r["doc_id"] < 500 or r["doc_id"] >= 600 for r in docs.collect())
        if name == "mixing":
            keyed = before.select("doc_id", "text", "source")
            copies = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(keyed).collect() if r["doc_id"] is not None}
            got = Counter((r["doc_id"], r["source"]) for r in docs.where("doc_id is not null").collect())
            assert got == Counter({k: c for k, c in copies.items() if c})
    public = pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in seen["mixing"].collect():
        ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        want[r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest(), ids] += 1
    assert Counter((*r[:4], bytes(r[4])) for r in seen["bpe"].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect()) == want


def test_stages_leave_further_columns_alone(spark, folder):
    path, _, _ = folder
    names = {"score": 1.5, "fp": 2, "component_id": 3, "__id": 4, "copies": 5, "row": 6, "size": 7, "y": 8}
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({k: F.lit(v) for k, v in names.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, path), f"test-{name}")
        assert docs.columns == [*COLUMNS, *names]
        assert [tuple(r) for r in docs.select(*names).distinct().collect()] == [tuple(names.values())]


def test_run_and_empty_input(spark, folder, tmp_path):
    path, _, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 0
    for table in ("documents", "labels"):
        spark.read.parquet(f"{path}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
