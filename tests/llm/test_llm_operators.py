"""Training-data operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quiresmith.llm import bpe, graph, learning, licenses, lm, mixing, quality, simhash, topk, toxicity, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the of and to in is ti on er re st nd ou ea ha th es en".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(1, 120)), f"s{k % 4}") for k in range(120)]
    rows += [(200 + k, rows[k][1], "s0") for k in range(10)]  # exact copies
    rows += [(220 + k, rows[20 + k][1] + " tail", "s1") for k in range(10)]  # near copies
    rows += [(300, None, None), (301, "", "s1"), (302, " \t\n", "s2"), (303, prose(rng, 30_000), "s3"), (None, "no id here", "s1"), (304, "Ünïcode ÀÉ ABC", "s2"), (304, "Ünïcode ÀÉ ABC", "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, "x", 1) for r in texts], "doc_id long, text string, source string, size string, score int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# Mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling by rounds, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, left, total = {}, set(order), float(sum(sizes.values()))
    while left:
        level = (total - sum(full.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > most * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in left}
        full |= {s: float(most * sizes[s]) for s in over}
        left -= over
    return full


def test_mix_meets_targets(docs, texts):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, source in texts:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(dict(sizes))
    assert len(rows) == len(texts)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[r["source"]] += r["size"] * r["copies"]
    for s in ("s0", "s1", "s2"):
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 60
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["copies"])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((key(r) for r in rows)) == sorted((key(r) for r in again))


def test_mix_levels_and_empty(spark, none):
    many = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "cast(id % 2 as string) as source")
    rows = mixing.mix(many, block_rows=16).collect()
    assert len(rows) == 400 and {r["copies"] for r in rows} <= {0, 1, 2}
    for s in ("0", "1"):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) < 40
    assert mixing.mix(none).count() == 0


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(1)
    sizes = rng.lognormal(4, 1, 300).astype(int).tolist()
    hits = np.zeros(300)
    for seed in range(60):
        out = mixing.fly(sizes, [0.3] * 300, random.Random(seed), 0)
        assert set(out) <= {0.0, 1.0}
        assert abs(np.dot(out, sizes) - 0.3 * sum(sizes)) < 40 and abs(sum(out) - 90) <= 3
        hits += out
    assert abs(hits.mean() / 60 - 0.3) < 0.02


def test_mixed_rows_repeat_documents(docs, texts):
    copies = sum(r["copies"] for r in mixing.mix(docs).collect())
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert abs(rows.count() - copies) <= 3  # repeated rows share a draw


# WARC


def test_warc_round_trip(spark, none):
    rng = random.Random(5)
    odd = ["\r\n\r\n", "\r\n\r\n\r\nWARC/1.1\r\n\r\n", "a\r\n", "\r", "é" * 999, "x" * 5000 + "\r\n\r\n" + "WARC/1.1", "", None]
    odd += ["".join(rng.choices("\r\nab", k=rng.randint(0, 400))) for _ in range(40)]
    rows = [(k, f"http://h/{k}\r\nX: y", html, 0) for k, html in enumerate(odd)]
    rows += [(100 + k, None, odd[k], 0) for k in range(8)] + [(7, "dup", "", 0), (None, "u", "null id", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, data int")
    chunks = warc.round_trip(pages.repartition(3), chunk_bytes=64, with_data=True).collect()
    first = {}
    for k, _, html, _ in rows:
        if k is not None:
            first[html or ""] = min(first.get(html or "", k), k)
    want = Counter()
    for k, _, html, _ in rows:
        body = (html or "").encode()
        kind = "response" if k is None or first[html or ""] == k else "revisit"
        want[k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, first[html or ""] if kind == "revisit" else None] += 1
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in chunks if r["last"])
    assert got == want
    whole = {}
    for r in sorted((r for r in chunks if r["record_type"] == "response" and r["page_id"] is not None and r["page_id"] != 7), key=lambda r: r["chunk_no"]):
        assert len(r["data"]) <= 64
        whole[r["page_id"]] = whole.get(r["page_id"], b"") + r["data"]
    assert whole[5] == odd[5].encode() and whole[1] == odd[1].encode()
    empty = pages.where("false")
    assert warc.round_trip(empty).count() == 0


def test_warc_damage_is_an_error():
    parser = warc._Parser()
    head = warc._record("response", "urn:x-page:1", 3, WARC_Payload_Digest="sha1:AAAA")
    with pytest.raises(ValueError):
        parser.feed(head + b"abc" + warc.END, [])


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN


def test_bpe_equals_the_library(spark, docs, none, texts, vocabulary):
    import tiktoken

    path, pattern = vocabulary
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    codec = bpe.codec(path, pattern)
    rng = random.Random(7)
    pools = ["ab", "aeiou \n\t  ", "0123456789 ", "ֈ՘一é ñ", "'s're t", "🙂👩‍👧ᲀ\U00018d80", "\x1c\x85\xa0 x", "<|endoftext|>"]
    for k in range(600):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60)))
        assert codec.encode(text).tolist() == library.encode_ordinary(text), repr(text)
    for text in ("a" * 50_000, "".join(rng.choices("abcdefghij", k=20_000))):
        assert codec.encode(text).tolist() == library.encode_ordinary(text)
    rows = bpe.digests(bpe.decode(bpe.encode(docs, path, pattern), path, pattern)).collect()
    want = Counter()
    for k, text, _ in texts:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want[k, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    assert Counter(map(tuple, bpe.digests(bpe.round_trip(docs, path, pattern)).collect())) == want
    assert bpe.encode(none, path, pattern).count() == 0


# Classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(700):
        toxic, poor = rng.random() < 0.2, rng.random() < 0.25
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "idiotic", "rotten"]))
        if poor:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), "l", "s", "extra"))
        labels.append((k, int(not poor), int(toxic)))
    rows += [(9001, None, None, None, None), (9002, "", None, None, None), (None, "plain words here", None, None, None), (5, rows[5][1], "l", "s", "extra")]
    labels += [(None, 1, 1), (9003, None, None), (5, None, None), (6, labels[6][1], labels[6][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: (q, t) for k, q, t in labels if q is not None and k is not None}


@pytest.mark.parametrize(("module", "place", "bar"), [(toxicity, 1, 0.95), (quality, 0, 0.95)])
def test_classifier_on_held_out_rows(spark, labelled, module, place, bar):
    docs, labels, truth = labelled
    rows = module.verdicts(docs, labels).collect()
    assert len(rows) == docs.count()
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= module.THRESHOLD)
        if r["held_out"] and r["doc_id"] in truth:
            right.append(r["predicted"] == truth[r["doc_id"]][place])
    assert len(right) > 80 and np.mean(right) >= bar
    assert module.verdicts(docs.where("false"), labels).count() == 0
    assert module.verdicts(docs.limit(3), labels.where("false")).count() == 3


def test_classifiers_never_read_held_out_labels(labelled):
    from pyspark.sql import functions as F

    docs, labels, _ = labelled
    sample = learning.labelled_sample(docs, labels, "toxic", 100).collect()
    assert 0 < len(sample) <= 101  # a document that repeats a row comes twice
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in sample)
    swapped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r["doc_id"], r["score"]) for r in toxicity.verdicts(docs, x).collect()} for x in (labels, swapped))
    assert a == b


def test_isotonic_is_monotone_and_close():
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x))).astype(int)
    knots, values = learning.isotonic(x, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all()
    assert abs(np.interp(0.0, knots, values) - 0.5) < 0.12


def test_dual_descent_separates():
    rows = [np.array([k % 2, 2 + k % 5], np.int32) for k in range(60)]
    y = np.array([k % 2 for k in range(60)])
    ratio = quality.log_ratios(rows, y)
    w, bias = quality.descend(rows, y, ratio)
    model = quality.Model(ratio, w, bias, ((0.0,), (0.0,)))
    assert all((model.margin(r) > 0) == bool(c) for r, c in zip(rows, y))


# Language model


def test_lm_scores(docs, none, texts):
    rows = lm.score(docs).collect()
    split = [(k, lm.words_of(t)) for k, t, _ in texts]
    crc = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    counts = Counter(w for k, words in split if not crc(k) for w in words)
    n, v = sum(counts.values()), len(counts)
    want = Counter((k, crc(k), len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for k, w in split)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert lm.score(none).count() == 0


def test_lm_small_head_gives_the_same_base(docs):
    full = Counter((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.score(docs).collect())
    assert Counter((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.score(docs, 40, 1).collect()) == full


def test_lm_vocabulary_numbers_and_masses():
    rng = np.random.default_rng(4)

    def coded(values):  # the low bits name a shared member
        values = values.astype(np.uint64)
        return values & ~np.uint64(511) | (values & np.uint64(511)) % np.uint64(lm._SHARED)

    codes = np.unique(coded(rng.integers(0, 1 << 62, 5000)))
    codes[:200] = np.uint64(7 << 44) + np.arange(200).astype(np.uint64) * np.uint64(512)  # one slot of the table
    counts = rng.integers(1, 50, len(codes)).astype(float)
    tail = np.arange(lm._SHARED, dtype=float)
    known = lm.Vocabulary(codes, counts, tail, tail / 2, 1000, 30)
    assert (known.numbers(known.codes) == np.arange(len(codes))).all() and (np.diff(known.counts[: len(codes)]) <= 0).all()
    others = np.setdiff1d(coded(rng.integers(0, 1 << 62, 3000)), codes)
    assert (known.numbers(others) == len(codes) + (others & np.uint64(511)).astype(int)).all()
    # What all words of a member share is its mass.
    mass = np.zeros(lm._OWN + lm._SHARED)
    np.add.at(mass, known.leaves, 10**known.shares)
    assert np.allclose(mass, 10**known.log_mass)


def test_lm_gradient_step_by_a_naive_loop():
    rng = np.random.default_rng(2)
    w, squares, bias = rng.standard_normal((32, 5)).astype(np.float32), rng.random(32).astype(np.float32), rng.standard_normal(5).astype(np.float32)
    y, slots = rng.integers(0, 5, 40), rng.integers(0, 32, (3, 40)).astype(np.uint16)
    gradient = np.zeros((32, 5))
    for t in range(40):
        logits = sum(w[s[t]].astype(float) for s in slots) + bias
        p = np.exp(logits) / np.exp(logits).sum()
        p[y[t]] -= 1
        for s in slots:
            gradient[s[t]] += p
    after = squares + (gradient**2).sum(axis=1)
    want = np.where(np.isin(np.arange(32), slots)[:, None], w - lm.RATE * gradient / np.sqrt(after + 1)[:, None], w)
    lm.update(w, squares, bias, y, slots)
    assert np.allclose(w, want, atol=1e-4)
    # Logits far below zero neither overflow nor vanish.
    assert np.isfinite(lm.log_p(w * 0, bias - 500, slots, y)).all()


def test_lm_beats_its_base_and_files_do_not_matter(spark):
    rng = random.Random(5)
    nouns, verbs = [f"n{k}a" for k in range(300)], [f"v{k}o" for k in range(300)]
    rows = [(k, " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(40))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for files in (1, 40):
        got = lm.score(df.repartition(files)).where("held_out").collect()
        found.append(sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got))
        assert found[-1] > sum(r["base_score"] for r in got) / sum(r["n_tokens"] for r in got) + 0.3
    assert abs(found[0] - found[1]) < 0.05


def test_lm_learns_every_pair(spark):
    rng = random.Random(8)
    after = list(range(2000))
    rng.shuffle(after)
    rows = []
    for k in range(700):
        at, words = rng.randrange(2000), []
        for _ in range(60):
            words.append(f"w{at:04d}")
            at = after[at]
        rows.append((k, " ".join(words)))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    # 60 words of which each but the first follows from the one before; the first is one of 2,000.
    assert got and sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got) > -1.0


def test_lm_scores_by_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(["a b a c", "a b b", "c a b", "b", "a c c b a", "d a b", "b a b a", "c c", "a b c d", "d d a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["held_out"], r["score"]) for r in lm.score(df).collect()}
    known, w, _ = lm.learn(df)
    learned = [lm.words_of(t) for k, t in rows if not got[k][0]]
    pairs = Counter(p for words in learned for p in zip([lm.END, *words], words))
    before = Counter(p[0] for words in learned for p in zip([lm.END, *words], words))

    def softmax(logits):
        p = np.exp(logits.astype(float))
        return p / p.sum(axis=1, keepdims=True)

    for k, text in rows:
        words = lm.words_of(text)
        numbers = known.numbers(np.array([lm.code_of(x) for x in words], np.uint64))
        features = lm.histories(numbers, np.array([0]))
        classes = softmax(lm._logits(w[0], known.class_bias, lm._slots(features, lm.CLASS_BITS)))
        members = [softmax(lm._logits(w[1], known.member_bias[[c] * len(words)], lm._member_slots(features, np.full(len(words), c)))) for c in range(lm._CLASSES)]
        leaves = np.concatenate([classes[:, [c]] * m for c, m in enumerate(members)], axis=1)
        total = 0.0
        for at, (a, b) in enumerate(zip([lm.END, *words], words)):
            prior = leaves[at][known.leaves] * 10 ** (known.shares - known.log_mass[known.leaves])
            assert math.isclose(prior.sum(), 1, abs_tol=1e-5)
            p0, rare = prior[numbers[at]], numbers[at] >= len(known.codes)
            total += math.log10((pairs[a, b] + lm.PRIOR * p0) / (before[a] + lm.PRIOR)) - rare * known.shares[numbers[at]]
        assert math.isclose(got[k][1], total, abs_tol=1e-3)


# Top-k


def test_top_k_exact(spark):
    rng = np.random.default_rng(4)
    vectors_ = rng.normal(size=(300, 16)).astype(np.float32)
    vectors_[150:170] = vectors_[7]  # ties
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors_)]
    rows += [(400, None, "x"), (401, [float("nan")] * 16, "x"), (500, [1.0, None], "x"), (600, [float("inf")] * 16, "x"), (None, [0.5] * 16, "x"), (700, [1.0, 2.0], "x"), (701, [2.0, 2.0], "x"), (800, [], "x"), (5, vectors_[5].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.col("vec_id") % 100 == 0, pack_rows=40, block_rows=2).collect()
    ints = {k: np.floor(1024 * np.array(v, float)) for k, v, _ in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, v in ints.items():
        if q % 100 == 0:
            best = sorted((-int(v @ w), k) for k, w in ints.items() if k != q and len(w) == len(v))[:10]
            want |= {(q, r, k, -s) for r, (s, k) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_huge_components(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1e6, 3e6]), (1, [2e4, 1e4]), (2, [1e30, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).collect()}
    assert got == {(2, (1 << 63) - 1), (1, 1024**2 * (10**6 * 2 * 10**4 + 3 * 10**6 * 10**4))}


# Embedding near duplicates


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("cell_rows", [2048, 8])
def test_vector_links(spark, cell_rows):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(120, 24))
    near = base[:30] + 0.02 * rng.normal(size=(30, 24))
    chain = [base[0] * (1 - t) + base[1] * t for t in np.linspace(0, 1, 30)]
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(base)] + [(1000 + k, v.tolist(), k % 2) for k, v in enumerate(near)] + [(2000 + k, v.tolist(), 0) for k, v in enumerate(chain)]
    rows += [(3000 + k, base[3].tolist(), 1) for k in range(5)]
    rows += [(4000, None, 1), (4001, [0.0] * 24, 1), (4002, [float("nan")] * 24, 1), (4003, base[3].tolist(), None), (4004, [1.0, 2.0], 1), (4005, [1.0, 2.0], 1), (4006, (base[5] * 1e200).tolist(), 1), (None, base[3].tolist(), 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df, cell_rows=cell_rows).collect()}
    sound = [(k, np.array(v), c) for k, v, c in rows if k is not None and v is not None and c is not None and np.isfinite(v).all() and np.any(v)]
    unit = [v / np.abs(v).max() for _, v, _ in sound]
    pairs = [(a, b) for a in range(len(sound)) for b in range(a) if sound[a][2] == sound[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / math.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b])) >= 0.98]
    degree = Counter(x for p in pairs for x in p)
    root = components(len(sound), pairs)
    smallest = {}
    for k, (i, _, _) in enumerate(sound):
        smallest[root[k]] = min(smallest.get(root[k], i), i)
    assert len(pairs) > 100 and len(got) == len(rows)
    for k, (i, _, _) in enumerate(sound):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (degree[k], smallest[root[k]], i == smallest[root[k]])
    for i in (4000, 4001, 4002, 4003, None):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_large_cells_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    rng = np.random.default_rng(10)
    rows = [(k, (np.ones(8) + 0.05 * rng.normal(size=8)).tolist(), 1) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    v = np.array([r[1] for r in rows])
    cos = v @ v.T / np.sqrt((v * v).sum(1)[:, None] * (v * v).sum(1))
    pairs = [(a, b) for a in range(150) for b in range(a) if cos[a, b] >= 0.98]
    degree, root = Counter(x for p in pairs for x in p), components(150, pairs)
    assert all(got[k] == (degree[k], min(j for j in range(150) if root[j] == root[k])) for k in range(150))


# SimHash


def plain_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_components(docs, none, texts):
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs.select("doc_id", "text")).collect())
    fps = [plain_fingerprint(t) for _, t, _ in texts]
    root = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    smallest = {}
    for k, (i, _, _) in enumerate(texts):
        if i is not None:
            smallest[root[k]] = min(smallest.get(root[k], i), i)
    assert got == Counter((i, fps[k], smallest.get(root[k])) for k, (i, _, _) in enumerate(texts))
    assert simhash.near_duplicates(none.select("doc_id", "text")).count() == 0


def test_close_pairs_by_brute_force():
    rng = np.random.default_rng(6)
    for n in (1, 2, 63, 64, 65, 300):
        fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for k in range(0, n - 1, 3):
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                fps[k + 1] = fps[k] ^ np.uint64(1 << int(b))
        for radius in (0, 3, 4, 7):
            i, j = simhash.close_pairs(fps, radius)
            want = {(a, b) for a in range(n) for b in range(a + 1, n) if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
            assert set(zip(i.tolist(), j.tolist())) == want


def test_large_buckets_are_tiled(spark):
    rng = random.Random(8)
    fps = sorted({sum(1 << b for b in rng.sample(range(20), 3)) for _ in range(400)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.linked(df, lanes=32).collect()]
    at = {f: k for k, f in enumerate(fps)}
    got = components(len(fps), [(at[a], at[b]) for a, b in edges])
    want = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_one_of_each_group_stays(docs, texts):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    marks = simhash.near_duplicates(docs.select("doc_id", "text")).collect()
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == sorted({r["component_id"] for r in marks if r["component_id"] is not None})


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (7, 7), (3, 2), (3, 2)], "a long, b long")
    assert {(r["node"], r["root"]) for r in graph.components(edges).collect()} == {(k, 0) for k in range(201)} | {(1000, 1000), (1001, 1000)}
    assert graph.components(edges.where("false")).count() == 0


# Licenses


def test_license_scan(spark, none):
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    rng = random.Random(12)
    rows, want = [], Counter()
    for k in range(80):
        parts = [prose(rng, 40) for _ in range(3)]
        for name in rng.sample(sorted(notices), k % 3):
            parts.insert(rng.randrange(len(parts) + 1), notices[name])
        text = "\n".join(parts)
        rows.append((k, text))
        for name, notice in notices.items():
            for m in re.finditer(re.escape(notice), text):
                want[k, name, m.start(), "exact"] += 1
    plain = [(900, None), (901, ""), (902, "a license to print money " * 300), (903, "Licensed under CC BY-NC 3.0."), (904, "Not released under the GPL license."), (904, "x")]
    df = spark.createDataFrame(rows + plain, "doc_id long, text string")
    got = Counter((r["doc_id"], r["license"], r["start"], r["wording"]) for r in licenses.scan_documents(df).collect())
    assert got == want
    assert licenses.scan_documents(none).count() == 0


def test_license_variants():
    found = licenses.scan("Code RELEASED UNDER MIT license; docs licensed under\nCC BY-SA 4.0.")
    assert [(r["license"], r["wording"], r["missing"]) for r in found] == [("MIT", "variant", "the"), ("CC-BY-SA-4.0", "exact", "")]
    assert licenses.scan("Licensed under CC BY 4.0 and CC BY-ND 4.0")[0]["license"] == "CC-BY-4.0"


def test_or_later_is_never_plain():
    from quiresmith.llm.license_texts import TEMPLATES

    rng = random.Random(31)
    later = [(name, wording) for name, wording in TEMPLATES if name.endswith("-or-later")]
    assert len(later) > 40
    for name, wording in later:
        for _ in range(3):
            head, tail = prose(rng, rng.randint(5, 60)), prose(rng, rng.randint(5, 60))
            found = licenses.scan(f"{head}. {wording} {tail}")
            assert [(r["license"], r["start"], r["wording"]) for r in found] == [(name, len(head) + 2, "exact")], wording


def test_licenses_in_long_blocks():
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    rng = random.Random(5)
    for name, notice in notices.items():
        for _ in range(5):
            words = prose(rng, 1400).split()
            words[20::40] = ["license"] * len(words[20::40])
            words.insert(rng.randrange(100, 1300), notice)
            text = " ".join(words)
            assert [(r["license"], r["start"], r["wording"]) for r in licenses.scan(text)] == [(name, text.index(notice), "exact")]
            assert licenses.scan(text)[0]["saved_bytes"] > 0
    # The first word missing, and found elsewhere; the longer of two templates that begin alike.
    long = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0-or-later")
    found = licenses.scan("This is a license. " + long.removeprefix("This "))
    assert [(r["license"], r["missing"]) for r in found] == [("GPL-3.0-or-later", "this")]
    long = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 100)
    assert [(r["license"], r["start"], r["end"]) for r in licenses.scan(long)] == [("Apache-2.0", 0, len(long))]


def test_whole_license_texts():
    from quiresmith.llm.license_texts import _BSD_CONDITIONS, _BSD_DISCLAIMER, _BSD_NAMES

    items = [x if x.endswith(".") else x + "." for x in _BSD_CONDITIONS.strip().replace("met: ", "met:|").replace("disclaimer. ", "disclaimer.|").split("|")[1:]]
    opening = _BSD_CONDITIONS.split("met: ")[0] + "met:"
    for mark in ("{}. ", "({}) ", "* ", ""):
        for gap in ("\n", "\n\n", " "):
            for name, clauses in (("BSD-2-Clause", items), ("BSD-3-Clause", [*items, _BSD_NAMES.strip()])):
                text = gap.join([opening, *(mark.format(k + 1) + x for k, x in enumerate(clauses)), _BSD_DISCLAIMER])
                found = licenses.scan("Copyright 2020 Some One.\n" + text)
                assert [(r["license"], r["wording"]) for r in found] == [(name, "exact")], (mark, gap)
    assert [r["license"] for r in licenses.scan(opening + "\n1. " + items[0])] == ["BSD-2-Clause OR BSD-3-Clause"]
    notice = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for name, *parts in (
        ("GPL-2.0-or-later", "program", "General Public License", "2"),
        ("GPL-3.0-or-later", "program", "General Public License", "3"),
        ("LGPL-2.0-or-later", "library", "Library General Public License", "2"),
        ("LGPL-2.1-or-later", "library", "Lesser General Public License", "2.1"),
        ("AGPL-3.0-or-later", "program", "Affero General Public License", "3"),
    ):
        assert [r["license"] for r in licenses.scan(notice.format(*parts))] == [name]
    # A version at the start of a line is none of a list's numbers.
    assert [r["license"] for r in licenses.scan("This work is licensed under the GNU General Public License, version\n3.")] == ["GPL-3.0"]
    lesser = licenses.scan("This work is licensed under the GNU Lesser General Public License, version 3.")
    assert [(r["license"], r["wording"]) for r in lesser] == [("LGPL-3.0", "exact")]
    assert [r["license"] for r in licenses.scan("This library is licensed under the GNU Library General Public License, version 2.")] == ["LGPL-2.0"]


def test_counts_in_groups_are_those_of_every_chunk(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 200)
    monkeypatch.setattr(lm, "BUCKET", 100)
    want = {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 6)) for r in lm.score(docs.select("doc_id", "text"), head_words=50, rounds=1).collect()}
    monkeypatch.setattr(lm, "DIRECT", 1)
    got = {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 6)) for r in lm.score(docs.select("doc_id", "text"), head_words=50, rounds=1).collect()}
    assert got == want


def test_rows_of_the_count_exchange_grow_with_the_tokens(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(k, prose(rng, 60)) for k in range(640)]
    monkeypatch.setattr(lm, "CHUNK", 300)
    monkeypatch.setattr(lm, "DIRECT", 8)
    made = {}
    for n in (40, 160, 640):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string").coalesce(1)
        known, _, chunks = lm.learn(df, head_words=50, rounds=1)
        vocabulary, buckets = spark.sparkContext.broadcast(known), known.tokens // 150 + 1
        made[n] = lm.exchange(chunks, vocabulary, buckets).count() / chunks.count()
        assert made[n] <= max(8, 2 * buckets**0.5 + 2)
    assert made[640] < 3 * made[160] + 1


def test_sums_of_runs_of_rows():
    rng = np.random.default_rng(1)
    rows, at, firsts = rng.random((50, 4)), rng.integers(0, 50, 200), np.array([0, 1, 5, 6, 40, 41, 199])
    for step in (2, 16, 500):
        assert np.allclose(lm._sums(rows, at, firsts, step), np.add.reduceat(rows[at], firsts, axis=0))
