"""Training-data operators on repeated ids, clashing columns, hot keys and planted variants."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiresmith.llm import common, graph, learning, licenses, mixing, quality, simhash, topk, toxicity, vectors
from quiresmith.llm.license_texts import TEMPLATES

CLASHING = "doc_id long, text string, source string, __id long, `__hash` long, fp long, score double, component_id long, id string, hash int, `row` int, n int, `_n` int"


@pytest.fixture(scope="module")
def clashing(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(words, k=30)), f"s{k % 2}", 77 + k, 88 + k, k, 0.5 + k, -k, f"i{k}", k, 2 * k, 3 * k, 4 * k) for k in range(40)]
    rows.append((100, rows[0][1], "s0", *rows[0][3:]))  # a copy that goes
    rows += [rows[5]]  # the same row twice
    return rows, spark.createDataFrame(rows, CLASHING)


def test_columns_of_the_user_stay(clashing):
    rows, df = clashing
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter(set(rows) - {r for r in rows if r[0] == 100})
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and set(map(tuple, mixed.collect())) <= set(rows)
    found = simhash.near_duplicates(df)
    assert found.columns.count("fp") == 1 and {(r["doc_id"], r["id"], r["hash"]) for r in found.collect()} == {(r[0], r[8], r[9]) for r in rows}
    for module in (toxicity, quality):
        scored = module.score(df, None)
        assert scored.columns == [c for c in df.columns if c != "score"] + ["score"]
        assert {r["score"] for r in scored.collect()} == {0.0 if module is toxicity else 1.0}


def test_rows_that_differ_beside_id_and_text_are_chosen_by_rule(spark):
    df = spark.createDataFrame([(1, "same text here now", "s", k) for k in range(9)], "doc_id long, text string, source string, extra int")
    first = {tuple(r) for r in simhash.one_of_each(df.repartition(3)).collect()}
    assert len(first) == 1 and first == {tuple(r) for r in simhash.one_of_each(df.repartition(5, "extra")).collect()}
    assert {r["extra"] for r in mixing.mixed_rows(df.repartition(3)).collect()} == {r["extra"] for r in mixing.mixed_rows(df.repartition(4, "extra")).collect()}


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0]), (1, [0.5]), (1, [0.9]), (2, [0.2]), (0, [0.7])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=10).collect()
    whole = [(i, int(np.floor(1024 * v[0]))) for i, v in rows]
    # Only a query's own row is no candidate, and each row of the query's id has a list of its own.
    lists = [sorted((-q * s, i) for b, (i, s) in enumerate(whole) if b != a) for a, (of, q) in enumerate(whole) if of == 0]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == sorted((k + 1, i, -s) for best in lists for k, (s, i) in enumerate(best))


def test_vectors_that_repeat_an_id_link_by_row(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(k % 12, v.tolist(), k % 2) for k, v in enumerate(np.concatenate((base, base[:15] + 0.01 * rng.normal(size=(15, 16)), base[:4])))]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell_rows=4).collect())
    v = np.array([r[1] for r in rows])
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    link = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == [r[2] for r in rows])
    reach = link.copy()
    for _ in range(6):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = np.array([r[0] for r in rows])
    assert got == Counter((int(ids[k]), int(link[k].sum() - 1), int(ids[reach[k]].min())) for k in range(len(rows)))


def test_grids_take_few_copies():
    for n in (10, 4096, 10**5, 10**6, 10**7):
        blocks, axes = vectors.grid(n, 64, 0.98, 4096)
        assert axes <= 64 // blocks and blocks * 2**axes <= 12 * max(1, n / 4096) ** 0.65


def test_hot_keys_are_joined_as_others(spark):
    rows = [(0 if k % 3 else k, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, v long")
    facts = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most"))
    most = {}
    for k, v in rows:
        most[k] = max(v, most.get(k, v))
    assert Counter(map(tuple, common.joined_hot(df, facts, "key", "n", len(rows)).collect())) == Counter((k, v, most[k]) for k, v in rows)


def test_components_of_a_large_star(spark):
    edges = spark.createDataFrame([(5000, k) for k in range(3000)] + [(7000 + k, 7001 + k) for k in range(9)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**{k: 0 for k in range(3000)}, 5000: 0, **{7000 + k: 7000 for k in range(10)}}


def test_blocks_split_rows_without_ids(spark):
    df = spark.createDataFrame([(None, f"word {k}", "s") for k in range(600)] + [(7, "same text", "s")] * 600, "doc_id long, text string, source string")
    sizes = df.select(F.lit(1))
    assert mixing.mix(df, block_rows=100).count() == sizes.count()
    once = sorted(map(tuple, mixing.mix(df.repartition(4), block_rows=100).collect()), key=str)
    assert once == sorted(map(tuple, mixing.mix(df.repartition(7), block_rows=100).collect()), key=str)


def test_samples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(1, "text 1")] * 20 + [(k, f"other {k}") for k in range(2, 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, y0 int")
    assert learning.labelled_sample(docs, labels, "y0", 10_000).count() <= 50 + 18
    assert learning.labelled_sample(docs, labels, "y0", 7).count() == 7


def test_toxicity_takes_time_in_proportion():
    lexicon, text = {"vile": 3.0}, "vile you word " * 20_000
    spent = []
    for times in (1, 4):
        began = time.perf_counter()
        toxicity.features(text * times, lexicon, 2.0)
        spent.append(time.perf_counter() - began)
    assert spent[1] < 12 * spent[0]


def test_toxic_words_beside_persons():
    plain = [toxicity.features(t, {"vile": 3.0}, 2.0)[toxicity.FEATURES.index("near")] for t in ("vile x x you", "you x vile", "vile", "you")]
    assert plain == [1 / 4, 1 / 3, 0.0, 0.0]


def by_loop(rows, y):
    """Log ratios of indicators by counting, without hashing tricks."""
    counts = [Counter(x for r, c in zip(rows, y) if c == k for x in r.tolist()) for k in (0, 1)]
    totals = [sum(c.values()) + (1 << quality.BITS) for c in counts]
    return {x: np.log((counts[1][x] + 1) / totals[1]) - np.log((counts[0][x] + 1) / totals[0]) for x in counts[0] | counts[1]}


def test_log_ratios_and_descent_by_brute_force():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    y = np.array([int(r[0] % 3 == 0) for r in rows])
    ratio = quality.log_ratios(rows, y)
    want = by_loop(rows, y)
    assert all(abs(ratio[k] - v) < 1e-9 for k, v in want.items()) and np.count_nonzero(ratio) <= len(want)
    w, bias = quality.descend(rows, y, ratio, epochs=200)
    x = np.zeros((60, 41))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.sqrt(ratio[r] @ ratio[r])
    x[:, 40] = 1.0
    sign, share = np.where(y == 1, 1.0, -1.0), (y == 1).mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))

    def loss(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()

    # Plain subgradient steps on the same objective come no lower.
    own = np.append(w[:40], bias)
    v = np.zeros(41)
    best = loss(v)
    for t in range(1, 20_000):
        v = v - (v - (cost * sign * (sign * (x @ v) < 1)) @ x) / (t + 10)
        best = min(best, loss(v))
    assert loss(own) <= best + 0.02 * abs(best)


def test_trees_split_as_brute_force():
    rng = np.random.default_rng(5)
    x, y = rng.random((80, 2)), rng.integers(0, 2, 80)
    y[x[:, 1] > 0.6] = 1
    trees = learning.Trees(rounds=1, depth=1, least=5, bins=200).fit(x, y)
    feature, cut, _ = trees.trees[0]
    p = 1 / (1 + np.exp(-trees.base))
    g, h = y - p, np.full(80, p * (1 - p))

    def gain(f, c):
        low = x[:, f] <= c
        if min(low.sum(), (~low).sum()) < 5:
            return -1.0
        return sum(g[m].sum() ** 2 / (h[m].sum() + trees.penalty) for m in (low, ~low))

    best = max(gain(f, c) for f in range(2) for c in x[:, f])
    assert feature[0] == 1 and gain(1, cut[0]) >= 0.98 * best


def test_isotonic_by_brute_force():
    rng = np.random.default_rng(6)
    s, y = rng.random(60), rng.integers(0, 2, 60)
    x, v = learning.isotonic(s, y)
    assert (np.diff(v) >= 0).all() and (np.diff(x) >= 0).all()
    order = np.argsort(s)
    means = [max(min(y[order][a : b + 1].mean() for b in range(k, 60)) for a in range(k + 1)) for k in range(60)]
    # Pools are held a little towards the mean of all.
    assert np.abs(np.interp(s[order], x, v) - means).max() < 0.35 and np.corrcoef(np.interp(s[order], x, v), means)[0, 1] > 0.97


def disturbed(rng, text):
    """A wording as files carry it: wrapped, behind comment marks, in capitals, or with a word swapped."""
    words = text.split()
    kind = rng.choice(["wrap", "comment", "case", "swap", "plain"])
    if kind == "swap" and len(words) >= 20:
        free = [k for k, w in enumerate(words) if not licenses._BOUND.search(licenses.plain(w)) and 3 < k < len(words) - 3]
        words[rng.choice(free)] = "thing"
    if kind == "case":
        words = [w.upper() if w.islower() else w for w in words]
    if kind in ("wrap", "comment"):
        mark = " # " if kind == "comment" else " "
        return "".join(w + (("\n" + mark) if k % 7 == 6 else " ") for k, w in enumerate(words)).rstrip(" #\n")
    return " ".join(words)


def test_recall_on_planted_variants():
    rng = random.Random(12)
    prose = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
    hits = 0
    picked = [rng.choice(TEMPLATES) for _ in range(150)]
    for name, text in picked:
        body = f"{' '.join(rng.choices(prose, k=60))} {disturbed(rng, text)} {' '.join(rng.choices(prose, k=60))}"
        found = licenses.scan(body)
        hits += any(r["license"] == name or name.startswith(r["license"].split(" OR ")[0]) for r in found)
    assert hits / len(picked) >= 0.9
    assert not any(licenses.scan(" ".join(rng.choices([*prose, "license", "permission", "copyright", "the", "under"], k=400))) for _ in range(40))


def test_ranking_is_by_what_a_template_saves():
    zstandard = pytest.importorskip("zstandard")
    words = [licenses.plain(w) for w in TEMPLATES[3][1].split()]
    body = " ".join(words[: len(words) + len(words) // 2])
    alone = len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(body.encode()))
    for t in (3, 0, 5):
        own = " ".join(licenses._templates()[t][1]).encode()
        with_it = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        assert licenses.saving(t, words, 0, len(words)) == alone - len(with_it.compress(body.encode()))
    assert licenses.saving(3, words, 0, len(words)) > licenses.saving(5, words, 0, len(words))


def test_blocks_that_overlap_find_a_passage_once():
    filler = ("license word " * 900).split()
    for at in range(600, 1800, 150):
        words = [*filler[:at], "Licensed", "under", "the", "Apache", "License,", "Version", "2.0.", *filler[at:]]
        found = licenses.scan(" ".join(words))
        assert [r["license"] for r in found] == ["Apache-2.0"]
    # Two halves around another passage are no passage.
    assert [r["license"] for r in licenses.scan("Licensed under the Released under the MIT License. Apache License, Version 2.0.")] == ["MIT"]


def test_titles_stand_alone():
    assert [r["license"] for r in licenses.scan("intro\n  * MIT License *\nmore")] == ["MIT"]
    assert licenses.scan("we like the MIT License a lot") == []
    assert [r["license"] for r in licenses.scan("/* SPDX-License-Identifier: GPL-2.0-or-later */")] == ["GPL-2.0-or-later"]


def test_recall_on_wordings_of_no_rule():
    from quiresmith.llm.licenses import scan

    wild = [
        ("GPL-3.0", "This code is under the GPLv3 license, see the file."), ("GPL-3.0", "License: GPLv3"), ("GPL-3.0", "It was released under the GNU GPL v3."), ("Apache-2.0", "Distributed under the Apache License 2.0."),
        ("MPL-2.0", "Licensed under the Mozilla Public License 2.0 (MPL)."), ("CC-BY-SA-4.0", "licence: CC-BY-SA-4.0"), ("Apache-2.0", "see http://www.apache.org/licenses/LICENSE-2.0.html for it"), ("MIT", "see https://opensource.org/licenses/MIT."),
        ("AGPL-3.0", "you may use it under the terms of the GNU Affero General Public License v3 only"), ("PSF-2.0", "Licensed under the Python Software Foundation License."), ("Artistic-2.0", "Released under the Artistic License 2.0."),
        ("GPL-3.0-or-later", "Licensed under GPLv3+."), ("GPL-2.0-or-later", "Released under the GPLv2 or later."), ("MIT", "Licenced under the MIT licence."), ("CC-BY-4.0", "https://creativecommons.org/licenses/by/4.0/ applies"),
        ("CC0-1.0", "https://creativecommons.org/publicdomain/zero/1.0/"), ("LGPL-2.1", "Distributed under the GNU LGPL v2.1."), ("MPL-2.0", "You can obtain one at https://mozilla.org/MPL/2.0/."), ("GPL-3.0", "All files are licensed under the GPL v3 unless noted."), ("AGPL-3.0-or-later", "under the terms of the GNU Affero General Public License v3 or later"),
    ]
    hits = sum([r["license"] for r in scan(f"Some words of prose. {text} And others that follow.")] == [name] for name, text in wild)
    assert hits / len(wild) >= 0.9
    assert [r["license"] for r in scan("This work is dual licensed under MIT or Apache-2.0, at your option.")] == ["MIT", "Apache-2.0"]
    assert [r["license"] for r in scan("Licensed under the MIT License or the Apache License 2.0 and the GNU GPL v3 or later.")] == ["MIT", "Apache-2.0", "GPL-3.0-or-later"]
    assert not scan("I use MIT or apple trees under the terms of the contract, and a license to print money.")


def test_long_texts_are_scanned_in_proportion():
    import time

    from quiresmith.llm.licenses import scan

    began = time.perf_counter()
    found = scan(("license the software under terms of any license permitted by permission " * 400 + "Released under the MIT License. ") * 12)
    assert [r["license"] for r in found] == ["MIT"] * 12 and time.perf_counter() - began < 60
