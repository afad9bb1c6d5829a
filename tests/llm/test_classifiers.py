"""Quality, toxicity and language: held-out accuracy, the models' arithmetic against plain code, odd rows."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from titlekit.llm import langid, quality, toxicity
from titlekit.llm.common import labelled_sample, within

FOLDER = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_marginals_against_all_labellings():
    random = np.random.default_rng(1)
    first = np.array([0, 3, 3, 4, 9])
    scores, change = random.normal(0, 2, 9), random.normal(0, 1, (2, 2))
    good, pairs = quality.marginals(scores, first, change)
    inner = [i for i in range(9) if i not in (0, 3, 4)]
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        weights, ones, both = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(scores[a + i] * v for i, v in enumerate(y)) + sum(change[p, q] for p, q in zip(y, y[1:])))
            weights += w
            ones += w * np.array(y)
            for i in range(1, len(y)):
                both[i, y[i - 1], y[i]] += w
        assert np.allclose(good[a:b], ones / weights)
        for i in range(1, b - a):
            assert np.allclose(pairs[inner.index(a + i)], both[i] / weights)


def test_machine_against_all_pairs():
    random = np.random.default_rng(2)
    n = 6
    model = toxicity.Machine(0.3, np.arange(n), random.normal(size=n), random.normal(size=(n, 4)))
    owner, term = np.array([0, 0, 0, 2, 2]), np.array([1, 3, 5, 0, 1])
    for row, got in enumerate(model.logits(3, owner, term)):
        own = term[owner == row]
        want = 0.3 + model.weights[own].sum() + sum(model.factors[a] @ model.factors[b] for a, b in itertools.combinations(own, 2))
        assert np.isclose(got, want)


def test_interactions_are_learned():
    """Neither word alone is toxic, both together are."""
    filler = [f"word{i}" for i in range(30)]
    random = np.random.default_rng(3)
    sample = []
    for k in range(800):
        insult, group = random.random() < 0.5, random.random() < 0.5
        words = list(random.choice(filler, 10)) + ["zorgish"] * bool(insult) + ["martians"] * bool(group)
        sample.append((" ".join(words).encode(), int(insult and group), 1.0))
    model = toxicity.fit(sample)
    both, one, other = model.scores([b"word1 zorgish word2 martians", b"word1 zorgish word2", b"word1 martians"])
    assert both > 0.5 > max(one, other)


def test_words_alike_in_both_classes_are_learned_as_a_pair():
    """Each word is as frequent in toxic rows as in clean ones; toxic rows have both or none."""
    filler = [f"word{i}" for i in range(30)]
    random = np.random.default_rng(3)
    sample = []
    for k in range(800):
        toxic, insult = k % 2, k % 4 < 2
        group = insult if toxic else not insult
        words = list(random.choice(filler, 10)) + ["zorgish"] * insult + ["martians"] * group
        sample.append((" ".join(words).encode(), toxic, 1.0))
    model = toxicity.fit(sample)
    both, none, one, other = model.scores([b"word1 zorgish word2 martians", b"word1 word2 word3", b"word1 zorgish word2", b"word1 martians"])
    assert min(both, none) > 0.5 > max(one, other)


def test_rare_insults_have_a_weight():
    """A word of 10 in 1,500 toxic rows, and more words than 4,096."""
    random = np.random.default_rng(4)
    sample = []
    for k in range(3000):
        words = [f"q{x}" for x in random.integers(0, 9000, 20)] + ["common"] * (k % 2)
        sample.append((" ".join(words + ["zorgish"] * (k % 2 and k < 20)).encode(), k % 2, 1.0))
    model = toxicity.fit(sample)
    assert len(model.weights) > 4096
    _, insult = toxicity.distinct_terms([b"zorgish"], model.place)
    assert (model.weights[insult] > 0).all()


def test_a_huge_text_does_not_end_the_sample(spark):
    """One text above the bound, first by hash, and a class whose texts all come after large ones of another."""
    ids = [r["i"] for r in spark.range(1, 400).selectExpr("id AS i").where("crc32(CAST(CAST(i AS STRING) AS BINARY)) % 5 <> 0").orderBy(F.xxhash64("i")).collect()]
    rows = [(k, ("x" * 5000 if n == 0 else "y" * 90 if n < 60 else "z" * 10), int(n >= 60)) for n, k in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    found = labelled_sample(table, table, "y", "doc_id", "text", 1500, 1000)
    assert sum(len(t) for t, _, _ in found) <= 1000
    texts = [y for _, y, _ in found]
    assert texts.count(0) >= 5 and texts.count(1) >= 50
    assert np.isclose(sum(w for *_, w in found), len(rows))


def test_shares_of_classes():
    assert within([], 10) == []
    assert within([("a", 11)], 10) == []
    assert within([("a", 11), ("a", 4), ("b", 3), ("a", 6)], 10) == [1, 2]
    assert within([("a", 8), ("a", 1), ("b", 8), ("a", 1)], 10) == [1, 2, 3]  # b needs more than half
    assert within([("a", 8), ("b", 0), ("b", 8)], 10) == [0, 1]  # the two do not fit together
    assert within([("a", 2)] * 6 + [("b", 2)], 10) == [0, 1, 2, 3, 6]  # what b leaves over goes to a
    random = np.random.default_rng(5)
    for _ in range(300):
        sizes = [(int(y), int(n)) for y, n in zip(random.integers(0, 6, 40), random.integers(1, 50, 40))]
        taken = within(sizes, 300)
        assert sum(sizes[k][1] for k in taken) <= 300
        assert {sizes[k][0] for k in taken} == {y for y, _ in sizes} or sum(min(n for x, n in sizes if x == y) for y in {y for y, _ in sizes}) > 300


def test_neighbouring_lines_count():
    lines = quality.Lines([b"a b c\nX Y Z!!\n\nd e", b"", b"solo"])
    assert lines.count == 4 and lines.first.tolist() == [0, 3, 3, 4]
    own = (lines.features.shape[1] - 2) // 3
    assert np.allclose(lines.features[1, own : 2 * own], lines.features[0, :own])
    assert np.allclose(lines.features[1, 2 * own : 3 * own], lines.features[2, :own])
    assert lines.features[0, own : 2 * own].sum() == 0 and lines.features[3, -2:].tolist() == [1, 1]


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out(spark, module, label, least):
    docs, labels = tables(spark)
    rows = module.scored(docs, labels, label).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.THRESHOLD)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in held]) >= least


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_not_used(spark, module, label):
    docs, labels = tables(spark)
    turned = labels.selectExpr("doc_id", f"CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - {label} ELSE {label} END AS {label}")
    one, two = (sorted(map(tuple, module.scored(docs, x, label).collect())) for x in (labels, turned))
    assert one == two


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, odd, nothing, module):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (6, 1), (8, 0), (8, 1), (None, 1), (7, None), (99, 1)], "doc_id bigint, y int")
    rows = module.scored(odd, labels, "y").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert module.scored(nothing, labels, "y").count() == 0
    for some in (labels.limit(0), labels.where("y = 1"), labels.where("doc_id = 99")):
        assert module.scored(odd, some, "y").count() == odd.count()


def test_empty_text_has_quality_zero(spark, odd):
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id bigint, y int")
    scores = {r["doc_id"]: r["score"] for r in quality.scored(odd, labels, "y").collect()}
    assert scores[3] == scores[4] == scores[5] == 0


def test_languages(spark):
    docs, _ = tables(spark)
    rows = langid.predicted(docs).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_languages_are_not_used(spark):
    docs, _ = tables(spark)
    turned = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    one, two = (sorted(map(tuple, langid.predicted(x).collect())) for x in (docs, turned))
    assert one == two


def test_odd_languages(spark, odd, nothing):
    rows = langid.predicted(odd).collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (3, 4, 5))
    assert langid.predicted(nothing).count() == 0
    unknown = odd.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in langid.predicted(unknown).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    docs, _ = tables(spark)
    strange = spark.createDataFrame([(10**9, "жщъ ыэю щщщ ъыъ " * 20)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(strange.selectExpr("*", "CAST(NULL AS STRING) AS lang"))
    rows = {r["doc_id"]: r["rejected"] for r in langid.predicted(both).collect()}
    assert rows[10**9] and np.mean([v for k, v in rows.items() if k < 10**9]) < 0.02


def test_counts_of_ngrams():
    got = langid.counts([b"Ab a", b"", b"1 2", "é".encode()])
    assert got.sum(axis=1).tolist() == [2 * 3, 0, 0, 2 * 2]
