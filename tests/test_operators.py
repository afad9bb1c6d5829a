from __future__ import annotations

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from titlekit.operators import lookup
from titlekit.operators.brands import brand_pairs, brands_present, title_brands
from titlekit.operators.evaluation import weighted_metrics
from titlekit.operators.gazetteer import known_terms
from titlekit.operators.phrases import noun_phrases, phrase_candidates, tag_words, text_words, title_words
from titlekit.operators.sampling import sample_rows, size_samples
from titlekit.operators.training import corpus_stop_words, training_features, without_corpus_words
from titlekit.operators.vocabulary import index_to_term, numbered, term_vocabulary
from titlekit.plans.model import indexed, term_stages
from titlekit.queries.english import ENGLISH_STOP_WORDS


@pytest.fixture(params=["broadcast", "salted"])
def join_kind(request, monkeypatch):
    """Run with small lookup tables broadcast, and with every lookup table treated as large."""
    if request.param == "salted":
        monkeypatch.setattr(lookup, "fits_broadcast", lambda dim, **k: False)
    return request.param


LABELLED = "product_name string, core_terms string, brand string, stop_words string, extra int"


def labelled(spark):
    return spark.createDataFrame(
        [
            ("Tas Kulit Pria", "Tas, tas kulit", "Acme", "pria", 1),
            ("Jam tangan tas tas", "jam tangan", None, None, 2),
            ("No terms", None, "Acme", "", 3),
            ("No terms either", " , ", "Zeta", None, 4),
            ("Tas Zeta", "tas", "Acme, Zeta ,", "XL", 5),
        ],
        LABELLED,
    )


def test_training_features(spark):
    rows = training_features(labelled(spark), keep=("extra",)).collect()
    assert [(r["extra"], r["tokens"], r["target"], r["brands"]) for r in rows] == [
        (1, ["tas", "kulit"], "tas", ["acme"]),
        (1, ["tas", "kulit"], "tas kulit", ["acme"]),
        (2, ["jam", "tangan", "tas", "tas"], "jam tangan", []),
        (5, ["tas", "zeta"], "tas", ["acme", "zeta"]),
    ]


def test_brand_pairs(spark):
    pairs = {(r["term"], r["brand"]) for r in brand_pairs(training_features(labelled(spark))).collect()}
    assert pairs == {("tas", "acme"), ("tas kulit", "acme"), ("tas", "zeta")}


def test_corpus_stop_words(spark, join_kind):
    features = training_features(labelled(spark))
    words = corpus_stop_words(features)
    assert {r["word"] for r in words.collect()} == {"pria", "xl"}
    rows = spark.createDataFrame([(1, ["Pria", "tas", "tas"]), (2, ["xl"]), (3, [])], "id int, tokens array<string>")
    kept = without_corpus_words(rows, "id", "tokens", words, "kept")
    remover = StopWordsRemover(inputCol="tokens", outputCol="kept", stopWords=["pria", "xl"])
    assert sorted(map(str, kept.select("id", "kept").collect())) == sorted(map(str, remover.transform(rows).select("id", "kept").collect()))


def test_vocabulary_has_the_order_of_a_string_indexer(spark):
    words = ["b", "a", "c", "c", "é", "z", "\U0001f600", "～"]
    features = spark.createDataFrame([(w,) for w in words], "target string")
    vocabulary = term_vocabulary(features).orderBy("label_index").collect()
    assert [r["term"] for r in vocabulary] == indexed(features)[1]
    assert [r["label_index"] for r in vocabulary] == list(range(7))
    assert term_vocabulary(features, min_count=2).count() == 1


def test_numbered_over_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("hot"))
    found = numbered(rows, [F.col("hot").desc(), F.col("x").asc()], "place").orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(1000))
    assert [(-r["hot"], r["x"]) for r in found] == sorted((-r["hot"], r["x"]) for r in found)


def test_index_to_term(spark, join_kind):
    terms = spark.createDataFrame([(0, "tas"), (1, "jam")], "label_index long, term string")
    rows = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 9.0)], "id int, prediction double")
    assert {r["id"]: r["predicted_term"] for r in index_to_term(rows, terms).collect()} == {1: "jam", 2: "tas", 3: None}


def test_known_terms(spark, join_kind):
    titles = spark.createDataFrame([(1, ["tas", "jam", "tas"]), (2, ["x"]), (3, [])], "id int, tokens array<string>")
    terms = spark.createDataFrame([("jam",), ("tas",), ("tas",)], "term string")
    found = known_terms(titles, "id", "tokens", terms).collect()
    assert {r["id"]: r["terms"] for r in found} == {1: ["tas", "jam"], 2: [], 3: []}


def test_title_brands(spark, join_kind):
    pairs = spark.createDataFrame([("tas", "acme"), ("tas", "zeta"), ("jam", "acme"), ("jam", "big brand")], "term string, brand string")
    titles = spark.createDataFrame(
        [
            (1, ["jam", "tas"], ["tas", "jam", "acme", "zeta", "big brand"]),
            (2, ["tas"], ["tas", "big brand"]),
            (3, [], ["acme"]),
            (4, ["unknown"], ["acme"]),
        ],
        "id int, terms array<string>, tokens array<string>",
    )
    present = brands_present(titles, "id", "tokens", pairs)
    found = title_brands(titles, "id", "terms", present, pairs).collect()
    assert {r["id"]: r["brands"] for r in found} == {1: ["acme", "big brand", "zeta"], 2: [], 3: [], 4: []}
    assert {r["id"]: r["terms"] for r in found}[1] == ["jam", "tas"]


TAGGED = "id int, sentence int, pos int, word string, tag string"


def phrases_of(spark, pairs):
    rows = [(1, 0, i, w, t) for i, (w, t) in enumerate(pairs)]
    return [r["phrase"] for r in noun_phrases(spark.createDataFrame(rows, TAGGED), "id").orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("words", "phrases"),
    [
        ([("Acme", "NNP"), ("Cam", "NNPS"), ("is", "VB"), ("Zeta", "NNP")], ["Acme Cam", "Zeta"]),
        ([("Solo", "NNP")], ["Solo"]),
        ([("Acme", "NNP"), ("&", "CC"), ("Sons", "NNP"), (",", ",")], ["Acme & Sons"]),
        ([("&", "CC"), ("Acme", "NNP"), ("-", ":"), ("@", "IN"), ("Co", "NNP")], ["Acme - @ Co"]),
        ([("http://x", "NNP"), ("Acme", "NNP")], ["Acme"]),
        ([("(", "("), (",", ",")], []),
        ([("Acme", "NNP"), ("/", "/"), ("Co", "NNP")], ["Acme / Co"]),
    ],
)
def test_noun_phrases(spark, words, phrases):
    assert phrases_of(spark, words) == phrases


def test_phrases_do_not_cross_sentences_or_texts(spark):
    rows = [(1, 0, 0, "A", "NNP"), (1, 1, 0, "B", "NNP"), (2, 0, 0, "C", "NNP")]
    found = noun_phrases(spark.createDataFrame(rows, TAGGED), "id").collect()
    assert sorted((r["id"], r["sentence"], r["phrase"]) for r in found) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "C")]


def test_tags_and_candidates(spark, join_kind):
    lexicon = spark.createDataFrame([("kamera", "NN"), ("mini", "NNP"), ("mini", "NNS")], "word string, tag string")
    texts = spark.createDataFrame([(1, "Mini Kamera Acme 12MP Acme mini"), (2, None)], "id int, t string")
    tagged = tag_words(title_words(texts, "id", "t"), lexicon)
    assert [(r["word"], r["tag"]) for r in tagged.orderBy("pos").collect()] == [
        ("Mini", "NNP"), ("Kamera", "NN"), ("Acme", "NNP"), ("Acme", "NNP"), ("mini", "NNP")
    ]
    found = phrase_candidates(noun_phrases(tagged, "id"), "id").collect()
    assert [(r["id"], r["phrases"]) for r in found] == [(1, ["mini", "acme acme mini"])]


def test_text_words_split_sentences_and_marks(spark):
    rows = spark.createDataFrame([(1, "Été, à Paris. Fin")], "id int, t string")
    found = text_words(rows, "id", "t").orderBy("sentence", "pos").collect()
    assert [(r["sentence"], r["word"]) for r in found] == [(0, "Été"), (0, ","), (0, "à"), (0, "Paris"), (1, "Fin")]


def test_metrics_agree_with_spark_ml(spark):
    rows = [(float(i % 4), float((i * 7) % 5)) for i in range(60)]
    scored = spark.createDataFrame(rows, "label double, prediction double")
    ours = weighted_metrics(scored).first().asDict()
    for name, value in ours.items():
        expected = MulticlassClassificationEvaluator(metricName=name).evaluate(scored)
        assert value == pytest.approx(expected)


def test_samples_do_not_depend_on_partitions(spark):
    ids = spark.range(2000)
    first = {r["id"] for r in sample_rows(ids.repartition(3), "id", 200, seed=1).collect()}
    second = {r["id"] for r in sample_rows(ids.repartition(7), "id", 200, seed=1).collect()}
    assert first == second and 120 < len(first) < 280
    assert sample_rows(ids, "id", 5000).count() == 2000
    sizes = {r["sample"]: r["count"] for r in size_samples(ids, "id", [100, 4000], 1).groupBy("sample").count().collect()}
    assert sizes[1] == 2000 and 50 < sizes[0] < 150


def test_default_stop_words_are_those_of_spark():
    assert StopWordsRemover.loadDefaultStopWords("english") == ENGLISH_STOP_WORDS


def test_stages(spark):
    rows = spark.createDataFrame([(["a", "the", "b"], 0.0), (["c", "stop"], 1.0), (["c"], 1.0)], "tokens array<string>, label double")
    model = term_stages(2, pca_k=2, default_stop_words=True).fit(rows)
    out = model.transform(rows).collect()
    assert out[0]["clean_tokens"] == ["b"] and out[1]["clean_tokens"] == ["c", "stop"] and len(out[0]["components"]) == 2
    assert term_stages(vectors="hashed", classifier="one_vs_rest").fit(rows).transform(rows).count() == 3
    with pytest.raises(ValueError):
        term_stages(vectors="other")
