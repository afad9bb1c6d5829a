"""Classifier queries (ML1-ML11)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from titlekit.functions.text import title_tokens, with_ngrams
from titlekit.operators.counts import count_vectors, fit_vocabulary
from titlekit.operators.evaluation import weighted_metrics
from titlekit.operators.gazetteer import checked_prediction, known_terms
from titlekit.operators.lookup import lookup_join
from titlekit.operators.vocabulary import term_vocabulary
from titlekit.operators.training import training_features
from titlekit.plans.model import dealt, dealt_to_tasks, halves, indexed, out_of_fold, table_vectors, term_stages, train_term_model
from titlekit.plans.predict import predict, predict_titles
from titlekit.plans.train import train
from titlekit.queries.catalog import LABELLED_SQL, PLAIN_SQL, joined, labelled_titles, merged_sql, plain_titles, query, table, tokens_sql
from titlekit.queries.lists import VOCABULARY_SQL
from titlekit.session import materialise, new_folder
from titlekit.sources.attributes import write_table

TREES = 8
FOLDS = 2


def plain_features(spark, folder):
    return materialise(training_features(plain_titles(spark, folder), keep=("id", "title")))


@query("ml1_string_index", VOCABULARY_SQL + " SELECT id, target, label_index::DOUBLE AS label FROM features JOIN vocabulary ON term = target")
def string_index(spark, folder):
    rows, _ = indexed(training_features(labelled_titles(spark, folder), keep=("id",)))
    return rows.select("id", "target", "label")


@query("ml2_count_vectors", f"""
WITH {LABELLED_SQL},
grams AS (SELECT unnest({merged_sql('tokens')}) AS token FROM features)
SELECT token, count(*)::DOUBLE AS total FROM grams GROUP BY token""")
def summed_vectors(spark, folder):
    """Sparse vectors of all rows by a vocabulary that is a table, summed by index and named again."""
    rows = training_features(labelled_titles(spark, folder), keep=("id",)).select("id", "target", with_ngrams("tokens").alias("tokens"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    vocabulary = fit_vocabulary(rows)
    held = count_vectors(rows, "row", "tokens", vocabulary).select(F.inline(F.arrays_zip("counts.indices", "counts.counts")))
    totals = held.groupBy(F.col("indices").alias("index")).agg(F.sum("counts").alias("total"))
    return lookup_join(totals, vocabulary.select("index", "token"), ["index"]).select("token", "total")


@query("ml3_ml4_ml10_forest")
def forest(spark, folder):
    rows, _ = indexed(plain_features(spark, folder))
    rows = dealt_to_tasks(materialise(rows.select("id", "label", with_ngrams("tokens").alias("tokens"))), TREES)
    model = term_stages(TREES).fit(rows)
    return model.transform(rows).select("id", "label", "prediction")


@query("ml5_cross_validation")
def cross_validation(spark, folder):
    rows = plain_features(spark, folder)
    fitted = train_term_model(rows, FOLDS, "f1", TREES)
    scored = fitted.model.transform(indexed(rows)[0].select("label", with_ngrams("tokens").alias("tokens")))
    return weighted_metrics(scored).withColumn("cross_validated_f1", F.lit(fitted.metric))


MARKED_SQL = """
marked AS (
  SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS target
  FROM part)"""


def marked_rows(spark, folder):
    """Titles with one more token that alone decides the target."""
    colour = F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), colour.alias("target"))
    tokens = F.concat(title_tokens("title"), F.array(F.concat(F.lit("mark"), "target")))
    return materialise(rows.select("id", "title", "target", tokens.alias("tokens"), F.array().cast("array<string>").alias("stop_words")))


def named_predictions(model, rows, labels):
    names = rows.sparkSession.createDataFrame([(float(i), t) for i, t in enumerate(labels)], "prediction double, predicted string")
    return lookup_join(model.transform(rows), names, ["prediction"], "left").select("id", "target", "predicted")


@query("ml3_ml4_ml10_separable_forest", f"WITH {MARKED_SQL} SELECT id, target, target AS predicted FROM marked")
def separable_forest(spark, folder):
    rows, labels = indexed(dealt_to_tasks(marked_rows(spark, folder), 40))
    return named_predictions(term_stages(40, seed=3).fit(rows), rows, labels)


@query("ml8_separable_one_vs_rest", f"WITH {MARKED_SQL} SELECT id, target, target AS predicted FROM marked")
def separable_one_vs_rest(spark, folder):
    rows, labels = indexed(marked_rows(spark, folder))
    return named_predictions(term_stages(vectors="hashed", classifier="one_vs_rest").fit(rows), rows, labels)


@query("ml5_folds", f"""
WITH keys AS (SELECT DISTINCT p_name AS title FROM part)
SELECT title, true AS one_fold, true AS even, {FOLDS + 1} AS folds FROM keys""")
def even_folds(spark, folder):
    """Every title is in one fold, and the folds differ by at most one title."""
    rows, folds = dealt(marked_rows(spark, folder), "title", FOLDS + 1)
    sizes = [r["n"] for r in rows.groupBy("fold").agg(F.count_distinct("title").alias("n")).collect()]
    even = len(sizes) == folds and max(sizes) - min(sizes) <= 1
    return rows.groupBy("title").agg((F.count_distinct("fold") == 1).alias("one_fold"), F.lit(even).alias("even"), F.lit(folds).alias("folds"))


def component_stage(k):
    """The stage that ``term_stages`` puts between vectors and classifier."""
    return term_stages(pca_k=k).getStages()[2]


@query("ml6_components_forest", f"WITH {MARKED_SQL} SELECT id, target, target AS predicted FROM marked")
def components_forest(spark, folder):
    """The forest on components of hashed counts, by the engine's own stages."""
    rows, labels = indexed(dealt_to_tasks(marked_rows(spark, folder), 40, 8))
    return named_predictions(term_stages(40, vectors="hashed", pca_k=8, hashed_features=256, seed=3).fit(rows), rows, labels)


@query("ml2_ml10_table_vectors_forest", f"WITH {MARKED_SQL} SELECT id, target, target AS predicted FROM marked")
def table_vectors_forest(spark, folder):
    """The forest on vectors of a vocabulary table, which is written, read again and joined at prediction."""
    rows, labels = indexed(marked_rows(spark, folder))
    path = new_folder(spark, "vocabulary")
    write_table(fit_vocabulary(rows), path)
    vocabulary = spark.read.parquet(path)
    rows = dealt_to_tasks(materialise(table_vectors(rows, "id", vocabulary)), 40, vocabulary.count())
    return named_predictions(term_stages(40, vectors="table", seed=3).fit(rows), rows, labels)


@query("ml5_out_of_fold", f"""
WITH {MARKED_SQL}, counts AS (SELECT target, count(*) AS n FROM marked GROUP BY target)
SELECT id, target, target AS predicted, 1.0::DOUBLE AS f1 FROM marked""")
def out_of_fold_predictions(spark, folder):
    """Rows scored by models that have not seen them, and the metric of all of them together."""
    rows, labels = indexed(marked_rows(spark, folder))
    rows, folds = dealt(rows, "title", FOLDS + 1)
    rows = dealt_to_tasks(materialise(rows), 40)
    scored = materialise(out_of_fold(rows, term_stages(40, seed=3), folds, ("id", "target")))
    names = spark.createDataFrame([(float(i), t) for i, t in enumerate(labels)], "prediction double, predicted string")
    f1 = weighted_metrics(scored).select(F.round("f1", 6).alias("f1"))
    named = lookup_join(scored, names, ["prediction"], "left").select("id", "target", "predicted")
    return named.crossJoin(F.broadcast(f1))  # one row


@query("ml6_total_variance", """
WITH numbers AS (SELECT unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings),
spreads AS (SELECT i, var_samp(value) AS v FROM numbers GROUP BY i)
SELECT round(sum(v), 6) AS variance, true AS descending FROM spreads""")
def total_variance(spark, folder):
    """All components together carry the variance of the vectors, the first one most."""
    rows = table(spark, folder, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    reduced = component_stage(64).fit(rows).transform(rows)
    values = reduced.select(F.posexplode(vector_to_array("components")).alias("i", "value"))
    spreads = materialise(values.groupBy("i").agg(F.var_samp("value").alias("v")))
    ordered = F.sort_array(F.collect_list(F.struct("i", "v")))
    falling = F.forall(F.sequence(F.lit(1), F.size(ordered) - 1), lambda i: F.get(ordered, i)["v"] <= F.get(ordered, i - 1)["v"] + 1e-9)
    return spreads.agg(F.round(F.sum("v"), 6).alias("variance"), falling.alias("descending"))


@query("ml6_components")
def components(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    reduced = component_stage(8).fit(rows).transform(rows)
    return reduced.select("vec_id", F.posexplode(vector_to_array("components")).alias("component", "value")).select(
        "vec_id", "component", F.round(F.abs("value"), 6).alias("size")
    )


def bucket_entries(vector):
    """The entries of a sparse vector; an array of all its places would have as many numbers as there are buckets."""
    entries = F.udf(lambda v: None if v is None else [(int(i), float(x)) for i, x in zip(v.indices, v.values)], "array<struct<bucket:int,held:double>>")
    return entries(vector)


@query("ml7_hashed_counts", f"""
WITH {PLAIN_SQL},
grams AS (SELECT id, unnest({merged_sql('t')}) AS token FROM (SELECT id, {tokens_sql('product_name', 2)} AS t FROM titles))
SELECT token, count(*)::DOUBLE AS total, count(DISTINCT id) AS titles, true AS one_bucket, true AS spread_out
FROM grams GROUP BY token""")
def hashed_counts(spark, folder):
    """Every title's bucket counts, led back to its tokens: a token's bucket is the same in all titles, its count there
    is the token's count whenever no other token of the title shares the bucket, and few tokens share one."""
    rows = plain_titles(spark, folder).select("id", title_tokens("product_name").alias("t")).select("id", with_ngrams("t").alias("tokens"))
    stages = term_stages(vectors="hashed", hashed_features=1 << 18).getStages()[:2]
    hashed = Pipeline(stages=stages).fit(rows).transform(rows).select("id", "features")
    grams = rows.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))
    tokens = materialise(grams.select("token").distinct())
    alone = tokens.select("token", F.array("token").alias("tokens"))
    buckets = Pipeline(stages=stages).fit(alone).transform(alone).select("token", F.inline(bucket_entries("features"))).where("held > 0")
    buckets = materialise(buckets.select("token", "bucket"))
    spread_out = buckets.select("bucket").distinct().count() > 0.9 * buckets.count()
    held = hashed.select("id", F.inline(bucket_entries("features"))).where("held > 0")
    # rows of every title on both sides: none is sent whole through the driver, whatever the planner's estimate says
    expected = lookup_join(grams, buckets, ["token"]).withColumn("all", F.sum("n").over(Window.partitionBy("id", "bucket")))
    met = expected.join(held.hint("merge"), ["id", "bucket"], "left")
    return met.groupBy("token").agg(
        F.sum(F.when(F.col("all") == F.col("held"), F.col("n"))).cast("double").alias("total"),
        F.count(F.lit(1)).alias("titles"),
        (F.count_distinct("bucket") == 1).alias("one_bucket"),
        F.lit(spread_out).alias("spread_out"),
    )


@query("ml8_one_vs_rest")
def one_vs_rest(spark, folder):
    rows, _ = indexed(plain_features(spark, folder))
    rows = materialise(rows.select("id", "label", F.col("tokens")))
    model = term_stages(vectors="hashed", classifier="one_vs_rest").fit(rows)
    return model.transform(rows).select("id", "label", "prediction")


@query("ml9_random_halves", f"WITH {LABELLED_SQL} SELECT id, target, count(*) AS n, true AS share_of_training FROM features GROUP BY id, target")
def random_halves(spark, folder):
    """Both parts together are the rows, each once, and about seven tenths are in the first."""
    rows = materialise(training_features(labelled_titles(spark, folder), keep=("id",)))
    first, second = halves(rows)
    both = materialise(first.withColumn("part", F.lit(1)).unionByName(second.withColumn("part", F.lit(0))))
    share = both.agg(F.avg("part")).first()[0]
    return both.groupBy("id", "target").agg(F.count(F.lit(1)).alias("n")).withColumn("share_of_training", F.lit(bool(0.6 < share < 0.8)))


TERMS_SQL = f"""
WITH {PLAIN_SQL},
known AS (SELECT list(DISTINCT core_term) AS terms FROM titles),
grams AS (
  SELECT id, product_name, brand, stop_word, core_term, {merged_sql('t')} AS m
  FROM (SELECT *, {tokens_sql('product_name', 3)} AS t FROM titles)),
found AS (
  SELECT id, product_name, m, list_filter(m, lambda x: list_contains(known.terms, x)) AS terms FROM grams, known)"""


@query("ml11_checked_predictions", TERMS_SQL + " SELECT id, array_to_string(list_sort(terms), '|') AS terms FROM found")
def checked_predictions(spark, folder):
    """Each of these titles holds one known term, so a right prediction and the fallback agree."""
    rows = plain_features(spark, folder)
    fitted = train_term_model(rows, FOLDS, "f1", TREES)
    found = predict(plain_titles(spark, folder), "id", fitted.model, materialise(term_vocabulary(rows)),
                    spark.createDataFrame([], "term string, brand string"), stop_words=fitted.stop_words)
    return found.select("id", F.array_join(F.array_sort("core_terms"), "|").alias("terms"))


@query("ml11_prediction_or_fallback", f"""
WITH {PLAIN_SQL},
grams AS (SELECT id, {merged_sql('t')} AS m FROM (SELECT id, {tokens_sql('product_name', 3)} AS t FROM titles)),
known AS (SELECT list(DISTINCT w) AS terms FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)),
found AS (SELECT id, m, list_filter(list_distinct(m), lambda x: list_contains(known.terms, x)) AS unordered, terms FROM grams, known)
SELECT id, CASE id % 3 WHEN 0 THEN m[1] ELSE array_to_string(list_sort(unordered), '|') END AS terms FROM found""")
def prediction_or_fallback(spark, folder):
    """Titles with several known terms: the predicted one alone where the title has it (every third), else all of them."""
    titles = plain_titles(spark, folder)
    terms = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    tokens = title_tokens("product_name", 3)
    predicted = F.when(F.col("id") % 3 == 0, F.get(tokens, 0)).when(F.col("id") % 3 == 1, F.lit("not in any title"))
    rows = titles.select("id", with_ngrams(tokens).alias("tokens"), predicted.alias("predicted_term"))
    found = known_terms(rows, "id", "tokens", materialise(terms), out="gazetteer")
    first = checked_prediction("predicted_term", F.col("tokens"), "gazetteer")
    return found.select("id", F.array_join(F.array_sort(F.coalesce(first, F.col("gazetteer"))), "|").alias("terms"))


PREDICTED_SQL = TERMS_SQL + """,
pairs AS (SELECT DISTINCT core_term AS term, brand FROM titles),
brands AS (
  SELECT f.id, string_agg(DISTINCT p.brand, '|' ORDER BY p.brand) AS brands
  FROM found f JOIN pairs p ON list_contains(f.terms, p.term) AND list_contains(f.m, p.brand) GROUP BY f.id)
SELECT product_name, array_to_string(terms, '|') AS core_terms, coalesce(brands, '') AS brands
FROM found LEFT JOIN brands USING (id)"""


@query("train_and_predict", PREDICTED_SQL)
def train_and_predict(spark, folder):
    """The whole path: train on the titles, then predict the same titles without their labels."""
    titles = plain_titles(spark, folder)
    trained = train(titles, folds=FOLDS, num_trees=TREES)
    found = predict_titles(titles, trained.term_model.model, trained.terms, materialise(trained.brands), stop_words=trained.term_model.stop_words)
    return found.select("product_name", joined("core_terms"), joined("brands"))


def gazetteer_prediction(spark, folder):
    """Prediction without a classifier, on known terms and brands only."""
    titles = plain_titles(spark, folder)
    terms = materialise(titles.select(F.col("core_terms").alias("term")).distinct())
    pairs = materialise(titles.select(F.col("core_terms").alias("term"), "brand").distinct())
    return predict_titles(titles, None, terms, pairs)


@query("predict_by_gazetteer", PREDICTED_SQL)
def predict_by_gazetteer(spark, folder):
    return gazetteer_prediction(spark, folder).select("product_name", joined("core_terms"), joined("brands"))


@query("predict_with_phrases", f"""
{TERMS_SQL},
cleaned AS (SELECT id, terms, regexp_replace(regexp_replace(product_name, '\\w*\\d\\w* *', ' ', 'g'), ' +', ' ', 'g') AS t FROM found),
words AS (SELECT id, w[i] AS word, i AS pos FROM (
  SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT id, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM cleaned))),
tagged AS (SELECT *, length(word) >= 7 AS noun FROM words),
runs AS (SELECT *, sum(CASE WHEN noun THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM tagged),
phrases AS (SELECT id, run, min(pos) AS pos, string_agg(word, ' ' ORDER BY pos) AS phrase, count(*) AS n FROM runs WHERE noun GROUP BY id, run),
lists AS (SELECT id, list(phrase ORDER BY pos) AS p FROM phrases WHERE n < 4 GROUP BY id),
merged AS (
  SELECT id, terms || list_filter(coalesce(p, []), lambda t: len(list_filter(terms, lambda x: contains(t, x))) = 0) AS m
  FROM found LEFT JOIN lists USING (id))
SELECT id, array_to_string(list_filter(m, lambda x: len(list_filter(m, lambda y: x <> y AND contains(x, y))) = 0), '|') AS core_terms FROM merged""")
def predict_with_phrases(spark, folder):
    """Words of seven letters and more count as proper nouns in this lexicon."""
    titles = plain_titles(spark, folder)
    terms = materialise(titles.select(F.col("core_terms").alias("term")).distinct())
    words = titles.select(F.explode(F.split("product_name", " ")).alias("word")).distinct()
    lexicon = materialise(words.withColumn("tag", F.when(F.length("word") >= 7, "NNP").otherwise("JJ")))
    found = predict(titles, "id", None, terms, spark.createDataFrame([], "term string, brand string"), lexicon)
    return found.select("id", joined("core_terms"))
