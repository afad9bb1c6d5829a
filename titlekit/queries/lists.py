"""Projections, lists and brand lookups (PRJ, FLT, NUL, ARR, AGG1, AGG2, JOIN1, JOIN3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlekit.knn.cells import vector_rows
from titlekit.functions.lists import (
    explode_keeping_null,
    list_text,
    minimal_terms,
    parse_list,
    priority_merge,
    shared_items,
    text_list,
    without_words,
)
from titlekit.functions.text import title_tokens, with_ngrams
from titlekit.operators.brands import brand_pairs, brands_present, title_brands
from titlekit.operators.training import corpus_stop_words, normalised_rows, training_features
from titlekit.operators.vocabulary import index_to_term, term_vocabulary
from titlekit.plans.predict import title_features
from titlekit.queries.catalog import LABELLED_SQL, PLAIN_SQL, documents, joined, labelled_titles, merged_sql, plain_titles, query, table, tokens_sql
from titlekit.session import materialise


@query("prj1_filled_nulls", f"""
WITH {LABELLED_SQL}
SELECT id, coalesce(brand, '') AS brand, coalesce(stop_words, '') AS stop_words FROM labelled""")
def filled_nulls(spark, folder):
    return labelled_titles(spark, folder).na.fill("", ["brand", "stop_words"]).select("id", "brand", "stop_words")


@query("prj2_normalised_rows", f"""
WITH {LABELLED_SQL}
SELECT id, title, array_to_string(list_filter(stop_words, lambda w: w <> ''), '|') AS stop_words,
       array_to_string(targets, '|') AS targets, array_to_string(brands, '|') AS brands
FROM parsed""")
def normalised(spark, folder):
    rows = normalised_rows(labelled_titles(spark, folder), keep=("id",))
    return rows.select("id", "title", F.array_join(F.filter("stop_words", lambda w: w != ""), "|").alias("stop_words"),
                       joined("targets"), joined("brands"))


FEATURE_SQL = f"""
WITH {LABELLED_SQL}
SELECT id, array_to_string(tokens, '|') AS tokens, target, array_to_string(brands, '|') AS brands FROM features"""


@query("prj3_arr3_arr5_training_features", FEATURE_SQL)
def features(spark, folder):
    rows = training_features(labelled_titles(spark, folder), keep=("id",))
    return rows.select("id", joined("tokens"), "target", joined("brands"))


@query("prj4_prediction_features", f"""
WITH {PLAIN_SQL}
SELECT product_name, array_to_string({merged_sql('t')}, '|') AS tokens
FROM (SELECT product_name, {tokens_sql('product_name', 3)} AS t FROM titles)""")
def prediction_features(spark, folder):
    return title_features(plain_titles(spark, folder)).select("product_name", joined("tokens"))


@query("prj6_aux_struct", """
SELECT vec_id AS tid, len(embedding)::BIGINT AS dimensions, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS squared, label::DOUBLE AS aux_label
FROM embeddings""")
def aux_struct(spark, folder):
    source = table(spark, folder, "embeddings").withColumn("aux", F.struct(F.col("label").cast("double").alias("label")))
    rows = vector_rows(source, "vec_id", "embedding", ("aux",), "tid")
    squared = F.aggregate(F.transform("features", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return rows.select("tid", F.size("features").cast("long").alias("dimensions"),
                       F.round(squared, 6).alias("squared"), F.col("aux.label").alias("aux_label"))


@query("flt1_arr4_agg1_brand_pairs", f"""
WITH {LABELLED_SQL}
SELECT DISTINCT target AS term, unnest(brands) AS brand FROM features WHERE len(brands) > 0""")
def brand_table(spark, folder):
    return brand_pairs(training_features(labelled_titles(spark, folder)))


@query("flt2_arr1_parsed_lists", """
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','),
         lambda x: lower(trim(x, E' \\n\\t\\r'))), lambda x: x <> ''), '|') AS items
FROM documents""")
def parsed_lists(spark, folder):
    return documents(spark, folder).select("doc_id", F.array_join(parse_list("text"), "|").alias("items"))


@query("arr2_parsed_with_empty", """
SELECT doc_id, len(string_split(text, ','))::BIGINT AS n, array_to_string(list_transform(string_split(text, ','),
         lambda x: lower(trim(x, E' \\n\\t\\r'))), '|') AS items
FROM documents""")
def parsed_with_empty(spark, folder):
    items = parse_list("text", keep_empty=True)
    return documents(spark, folder).select("doc_id", F.size(items).cast("long").alias("n"), F.array_join(items, "|").alias("items"))


@query("nul1_explode_keeping_null", """
SELECT c_custkey AS id, unnest(CASE WHEN c_nationkey % 3 = 0 THEN [NULL] WHEN c_nationkey % 3 = 1 THEN []::VARCHAR[]
                                    ELSE string_split(c_name, '#') END) AS item
FROM customer""")
def exploded_keeping_null(spark, folder):
    items = F.when(F.col("c_nationkey") % 3 == 1, F.array().cast("array<string>")).when(F.col("c_nationkey") % 3 == 2, F.split("c_name", "#"))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), explode_keeping_null(items).alias("item"))


@query("arr5_row_stop_words", f"""
SELECT conv_id, turn, array_to_string(list_filter(t, lambda w: NOT list_contains(string_split(role || ',la,the,der', ','), w)), ' ') AS kept
FROM (SELECT *, {tokens_sql('text', 2)} AS t FROM conversations)""")
def row_stop_words(spark, folder):
    words = F.split(F.concat("role", F.lit(",la,the,der")), ",")
    kept = without_words(title_tokens("text"), words)
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(kept, " ").alias("kept"))


@query("arr6_merged_ngrams", f"""
SELECT conv_id, turn, array_to_string({merged_sql('t')}, '|') AS grams
FROM (SELECT *, {tokens_sql('text', 2)} AS t FROM conversations)""")
def merged_ngrams(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", title_tokens("text").alias("t"))
    return rows.select("conv_id", "turn", F.array_join(with_ngrams("t"), "|").alias("grams"))


@query("arr7_shared_items", f"""
WITH {LABELLED_SQL}
SELECT id, array_to_string(list_filter({merged_sql('t')}, lambda x: list_contains(targets, x)), '|') AS terms
FROM (SELECT id, targets, {tokens_sql('title', 2)} AS t FROM parsed)""")
def shared(spark, folder):
    rows = normalised_rows(labelled_titles(spark, folder), keep=("id",))
    grams = rows.select("id", "targets", title_tokens("title").alias("t")).withColumn("grams", with_ngrams("t"))
    return grams.select("id", F.array_join(shared_items("grams", "targets"), "|").alias("terms"))


@query("arr8_membership", f"""
WITH {PLAIN_SQL}
SELECT id, list_contains({tokens_sql('product_name', 3)}, brand)::INT AS has_brand,
       list_contains({tokens_sql('product_name', 3)}, 'large')::INT AS has_large FROM titles""")
def membership(spark, folder):
    tokens = title_tokens("product_name", 3)
    return plain_titles(spark, folder).select(
        "id", F.array_contains(tokens, F.col("brand")).cast("int").alias("has_brand"), F.array_contains(tokens, "large").cast("int").alias("has_large")
    )


NESTED_SQL = f"""
WITH {PLAIN_SQL},
lists AS (
  SELECT id, [core_term, product_name, split_part(product_name, ' ', 1) || ' ' || core_term, brand, stop_word,
              brand || ' ' || stop_word] AS terms
  FROM titles)"""


def nested_lists(spark, folder):
    noun, name = F.col("core_terms"), F.col("product_name")
    return plain_titles(spark, folder).select(
        "id",
        F.array(noun, name, F.concat_ws(" ", F.split(name, " ")[0], noun), F.col("brand"), F.col("stop_words"),
                F.concat_ws(" ", "brand", "stop_words")).alias("terms"),
    )


@query("arr9_minimal_terms", NESTED_SQL + """
SELECT id, array_to_string(list_filter(terms, lambda x: len(list_filter(terms, lambda y: x <> y AND contains(x, y))) = 0), '|') AS terms
FROM lists""")
def minimal(spark, folder):
    return nested_lists(spark, folder).select("id", F.array_join(minimal_terms("terms"), "|").alias("terms"))


@query("arr10_priority_merge", NESTED_SQL + """
SELECT id, array_to_string(f || list_filter(terms, lambda t: len(list_filter(f, lambda x: contains(t, x))) = 0), '|') AS merged
FROM (SELECT id, terms, CASE WHEN id % 4 = 0 THEN []::VARCHAR[] ELSE [terms[1], terms[5]] END AS f FROM lists)""")
def merged(spark, folder):
    first = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("terms")[0], F.col("terms")[4]))
    lists = nested_lists(spark, folder).withColumn("f", first)
    return lists.select("id", F.array_join(priority_merge("f", "terms"), "|").alias("merged"))


@query("arr11_list_text", NESTED_SQL + """
SELECT id, array_to_string(terms, ', ') AS as_text, 6::BIGINT AS back FROM lists""")
def list_and_back(spark, folder):
    text = list_text("terms")
    lists = nested_lists(spark, folder).select("id", text.alias("as_text"))
    return lists.select("id", "as_text", F.size(text_list("as_text")).cast("long").alias("back"))


@query("agg2_corpus_stop_words", f"""
WITH {LABELLED_SQL}
SELECT DISTINCT word FROM (SELECT unnest(stop_words) AS word FROM features) WHERE word <> ''""")
def all_stop_words(spark, folder):
    return corpus_stop_words(training_features(labelled_titles(spark, folder)))


VOCABULARY_SQL = f"""
WITH {LABELLED_SQL},
vocabulary AS (
  SELECT row_number() OVER (ORDER BY freq DESC, term) - 1 AS label_index, term, freq
  FROM (SELECT target AS term, count(*) AS freq FROM features GROUP BY target))"""


@query("agg4_term_vocabulary", VOCABULARY_SQL + " SELECT label_index, term, freq FROM vocabulary")
def vocabulary(spark, folder):
    return term_vocabulary(training_features(labelled_titles(spark, folder)))


@query("join1_index_to_term", VOCABULARY_SQL + """
SELECT p_partkey AS id, term AS predicted_term FROM part LEFT JOIN vocabulary ON label_index = p_size * 2""")
def names_of_indices(spark, folder):
    terms = materialise(term_vocabulary(training_features(labelled_titles(spark, folder))))
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2).cast("double").alias("prediction"))
    return index_to_term(rows, terms).select("id", "predicted_term")


@query("join3_arr12_title_brands", f"""
WITH {LABELLED_SQL},
pairs AS (SELECT DISTINCT target AS term, unnest(brands) AS brand FROM features WHERE len(brands) > 0),
grams AS (
  SELECT DISTINCT id, unnest(m) AS gram FROM (
    SELECT id, {merged_sql('t')} AS m FROM (SELECT id, {tokens_sql('title', 3)} AS t FROM parsed))),
terms AS (SELECT id, targets[i] AS term, i AS pos FROM (SELECT id, targets, unnest(range(1, len(targets) + 1)) AS i FROM parsed)),
found AS (
  SELECT t.id, p.brand, min(t.pos) AS pos
  FROM terms t JOIN pairs p ON p.term = t.term JOIN grams g ON g.id = t.id AND g.gram = p.brand GROUP BY t.id, p.brand),
lists AS (SELECT id, string_agg(brand, '|' ORDER BY pos, brand) AS brands FROM found GROUP BY id)
SELECT id, coalesce(lists.brands, '') AS brands FROM parsed LEFT JOIN lists USING (id)""")
def brands_of_titles(spark, folder):
    labelled = labelled_titles(spark, folder)
    pairs = materialise(brand_pairs(training_features(labelled)))
    rows = normalised_rows(labelled, keep=("id",))
    titles = rows.select("id", "targets", title_tokens("title", 3).alias("t")).select("id", "targets", with_ngrams("t").alias("tokens"))
    present = brands_present(titles, "id", "tokens", pairs)
    return title_brands(titles.select("id", "targets"), "id", "targets", present, pairs).select("id", joined("brands"))
