"""Counts, metrics and samples (AGG5, AGG7, AGG8, AGG17, SMP, PRT2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlekit.functions.text import title_tokens
from titlekit.knn.predict import class_histogram
from titlekit.operators.evaluation import class_metrics, weighted_metrics
from titlekit.operators.sampling import sample_rows, size_samples
from titlekit.operators.vocabulary import numbered, token_counts
from titlekit.queries.catalog import documents, query, table, tokens_sql


@query("agg5_token_counts", f"""
SELECT token, count(*) AS freq FROM (SELECT unnest({tokens_sql('text', 2)}) AS token FROM documents) GROUP BY token""")
def counted_tokens(spark, folder):
    return token_counts(documents(spark, folder).select(title_tokens("text").alias("tokens")))


@query("agg7_row_count", "SELECT count(*) AS n, least(1.0, 1000.0 / count(*))::DOUBLE AS fraction FROM embeddings")
def row_count(spark, folder):
    return table(spark, folder, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), 1000.0 / F.count(F.lit(1))).alias("fraction"))


@query("agg8_class_histogram", "SELECT label::DOUBLE AS label, count(*) AS n FROM embeddings GROUP BY label")
def histogram(spark, folder):
    return class_histogram(table(spark, folder, "embeddings"))


SCORED_SQL = """
scored AS (SELECT (doc_id + quality) % 5 AS label, (doc_id + toxic * 2) % 5 AS prediction FROM labels),
classes AS (
  SELECT label, count(*) AS support, sum((label = prediction)::INT) AS hits,
         (SELECT count(*) FROM scored g WHERE g.prediction = s.label) AS guessed
  FROM scored s GROUP BY label),
scores AS (
  SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision, hits / support AS recall FROM classes),
full_scores AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM scores)"""


def scored(spark, folder):
    return table(spark, folder, "labels").select(
        ((F.col("doc_id") + F.col("quality")) % 5).cast("double").alias("label"),
        ((F.col("doc_id") + F.col("toxic") * 2) % 5).cast("double").alias("prediction"),
    )


@query("agg17_class_metrics", f"""
WITH {SCORED_SQL}
SELECT label::DOUBLE AS label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_scores""")
def metrics_by_class(spark, folder):
    rows = class_metrics(scored(spark, folder))
    return rows.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("agg17_weighted_metrics", f"""
WITH {SCORED_SQL}
SELECT round(sum(f1 * support) / sum(support), 6) AS f1, round(sum(precision * support) / sum(support), 6) AS "weightedPrecision",
       round(sum(recall * support) / sum(support), 6) AS "weightedRecall", round(sum(hits) / sum(support), 6) AS accuracy
FROM full_scores""")
def metrics(spark, folder):
    return weighted_metrics(scored(spark, folder)).select(
        *[F.round(c, 6).alias(c) for c in ("f1", "weightedPrecision", "weightedRecall", "accuracy")]
    )


@query("smp1_sample", """
SELECT doc_id FROM documents
WHERE ('0x' || substr(md5('7:' || doc_id), 1, 8))::UBIGINT / 4294967296.0 < least(1.0, 300.0 / (SELECT count(*) FROM documents))""")
def sampled(spark, folder):
    return sample_rows(table(spark, folder, "documents").select("doc_id"), "doc_id", 300, seed=7)


@query("smp2_size_samples", """
SELECT i::INT AS sample, count(*) AS n, sum(event_id)::BIGINT AS ids
FROM events, (SELECT unnest(range(0, 10)) AS i)
WHERE ('0x' || substr(md5('3:' || i || ':' || event_id), 1, 8))::UBIGINT / 4294967296.0 * (SELECT count(*) FROM events) < 100 * (i + 1)
GROUP BY i""")
def samples_of_sizes(spark, folder):
    drawn = size_samples(table(spark, folder, "events").select("event_id"), "event_id", range(100, 1001, 100), seed=3)
    return drawn.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("prt2_row_numbers", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_number FROM orders""")
def row_numbers(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return numbered(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], "row_number").select("o_orderkey", "row_number")
