"""Round trips through files and streams (SRC, SNK, STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlekit.operators.brands import brand_pairs
from titlekit.operators.training import training_features
from titlekit.operators.vocabulary import term_vocabulary
from titlekit.plans.model import indexed, term_stages
from titlekit.plans.predict import predict_titles
from titlekit.queries.catalog import LABELLED_SQL, PLAIN_SQL, joined, labelled_titles, plain_titles, query, table
from titlekit.queries.lists import VOCABULARY_SQL
from titlekit.queries.model import PREDICTED_SQL, TERMS_SQL, plain_features
from titlekit.session import materialise, new_folder
from titlekit.sources.attributes import read_brands, read_model, read_terms, write_model, write_table
from titlekit.sources.titles import AS_IS, read_labelled, read_unlabelled, write_results
from titlekit.streaming.predict import RowPrinter, predict_stream, read_stream
from titlekit.streaming.stateless import predict_rows_stream


@query("src1_labelled_csv", f"WITH {LABELLED_SQL} SELECT product_name, core_terms, brand, stop_words FROM labelled")
def labelled_csv(spark, folder):
    path = new_folder(spark, "csv")
    rows = labelled_titles(spark, folder)
    rows.select("id", "stop_words", "product_name", "brand", "core_terms").write.options(**AS_IS).csv(path)
    return read_labelled(spark, f"{path}/*.csv")


@query("src2_unlabelled_csv", f"WITH {PLAIN_SQL} SELECT product_name || ', \"' || brand || '\"' AS product_name FROM titles")
def unlabelled_csv(spark, folder):
    """Titles with commas and quotes, in files whose lines end with a bare CR."""
    path = new_folder(spark, "csv")
    quoted = F.concat("product_name", F.lit(', "'), "brand", F.lit('"'))
    plain_titles(spark, folder).select(quoted.alias("product_name")).write.options(**AS_IS).option("lineSep", "\r").csv(path)
    return read_unlabelled(spark, path)


@query("src3_snk2_brand_table", f"""
WITH {LABELLED_SQL} SELECT DISTINCT target AS term, unnest(brands) AS brand FROM features WHERE len(brands) > 0""")
def brand_table(spark, folder):
    path = new_folder(spark, "brands")
    write_table(brand_pairs(training_features(labelled_titles(spark, folder))), path)
    return read_brands(spark, path)


@query("src4_snk3_term_table", VOCABULARY_SQL + " SELECT label_index, term FROM vocabulary")
def term_table(spark, folder):
    path = new_folder(spark, "terms")
    write_table(term_vocabulary(training_features(labelled_titles(spark, folder))), path)
    return read_terms(spark, path)


@query("src4_one_row_terms", VOCABULARY_SQL + " SELECT label_index, term FROM vocabulary")
def one_row_terms(spark, folder):
    """The vocabulary kept as one row with a list, which is bounded by the classes of one classifier."""
    path = new_folder(spark, "terms")
    _, labels = indexed(training_features(labelled_titles(spark, folder)))
    write_table(spark.createDataFrame([("labels", labels)], "attr_term string, value array<string>"), path)
    return read_terms(spark, path)


@query("src5_snk1_saved_model", f"WITH {PLAIN_SQL} SELECT count(*) AS n, 0::BIGINT AS differing FROM titles")
def saved_model(spark, folder):
    """A model read back scores every title as the one that was written."""
    rows, _ = indexed(plain_features(spark, folder))
    rows = materialise(rows.select("id", "label", "tokens"))
    model = term_stages(2).fit(rows)
    path = new_folder(spark, "model")
    write_model(model, path)
    before = model.transform(rows).select("id", F.col("prediction").alias("before"))
    after = read_model(path).transform(rows).select("id", F.col("prediction").alias("after"))
    both = before.join(after, "id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("before") != F.col("after")).cast("long")).alias("differing"))


@query("snk4_result_csv", PREDICTED_SQL.replace("array_to_string(terms, '|')", "array_to_string(terms, ', ')").replace("coalesce(brands, '')", "brands"))
def result_csv(spark, folder):
    titles = plain_titles(spark, folder)
    terms = materialise(titles.select(F.col("core_terms").alias("term")).distinct())
    pairs = materialise(titles.select(F.col("core_terms").alias("term"), "brand").distinct())
    path = new_folder(spark, "results")
    write_results(predict_titles(titles, None, terms, pairs), path)
    return spark.read.option("header", True).csv(path)


@query("str1_str2_predicted_stream", TERMS_SQL + " SELECT id, product_name, array_to_string(terms, '|') AS core_terms FROM found")
def predicted_stream(spark, folder):
    titles = plain_titles(spark, folder)
    terms = materialise(titles.select(F.col("core_terms").alias("term")).distinct())
    pairs = materialise(titles.select(F.col("core_terms").alias("term"), "brand").distinct())
    source = new_folder(spark, "titles")
    stored = titles.select("id", "product_name")
    stored.repartition(4).write.parquet(source)
    output = new_folder(spark, "predicted")
    stream = read_stream(spark, source, stored.schema, files_per_batch=2)
    started = predict_stream(stream, "id", None, terms, pairs, output, new_folder(spark, "progress"))
    started.awaitTermination()
    return spark.read.parquet(output).select("id", "product_name", joined("core_terms"))


@query("str1_stateless_stream", PREDICTED_SQL.replace("SELECT product_name, array_to_string", "SELECT id, product_name, array_to_string"))
def stateless_stream(spark, folder):
    """One streaming query of list expressions and model steps, without a function over micro-batches."""
    titles = plain_titles(spark, folder)
    terms = materialise(titles.select(F.col("core_terms").alias("term")).distinct())
    pairs = materialise(titles.select(F.col("core_terms").alias("term"), "brand").distinct())
    source, output = new_folder(spark, "titles"), new_folder(spark, "predicted")
    stored = titles.select("id", "product_name")
    stored.repartition(4).write.parquet(source)
    stream = read_stream(spark, source, stored.schema, files_per_batch=2)
    predict_rows_stream(stream, None, terms, pairs, output, new_folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(output).select("id", "product_name", joined("core_terms"), joined("brands"))


@query("src6_file_uri", f"WITH {PLAIN_SQL} SELECT product_name FROM titles")
def file_uri(spark, folder):
    """Titles written under a location and read again by its full URI, with a scheme."""
    path = new_folder(spark, "csv")
    plain_titles(spark, folder).select("product_name").write.options(**AS_IS).csv(path)
    uri = spark.read.format("binaryFile").load(f"{path}/*.csv").select("path").first()["path"].rsplit("/", 1)[0]
    if "://" not in uri:
        uri = uri.replace("file:", "file://", 1)
    return read_unlabelled(spark, uri)


@query("snk5_str4_printed_rows", "SELECT count(*) AS printed FROM events")
def printed_rows(spark, folder):
    """Every streamed row passes the row sink once; here the sink counts instead of printing."""
    events = table(spark, folder, "events")
    source = new_folder(spark, "events")
    events.repartition(4).write.parquet(source)
    seen = spark.sparkContext.accumulator(0)
    stream = read_stream(spark, source, events.schema)
    sink = RowPrinter(lambda row: seen.add(1))
    started = stream.writeStream.foreach(sink).option("checkpointLocation", new_folder(spark, "progress")).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.createDataFrame([(seen.value,)], "printed long")
