"""Text queries over whole documents (TXT1-TXT9, JOIN2)."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from titlekit.functions.text import clean_text, ngrams, short_phrases, title_tokens, with_ngrams
from titlekit.operators.containment import minimal_in_order, shortest_runs
from titlekit.operators.gazetteer import in_order, known_terms, term_hits
from titlekit.operators.phrases import noun_phrases, phrase_candidates, tag_words, text_words
from titlekit.operators.training import corpus_stop_words, training_features, without_corpus_words
from titlekit.queries.catalog import LABELLED_SQL, documents, joined, labelled_titles, merged_sql, query, table, tokens_sql
from titlekit.queries.english import ENGLISH_STOP_WORDS
from titlekit.session import materialise


@query("txt1_train_tokens", f"""
SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {tokens_sql('text', 2)} AS t FROM documents)""")
def train_tokens(spark, folder):
    tokens = documents(spark, folder).select("doc_id", title_tokens("text", 2).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query("txt2_predict_tokens", f"""
SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {tokens_sql('text', 3)} AS t FROM documents)""")
def predict_tokens(spark, folder):
    tokens = documents(spark, folder).select("doc_id", title_tokens("text", 3).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query("txt3_ngrams", f"""
SELECT doc_id,
       array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|') AS ngrams_2,
       array_to_string(list_transform(range(1, len(t) - 1),
                       lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]), '|') AS ngrams_3
FROM (SELECT doc_id, {tokens_sql('text', 2)} AS t FROM documents)""")
def document_ngrams(spark, folder):
    tokens = documents(spark, folder).select("doc_id", title_tokens("text", 2).alias("t"))
    return tokens.select("doc_id", F.array_join(ngrams("t", 2), "|").alias("ngrams_2"), F.array_join(ngrams("t", 3), "|").alias("ngrams_3"))


@query("txt4_default_stop_words", f"""
SELECT doc_id, array_to_string(list_filter(t, lambda w: NOT list_contains(
         [{', '.join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)}], w)), ' ') AS tokens
FROM (SELECT doc_id, {tokens_sql('text', 2)} AS t FROM documents)""")
def default_stop_words(spark, folder):
    tokens = documents(spark, folder).select("doc_id", title_tokens("text", 2).alias("t"))
    remover = StopWordsRemover(inputCol="t", outputCol="kept", stopWords=StopWordsRemover.loadDefaultStopWords("english"))
    return remover.transform(tokens).select("doc_id", F.array_join("kept", " ").alias("tokens"))


@query("txt5_corpus_stop_words", f"""
WITH {LABELLED_SQL},
stops AS (SELECT list(DISTINCT w) AS words FROM (SELECT unnest(stop_words) AS w FROM features) WHERE w <> ''),
merged AS (SELECT id, target, {merged_sql('tokens')} AS m FROM features)
SELECT id, target, array_to_string(list_filter(m, lambda w: NOT list_contains(stops.words, w)), '|') AS kept
FROM merged, stops""")
def corpus_words_removed(spark, folder):
    features = materialise(training_features(labelled_titles(spark, folder), keep=("id",)))
    rows = features.select("id", "target", with_ngrams("tokens").alias("tokens"), F.concat_ws(":", "id", "target").alias("key"))
    kept = without_corpus_words(rows, "key", "tokens", corpus_stop_words(features), "kept")
    return kept.select("id", "target", joined("kept"))


PUNCTUATION_SQL = r"""[`~!@#$%^&*()\-+={}\[\];:''"<>,./?]"""


@query("txt6_clean_text", rf"""
SELECT doc_id, regexp_replace(regexp_replace(text, '{PUNCTUATION_SQL}', ' ', 'g'), '\w*\d\w* *', ' ', 'g') AS cleaned
FROM documents""")
def cleaned(spark, folder):
    return documents(spark, folder).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query("txt7_short_phrases", """
SELECT doc_id, array_to_string(list_transform(
         list_filter(string_split(text, ','), lambda p: len(regexp_split_to_array(rtrim(p, ' '), ' +')) < 4),
         lambda p: lower(p)), '|') AS phrases
FROM documents""")
def short_document_phrases(spark, folder):
    phrases = documents(spark, folder).select("doc_id", F.split("text", ",").alias("p"))
    return phrases.select("doc_id", F.array_join(short_phrases("p"), "|").alias("phrases"))


def benchmark_lexicon(spark, folder):
    """A tag for each word of the benchmark texts, by its length."""
    words = table(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))
    tag = F.when(F.length("word") >= 8, "NNP").when(F.length("word") <= 3, "DT").otherwise("VB")
    return materialise(words.distinct().withColumn("tag", tag))


TAGGED_SQL = r"""
lexicon AS (
  SELECT DISTINCT w AS word, CASE WHEN length(w) >= 8 THEN 'NNP' WHEN length(w) <= 3 THEN 'DT' ELSE 'VB' END AS tag
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS w FROM benchmark)),
sentences AS (
  SELECT doc_id, s[i] AS t, i - 1 AS sentence
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
        FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+\s+') AS s FROM documents))),
words AS (
  SELECT doc_id, sentence, i - 1 AS pos, w[i] AS word
  FROM (SELECT doc_id, sentence, w, unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT doc_id, sentence, regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM sentences))),
tagged AS (
  SELECT doc_id, sentence, pos, words.word,
         coalesce(lexicon.tag,
                  CASE WHEN regexp_matches(words.word, '^[^\p{L}\p{N}_]$') THEN words.word
                       WHEN regexp_matches(words.word, '^\p{Lu}') THEN 'NNP'
                       WHEN regexp_matches(words.word, '^\p{N}') THEN 'CD' ELSE 'NN' END) AS tag
  FROM words LEFT JOIN lexicon ON lower(words.word) = lexicon.word)"""

PHRASE_SQL = TAGGED_SQL + r""",
marked AS (
  SELECT *, starts_with(tag, 'NNP') AND NOT starts_with(word, 'http') AS noun,
         trim(regexp_replace(word, '[,@&\-()"'']+', '', 'g')) = '' OR tag = word AS joiner
  FROM tagged),
runs AS (
  SELECT *, sum(CASE WHEN noun OR joiner THEN 0 ELSE 1 END) OVER (
              PARTITION BY doc_id, sentence ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
  FROM marked),
ends AS (
  SELECT doc_id, sentence, run, min(pos) AS first_pos, max(pos) AS last_pos
  FROM runs WHERE noun GROUP BY ALL),
phrases AS (
  SELECT r.doc_id, r.sentence, e.first_pos AS pos, string_agg(r.word, ' ' ORDER BY r.pos) AS phrase
  FROM runs r JOIN ends e ON r.doc_id = e.doc_id AND r.sentence = e.sentence AND r.run = e.run
  WHERE (r.noun OR r.joiner) AND r.pos BETWEEN e.first_pos AND e.last_pos
  GROUP BY r.doc_id, r.sentence, r.run, e.first_pos)"""


@query("txt8_noun_phrases", f"""
WITH {PHRASE_SQL}
SELECT doc_id, sentence::BIGINT AS sentence, pos::BIGINT AS pos, phrase FROM phrases""")
def document_noun_phrases(spark, folder):
    words = text_words(documents(spark, folder), "doc_id", "text")
    phrases = noun_phrases(tag_words(words, benchmark_lexicon(spark, folder)), "doc_id")
    return phrases.select("doc_id", F.col("sentence").cast("long").alias("sentence"), F.col("pos").cast("long").alias("pos"), "phrase")


@query("txt8_phrase_candidates", f"""
WITH {PHRASE_SQL},
short AS (
  SELECT doc_id, lower(phrase) AS phrase, min(sentence * 1000000 + pos) AS place
  FROM phrases WHERE len(regexp_split_to_array(phrase, ' +')) < 4 GROUP BY doc_id, lower(phrase))
SELECT doc_id, string_agg(phrase, '|' ORDER BY place) AS phrases FROM short GROUP BY doc_id""")
def document_phrase_candidates(spark, folder):
    words = text_words(documents(spark, folder), "doc_id", "text")
    phrases = noun_phrases(tag_words(words, benchmark_lexicon(spark, folder)), "doc_id")
    return phrase_candidates(phrases, "doc_id").where(F.size("phrases") > 0).select("doc_id", joined("phrases"))


@query("txt9_tagged_words", f"""
WITH {TAGGED_SQL}
SELECT doc_id, tag, count(*) AS n, max(pos)::BIGINT AS last_pos FROM tagged GROUP BY doc_id, tag""")
def tagged_words(spark, folder):
    words = text_words(documents(spark, folder), "doc_id", "text")
    tagged = tag_words(words, benchmark_lexicon(spark, folder))
    return tagged.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.max("pos").cast("long").alias("last_pos"))


def benchmark_terms(spark, folder):
    """Words, 2-grams and 3-grams of the benchmark texts as a list of known terms."""
    texts = table(spark, folder, "benchmark").select(with_ngrams(title_tokens("text", 3)).alias("grams"))
    return materialise(texts.select(F.explode("grams").alias("term")).distinct())


HITS_SQL = f"""
known AS (
  SELECT DISTINCT unnest({merged_sql('t')}) AS term
  FROM (SELECT {tokens_sql('text', 3)} AS t FROM benchmark)),
grams AS (
  SELECT doc_id, m[i] AS term, i AS pos
  FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, {merged_sql('t')} AS m FROM (SELECT doc_id, {tokens_sql('text', 3)} AS t FROM documents)))),
hits AS (
  SELECT doc_id, term, min(pos) AS pos FROM grams WHERE term IN (SELECT term FROM known) GROUP BY doc_id, term)"""


def document_grams(spark, folder, longer=True):
    """Words of every document, and with ``longer`` their 2-grams and 3-grams."""
    words = title_tokens("text", 3)
    return documents(spark, folder).select("doc_id", (with_ngrams(words) if longer else words).alias("tokens"))


@query("join2_gazetteer_terms", f"""
WITH {HITS_SQL},
lists AS (SELECT doc_id, string_agg(term, '|' ORDER BY pos) AS terms FROM hits GROUP BY doc_id)
SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN lists USING (doc_id)""")
def gazetteer_terms(spark, folder):
    found = known_terms(document_grams(spark, folder), "doc_id", "tokens", benchmark_terms(spark, folder))
    return found.select("doc_id", joined("terms"))


@query("arr9_minimal_terms_of_documents", f"""
WITH {HITS_SQL}
SELECT doc_id, string_agg(term, '|' ORDER BY pos) AS terms
FROM hits x
WHERE NOT EXISTS (SELECT 1 FROM hits y WHERE y.doc_id = x.doc_id AND y.term <> x.term AND contains(x.term, y.term))
GROUP BY doc_id""")
def minimal_document_terms(spark, folder):
    """Terms that hold another one as a run of words are never minimal in a document's n-grams, so they are not looked for.

    Documents without an id are not compared with each other: they keep all their terms.
    """
    known = benchmark_terms(spark, folder)
    terms = materialise(shortest_runs(known))
    longer = not terms.where(F.contains("term", F.lit(" "))).isEmpty()
    hits = term_hits(document_grams(spark, folder, longer).where("doc_id is not null"), "doc_id", "tokens", terms)
    unnamed = term_hits(document_grams(spark, folder).where("doc_id is null"), "doc_id", "tokens", known)
    lists = minimal_in_order(hits, "doc_id", "terms", terms).unionByName(in_order(unnamed, "doc_id", "terms"))
    return lists.select("doc_id", joined("terms"))
