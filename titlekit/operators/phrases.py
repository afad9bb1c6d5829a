"""Tagged tokens and proper-noun phrases (TXT7-TXT9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlekit.functions.text import clean_text, short_phrases
from titlekit.operators.lookup import lookup_join

# What may join two nouns, and the prefixes of noun tags and links.
JOINER_CHARACTERS = r"""[,@&\-()"']+"""
NOUN_TAG = "NNP"
LINK = "http"

SENTENCE_END = r"[.!?]+\s+"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def title_words(titles: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, sentence, pos, word)`` of a cleaned title, which is one sentence without punctuation."""
    words = F.filter(F.split(clean_text(F.col(text_col)), r"\s+"), lambda w: w != "")
    return titles.select(id_col, F.lit(0).alias("sentence"), F.posexplode(words).alias("pos", "word"))


def text_words(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, sentence, pos, word)`` of running text; punctuation marks are words of their own."""
    sentences = texts.select(id_col, F.posexplode(F.split(text_col, SENTENCE_END)).alias("sentence", "_text"))
    words = F.regexp_extract_all("_text", F.lit(WORD_OR_MARK), F.lit(0))
    return sentences.select(id_col, "sentence", F.posexplode(words).alias("pos", "word"))


def unknown_tag(word: Column) -> Column:
    """Tag of a word outside the lexicon: a mark is its own tag, a capital starts a proper noun, digits a number."""
    return (
        F.when(word.rlike(r"^[^\p{L}\p{N}_]$"), word)
        .when(word.rlike(r"^\p{Lu}"), F.lit(NOUN_TAG))
        .when(word.rlike(r"^\p{N}"), F.lit("CD"))
        .otherwise(F.lit("NN"))
    )


def tag_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add ``tag`` from the table ``lexicon(word, tag)``, looked up in lower case (TXT9)."""
    known = lexicon.groupBy(F.lower("word").alias("_key")).agg(F.min("tag").alias("_tag"))
    keyed = words.withColumn("_key", F.lower("word"))
    tagged = lookup_join(keyed, known, ["_key"], "left")
    return tagged.withColumn("tag", F.coalesce("_tag", unknown_tag(F.col("word")))).drop("_key", "_tag")


def is_proper_noun(tag, word) -> Column:
    return F.startswith(tag, F.lit(NOUN_TAG)) & ~F.startswith(word, F.lit(LINK))


def is_joiner(tag, word) -> Column:
    return (F.trim(F.regexp_replace(word, JOINER_CHARACTERS, "")) == "") | (tag == word)


def noun_phrases(tagged: DataFrame, id_col: str) -> DataFrame:
    """``(id, sentence, pos, phrase)``: runs of proper nouns with the joiners between them (TXT8).

    A run ends at the first word that is neither; joiners at its ends are trimmed. Only nouns and joiners are shuffled,
    once for the window and the grouping, because both are by text and sentence: words of one run stand next to each
    other, so place minus rank is the same for all of them.
    """
    noun = is_proper_noun(F.col("tag"), F.col("word"))
    marked = tagged.withColumn("_noun", noun).withColumn("_in", F.col("_noun") | is_joiner(F.col("tag"), F.col("word")))
    by_sentence = Window.partitionBy(id_col, "sentence").orderBy("pos")
    runs = marked.where("_in").withColumn("_run", F.col("pos") - F.row_number().over(by_sentence))
    noun_pos = F.when(F.col("_noun"), F.col("pos"))
    grouped = runs.groupBy(id_col, "sentence", "_run").agg(
        F.min(noun_pos).alias("pos"),
        F.max(noun_pos).alias("_last"),
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_words"),
    )
    inside = F.filter("_words", lambda w: (w["pos"] >= F.col("pos")) & (w["pos"] <= F.col("_last")))
    phrase = F.array_join(F.transform(inside, lambda w: w["word"]), " ")
    return grouped.where(F.col("pos").isNotNull()).select(id_col, "sentence", "pos", phrase.alias("phrase"))


def phrase_candidates(phrases: DataFrame, id_col: str, out: str = "phrases") -> DataFrame:
    """``(id, out)``: a text's distinct short phrases in lower case, by first place (TXT7)."""
    placed = F.array_sort(F.collect_list(F.struct("sentence", "pos", "phrase")))
    texts = F.array_distinct(F.transform(placed, lambda p: p["phrase"]))
    return phrases.groupBy(id_col).agg(F.array_distinct(short_phrases(texts)).alias(out))
