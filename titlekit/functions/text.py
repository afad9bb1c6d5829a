"""Tokens, n-grams, text cleaning (TXT1-TXT3, TXT6, TXT7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from titlekit.functions.binding import bound

TRAIN_MIN_LEN = 2
PREDICT_MIN_LEN = 3

# The characters and words that cleaning replaces by a blank.
PUNCTUATION = r"""[`~!@#$%^&*()\-+={}\[\];:'"<>,./?]"""
WORD_WITH_DIGIT = r"\w*\d\w* *"

MAX_PHRASE_WORDS = 3


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def title_tokens(text, min_len: int = TRAIN_MIN_LEN, unicode: bool = False) -> Column:
    """Lower-cased words of at least ``min_len`` characters; a null text has no tokens (TXT1, TXT2).

    A word is ASCII ``\\w+`` unless ``unicode`` is set.
    """
    pattern = r"(?U)\w+" if unicode else r"\w+"
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.coalesce(F.filter(words, lambda w: F.length(w) >= min_len), _no_strings())


def ngrams(tokens, n: int) -> Column:
    """Blank-joined runs of ``n`` neighbouring tokens, empty for fewer than ``n`` tokens (TXT3)."""
    if n == 1:
        return F.col(tokens) if isinstance(tokens, str) else tokens
    return bound(lambda t, shorter: _longer(shorter, t, n), tokens, ngrams(tokens, n - 1))


def _longer(shorter: Column, tokens: Column, n: int) -> Column:
    """n-grams from (n - 1)-grams, each joined with the token that follows it."""
    count = F.size(tokens) - (n - 1)
    pairs = F.zip_with(F.slice(shorter, 1, count), F.slice(tokens, n, count), lambda g, t: F.concat_ws(" ", g, t))
    return F.when(count > 0, pairs).otherwise(_no_strings())


def with_ngrams(tokens) -> Column:
    """Tokens, then 2-grams, then 3-grams (ARR6)."""
    return bound(
        lambda t: bound(lambda one, two: F.concat(one, two, _longer(two, one, 3)), t, _longer(t, t, 2)), tokens
    )


def clean_text(text) -> Column:
    """Blank out ASCII punctuation, then words that hold a digit (TXT6)."""
    return F.regexp_replace(F.regexp_replace(text, PUNCTUATION, " "), WORD_WITH_DIGIT, " ")


def short_phrases(phrases, max_words: int = MAX_PHRASE_WORDS) -> Column:
    """Lower-cased phrases of at most ``max_words`` words; blanks at the end make no word (TXT7)."""
    kept = F.filter(phrases, lambda p: F.size(F.split(F.rtrim(p), " +")) <= max_words)
    return F.transform(kept, lambda p: F.lower(p))
