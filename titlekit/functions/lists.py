"""List columns: parsing, filtering, merging (ARR1-ARR11, NUL1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from titlekit.functions.binding import bound

# Blanks and control characters, which are cut from both ends of a list item.
EDGE_CHARACTERS = "".join(chr(i) for i in range(0x21))


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_list(text, keep_empty: bool = False) -> Column:
    """Items of a comma list, trimmed and lower-cased; a null text is an empty list (ARR1, ARR2)."""
    parts = F.split(F.coalesce(_column(text), F.lit("")), ",")
    items = F.transform(parts, lambda x: F.lower(F.btrim(x, F.lit(EDGE_CHARACTERS))))
    return items if keep_empty else F.filter(items, lambda x: x != "")


def explode_keeping_null(items) -> Column:
    """Explode; a null list gives one null row, an empty list none (NUL1, ARR3, ARR4)."""
    return F.explode(F.coalesce(_column(items), F.array(F.lit(None).cast("string"))))


def without_words(tokens, words) -> Column:
    """Tokens that are not in ``words``, order and repeats kept (ARR5)."""
    words = F.coalesce(_column(words), F.array().cast("array<string>"))
    return bound(lambda ts, ws: F.filter(ts, lambda t: ~F.array_contains(ws, t)), _column(tokens), words)


def shared_items(tokens, terms) -> Column:
    """Items of ``tokens`` that are in ``terms``, each once, first seen first (ARR7)."""
    return F.array_intersect(_column(tokens), _column(terms))


def holds(text: Column, part: Column, whole_words: bool = False) -> Column:
    """True if ``part`` occurs in ``text``, optionally only between word boundaries (blanks)."""
    if whole_words:
        blank = F.lit(" ")
        return F.contains(F.concat(blank, text, blank), F.concat(blank, part, blank))
    return F.contains(text, part)


def minimal_terms(terms, whole_words: bool = False) -> Column:
    """Drop every term that holds another term of the list, so the shortest remain (ARR9).

    Quadratic in the list's own length, which is small for titles. For lists from long texts use
    ``operators.containment.minimal_terms_of``, which gives the same terms by an equi-join.
    """
    def shortest(ts: Column) -> Column:
        return F.filter(ts, lambda x: ~F.exists(ts, lambda y: (x != y) & holds(x, y, whole_words)))

    return bound(shortest, terms)


def priority_merge(first, second, whole_words: bool = False) -> Column:
    """``first``, then the items of ``second`` that hold no item of ``first`` (ARR10)."""
    def merged(t1: Column, t2: Column) -> Column:
        return F.concat(t1, F.filter(t2, lambda t: ~F.exists(t1, lambda x: holds(t, x, whole_words))))

    return bound(merged, first, second)


def list_text(items) -> Column:
    """List to ``", "`` text (ARR11)."""
    return F.array_join(_column(items), ", ")


def text_list(text) -> Column:
    """``", "`` text back to a list; empty text is an empty list (ARR11)."""
    parts = F.transform(F.split(_column(text), ","), lambda x: F.btrim(x, F.lit(EDGE_CHARACTERS)))
    return F.filter(parts, lambda x: x != "")
