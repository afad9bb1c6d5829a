"""ARR9 and ARR10 for long lists, as equi-joins on substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlekit.functions.binding import bound
from titlekit.functions.lists import minimal_terms
from titlekit.operators.gazetteer import in_order
from titlekit.operators.lookup import lookup_join
from titlekit.session import materialise

#: Items up to which a list is compared with itself inside its row.
LONG_LIST = 200
#: Items up to which a list is searched for the few known parts of its items.
SEARCHED_LIST = 2000


def parts_of(term: Column, whole_words: bool = False, lengths: list[int] | None = None) -> Column:
    """All distinct substrings of a term, or all its distinct runs of whole words; with ``lengths`` only of those many
    characters or words."""
    if lengths is not None:
        sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
        words = F.split(term, " ")

        def of_length(n: Column, count: Column, cut) -> Column:
            return F.when(n <= count, F.transform(F.sequence(F.lit(1), count - n + 1), lambda i: cut(i, n))).otherwise(F.array().cast("array<string>"))

        count = F.size(words) if whole_words else F.length(term)
        cut = (lambda i, n: F.array_join(F.slice(words, i, n), " ")) if whole_words else (lambda i, n: F.substring(term, i, n))
        return F.array_distinct(F.flatten(F.transform(sizes, lambda n: of_length(n, count, cut))))
    if whole_words:
        words = F.split(term, " ")
        spans = F.transform(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " ")
            ),
        )
    else:
        spans = F.transform(
            F.sequence(F.lit(1), F.length(term)),
            lambda i: F.transform(F.sequence(F.lit(1), F.length(term) - i + 1), lambda n: F.substring(term, i, n)),
        )
    return F.array_distinct(F.flatten(spans))


def nested_pairs(holders: DataFrame, parts: DataFrame, whole_words: bool = False) -> DataFrame:
    """``term, parts``: the terms of ``holders`` that hold other terms of ``parts``, both ``(term)``.

    Only substrings of lengths that occur among the parts are formed. They meet the parts by a measured broadcast, or by
    a salted join that spreads a substring found in very many terms.
    """
    parts_count = int(holders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.size(F.split("term", " ")) if whole_words else F.length("term")
    # one number for each different length
    lengths = sorted(r[0] for r in parts.select(size.alias("n")).where("n > 0").distinct().collect())
    spans = holders.repartition(parts_count, "term").select("term", F.explode(parts_of(F.col("term"), whole_words, lengths)).alias("part")).where("part <> term")
    inner = parts.select(F.col("term").alias("part")).distinct()
    return lookup_join(spans, inner, ["part"], "left_semi").groupBy("term").agg(F.collect_list("part").alias("parts"))


def without_holders(items: DataFrame, id_col: str, term_col: str, parts: DataFrame, part_col: str,
                    whole_words: bool = False) -> DataFrame:
    """Rows of ``items`` whose term holds no other term that ``parts`` has for the same id.

    Nesting is settled once for the different terms. A row then asks only for the few parts its term can have, so work
    does not grow with the square of an id's list.
    """
    vocabulary = items.select(F.col(term_col).alias("term")).distinct()
    pairs = materialise(nested_pairs(vocabulary, parts.select(F.col(part_col).alias("term")).distinct(), whole_words))
    asked = lookup_join(items.select(id_col, F.col(term_col).alias("term")), pairs, ["term"])
    spans = asked.select(id_col, F.col("term").alias(term_col), F.explode("parts").alias("_part"))
    inner = parts.select(id_col, F.col(part_col).alias("_part")).distinct()
    holders = spans.join(inner, [id_col, "_part"], "left_semi").select(id_col, term_col).distinct()
    return items.join(holders, [id_col, term_col], "left_anti")


def shortest_runs(terms: DataFrame) -> DataFrame:
    """``(term)``: the terms that hold no other one as a run of whole words.

    Lists of all n-grams of a text have with a term each shorter run of its words, so the others are never minimal there
    (ARR9), and what holds one of them holds one of these.
    """
    longer = nested_pairs(terms, terms, whole_words=True).select("term")
    return terms.join(longer, "term", "left_anti")


def minimal_terms_of(hits: DataFrame, id_col: str, term_col: str = "term", whole_words: bool = False) -> DataFrame:
    """ARR9 on rows ``(id, term, ...)``."""
    return without_holders(hits, id_col, term_col, hits, term_col, whole_words)


def minimal_in_order(hits: DataFrame, id_col: str, out: str, terms: DataFrame, whole_words: bool = False,
                     long: int | None = None) -> DataFrame:
    """``(id, out)``: ARR9 on rows ``(id, pos, term)`` as one list, in order of place; ``terms`` has every term of them.

    A row brings the parts of its term along, so one grouping by id settles lists of up to ``long`` items; longer ones go
    by the join of ``minimal_terms_of``. Both give the same terms. Rows without an id are not compared.
    """
    limit = SEARCHED_LIST if long is None else long
    known = terms.select("term").distinct()
    pairs = materialise(nested_pairs(known, known, whole_words))
    items = lookup_join(hits.select(id_col, "pos", "term"), pairs, ["term"], "left")
    lists = materialise(items.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "term", "parts"))).alias("_items")))
    size = F.size("_items")

    def minimal(all_items: Column, present: Column) -> Column:
        kept = F.filter(all_items, lambda x: x["parts"].isNull() | ~F.exists(x["parts"], lambda p: F.array_contains(present, p)))
        return F.transform(kept, lambda x: x["term"])

    present = F.when(F.col(id_col).isNotNull(), F.array_compact(F.transform("_items", lambda x: x["term"])))
    short = lists.where(size <= limit).select(id_col, bound(minimal, "_items", F.coalesce(present, F.array().cast("array<string>"))).alias(out))
    rest = lists.where(size > limit).select(id_col, F.inline("_items")).drop("parts")
    return short.where(F.size(out) > 0).unionByName(in_order(minimal_terms_of(rest, id_col, "term", whole_words), id_col, out))


def minimal_lists(titles: DataFrame, id_col: str, list_col: str, out: str, whole_words: bool = False, long: int | None = None) -> DataFrame:
    """``titles`` (unique by ``id``) with ``out``, the list without items that hold another one (ARR9), in the list's order.

    Lists of up to ``long`` items are settled inside the row; longer ones, which would cost the square of their length, by
    the join of ``minimal_terms_of``. Both give the same terms.
    """
    limit = LONG_LIST if long is None else long
    size = F.size(F.coalesce(list_col, F.array().cast("array<string>")))
    short = titles.where(size <= limit).withColumn(out, minimal_terms(list_col, whole_words))
    rest = materialise(titles.where(size > limit))
    items = rest.select(id_col, F.posexplode(list_col).alias("pos", "term"))
    lists = in_order(minimal_terms_of(items, id_col, "term", whole_words), id_col, out)
    joined = rest.join(lists, id_col, "left")
    return short.unionByName(joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>"))))
