"""Surrogates for personal data: the same entity gets the same surrogate everywhere, two entities never share one.

Mentions are found text by text (``entities``). The distinct entities of all documents then get their surrogates in
rounds: each open entity draws a candidate from a keyed hash; a candidate that is itself an entity of the corpus, that is
already given away, or that an entity with a lower hash draws in the same round, is refused and the entity draws again.
Nearly all are settled in the first round, and the rounds end when none is open. Entities are counted before each shuffle,
so an address in every document is one row. Surrogates go back to the mentions by a measured broadcast or a salted join;
documents meet their mentions by two hashes of id and text in the same way, so texts are shuffled only if the mentions do
not fit a broadcast.

A null text stays null, an empty one empty, without mentions. Repeated rows are rewritten alike; an empty table gives an
empty result; extra columns are ignored. With the same key and the same documents the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import as_text, by_slice, col, strings_of
from titlekit.llm.entities import candidate, mentions, name_finder, written
from titlekit.operators.lookup import lookup_join
from titlekit.session import materialise, spread

MOST_ATTEMPTS = 200

MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("canonical", pa.string())])


def found_mentions(rows: DataFrame) -> DataFrame:
    """``rows`` (columns, then text) with the mentions of each text instead of it; positions count code points."""
    finder = []

    def find(texts: list[bytes]) -> list:
        if not finder:
            finder.append(name_finder())
        out = [[m._asdict() for m in mentions(as_text(t), finder[0])] for t in texts]
        return [pa.array(out, pa.list_(MENTION))]

    return by_slice(spread(rows), find, "mentions array<struct<start:bigint,end:bigint,kind:string,canonical:string>>")


def drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt, surrogate): the candidate of each entity for its attempt."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = [candidate(key, *r) for r in zip(strings_of(batch.column(0)), strings_of(batch.column(1)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "canonical", "attempt", "surrogate"])

    return entities.select("kind", "canonical", "attempt").mapInArrow(batches, "kind string, canonical string, attempt int, surrogate string")


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, surrogate) of all entities (distinct kind, canonical); surrogates of a kind are distinct and
    none of them is an entity.

    Later attempts draw from a wider room (longer names and numbers, other networks), so a kind that is full in its own
    format ends too; only addresses have a last value, and when they are used up the job stops with an error.
    """
    entities = materialise(entities.select("kind", "canonical").distinct())
    open_ones = entities.withColumn("attempt", F.lit(0))
    given, attempt = None, 0
    while True:
        found = drawn(open_ones, key)
        taken = entities.select("kind", F.col("canonical").alias("surrogate"))
        free = found.join(taken, ["kind", "surrogate"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        # of the entities that draw one candidate, the one with the lowest hash gets it
        order = F.struct(F.xxhash64("canonical").alias("h"), F.col("canonical").alias("canonical"))
        won = free.groupBy("kind", "surrogate").agg(F.min(order).alias("first"))
        won = materialise(won.select("kind", F.col("first.canonical").alias("canonical"), "surrogate"))
        given = won if given is None else materialise(given.union(won))
        left = open_ones.join(won.select("kind", "canonical"), ["kind", "canonical"], "left_anti")
        open_ones = materialise(left.withColumn("attempt", F.col("attempt") + 1))
        if open_ones.isEmpty():
            return given
        attempt += 1
        if attempt > MOST_ATTEMPTS:
            raise ValueError("a kind of entities has no surrogates left")


def surrogated(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_mentions, kinds) of every document: the text with surrogates, and how often each kind occurs."""
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    keyed = own.withColumns({"one": F.xxhash64("id", "text"), "two": F.xxhash64(F.lit("second"), "id", "text")})
    found = found_mentions(keyed.select("one", "two", "text")).where("size(mentions) > 0")
    found = materialise(found.groupBy("one", "two").agg(F.first("mentions").alias("mentions")))
    listed = found.select("one", "two", F.inline("mentions"))
    surrogates = assigned(listed.select("kind", "canonical"), key)
    met = lookup_join(listed, surrogates, ["kind", "canonical"])
    places = met.groupBy("one", "two").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("places"))
    joined = lookup_join(keyed, materialise(places), ["one", "two"], "left").select("id", "places", "text")
    out = joined.mapInArrow(rewritten, f"id {dict(own.dtypes)['id']}, kinds array<string>, text string")
    counts = F.transform(F.array_sort(F.array_distinct("kinds")), lambda k: F.concat_ws(":", k, F.size(F.filter("kinds", lambda x: x == k)).cast("string")))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.size("kinds").cast("bigint").alias("n_mentions"), F.array_join(counts, ",").alias("kinds"))


def rewritten(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their places replaced, and the kind of each place."""
    for batch in rows:
        kinds, texts = [], []
        for places, text in zip(batch.column(1).to_pylist(), strings_of(batch.column(2))):
            kinds.append([p["kind"].split(":")[0] for p in places or []])
            if places and text:
                parts, at = [], 0
                for p in places:
                    parts += [text[at : p["start"]], written(p["surrogate"], text[p["start"] : p["end"]], p["kind"])]
                    at = p["end"]
                text = "".join([*parts, text[at:]])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["id", "kinds", "text"])
