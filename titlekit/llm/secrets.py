"""Secrets in text, found through an inverted index of trigrams. Everything is DataFrame expressions.

From each rule's regular expression a Boolean query of trigrams is derived (``trigrams.demanded``): a match cannot occur
in a text that does not satisfy it. The index holds postings (trigram, text) of the trigrams that any rule asks for.
Postings are intersected by clause: a text that has all trigrams of a clause is a candidate for the clause's rule. Only
candidates are verified with the rule's expression; rules without a mandatory trigram scan every text.

Texts are known by a hash of id and text. Two texts with one hash share their postings, which can only make both
candidates: every candidate is verified. Postings are counted before each shuffle, and candidates meet the documents by a
measured broadcast or, beyond that, a salted join.

Null and empty texts have no spans. Repeated rows have the same spans each; an empty table gives an empty result; extra
columns are ignored by ``spans`` and pass through ``redacted``. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlekit.functions.binding import bound
from titlekit.llm.common import col, fresh
from titlekit.llm.trigrams import ANY, demanded
from titlekit.operators.lookup import lookup_join
from titlekit.session import materialise, spread


class Rule(NamedTuple):
    """A kind of secret: matches of ``pattern`` count if their ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules in their order, then formats of keys that their issuers have published. A run of
#: characters that is too short holds no longer one, so its least length may stand in the pattern.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
BLOCK = 256
MARK = "[secret]"


def queries(rules: tuple[Rule, ...]) -> tuple[list[str], list[tuple[int, int, list[int]]], list[int]]:
    """(trigrams, clauses as (rule, number, places of its trigrams), rules that have to scan everything)."""
    needs = [demanded(r.pattern) for r in rules]
    grams = sorted({g for q in needs if q != ANY for c in q for g in c})
    place = {g: i for i, g in enumerate(grams)}
    clauses = []
    for rule, q in enumerate(needs):
        if q != ANY:
            for c in sorted(q, key=sorted):
                clauses.append((rule, len(clauses), sorted(place[g] for g in c)))
    return grams, clauses, [i for i, q in enumerate(needs) if q == ANY]


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of texts (key, text): (gram, key) for each of the trigrams that a text has."""
    listed = F.array(*[F.struct(F.lit(i).alias("gram"), F.lit(g).alias("letters")) for i, g in enumerate(grams)])
    present = bound(lambda low: F.transform(F.filter(listed, lambda g: F.contains(low, g["letters"])), lambda g: g["gram"]), F.lower("text"))
    return texts.select("key", F.explode(present).alias("gram")).select("gram", "key")


def candidates(index: DataFrame, clauses: list[tuple[int, int, list[int]]]) -> DataFrame:
    """(key, rules): the rules whose query a text satisfies, from the postings."""
    rows = [(g, rule, number, len(own)) for rule, number, own in clauses for g in own]
    asked = index.sparkSession.createDataFrame(rows, "gram int, rule int, clause int, needed int")
    # a posting's clauses: the table is as long as the rules' queries
    met = index.join(F.broadcast(asked), "gram").groupBy("key", "rule", "clause", "needed").agg(F.count_distinct("gram").alias("n"))
    return met.where("n = needed").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def matches(text: Column, rule: Rule) -> Column:
    """(start, end) of the rule's matches, from left to right.

    What lies between matches comes from splitting at them. A start is the sum of all lengths before it; the sums are
    formed within blocks of matches and over the blocks, so many matches in one text stay cheap.
    """

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda t, x: t + x)

    def placed(steps: Column, gaps: Column, sizes: Column, measured: Column) -> Column:
        count = F.size(steps)
        blocks = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))

        def spans(before: Column) -> Column:
            def span(i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                start = F.get(before, block) + total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK)) + F.get(gaps, i)
                return F.when(F.get(measured, i) >= rule.least, F.struct(start.alias("start"), (start + F.get(sizes, i)).alias("end")))

            return F.filter(F.transform(F.sequence(F.lit(0), count - 1), span), lambda s: s.isNotNull())

        offsets = bound(lambda s: F.transform(blocks, lambda b: total(F.slice(s, F.lit(1), b))), sums)
        return bound(spans, offsets)

    def lengths(gaps: Column, found: Column, groups: Column) -> Column:
        sizes = F.transform(found, lambda x: F.length(x).cast("bigint"))
        measured = F.transform(groups, lambda x: F.length(x).cast("bigint"))
        spaces = F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda x: F.length(x).cast("bigint"))
        steps = F.zip_with(spaces, sizes, lambda a, b: a + b)
        return bound(placed, steps, spaces, sizes, measured)

    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(F.regexp_like(text, pattern), bound(lengths, F.split(text, rule.pattern, -1), found, groups)).otherwise(none)


def flagged(docs: DataFrame, key_of: list[Column], text: Column, rules: tuple[Rule, ...]) -> tuple[DataFrame, str, str]:
    """``docs`` with the rules each row is a candidate for; the names of the two columns added."""
    key, may = fresh(docs, "text_key"), fresh(docs, "may_hold")
    grams, clauses, _ = queries(rules)
    keyed = docs.withColumn(key, F.xxhash64(*key_of))
    if not clauses:
        return keyed.withColumn(may, F.array().cast("array<int>")), key, may
    index = postings(spread(keyed.select(F.col(key).alias("key"), text.alias("text"))), grams)
    found = materialise(candidates(index, clauses)).select(F.col("key").alias(key), F.col("rules").alias(may))
    return lookup_join(keyed, found, [key], "left"), key, may


def verified(text: Column, may: Column, number: int, rules: tuple[Rule, ...], scanning: list[int]) -> Column:
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = matches(text, rules[number])
    return found if number in scanning else F.when(F.array_contains(may, number), found).otherwise(none)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans): all spans of every text as (start, rule, end, kind), by start and the rules' order."""
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    joined, _, may = flagged(rows, [F.col("id"), F.col("text")], F.col("text"), rules)
    scanning = queries(rules)[2]

    def named(number: int) -> Column:
        own = verified(F.col("text"), F.col(may), number, rules, scanning)
        kind = F.lit(rules[number].kind).alias("kind")
        return F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("rule"), s["end"].alias("end"), kind))

    parts = [named(number) for number in range(len(rules))]
    return joined.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base rules' spans, a digest of them, and all spans, of every document."""
    found = spans(docs, id_col, text_col, rules)
    base = [i for i, r in enumerate(rules) if r.base]

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == number)).cast("bigint").alias(f"n_{rules[number].kind}")

    own = F.filter("spans", lambda s: s["rule"].isin(base))
    return found.select(col(id_col).alias(id_col), *[count(i) for i in base], F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: Column, rule: Rule, mark: str) -> Column:
    """The text with the rule's matches replaced; matches that do not count stay as they are."""

    def rebuilt(gaps: Column, found: Column, groups: Column) -> Column:
        after = F.zip_with(found, groups, lambda x, g: F.when(F.length(g) >= rule.least, F.lit(mark)).otherwise(x))
        return F.array_join(F.flatten(F.zip_with(gaps, F.concat(after, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")

    pattern = F.lit(rule.pattern)
    parts = bound(rebuilt, F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    return F.when(F.regexp_like(text, pattern), parts).otherwise(text)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES, mark: str = MARK) -> DataFrame:
    """All documents with all their columns, every secret replaced by ``mark``, rule after rule.

    ``length_col``, if there is such a column, is set to the new length where the text has changed.
    """
    joined, key, may = flagged(docs, [col(id_col), col(text_col)], F.coalesce(col(text_col), F.lit("")), rules)
    scanning = queries(rules)[2]
    new = fresh(joined, "masked")
    out = joined.withColumn(new, col(text_col))
    for number, rule in enumerate(rules):
        masks = masked(F.col(new), rule, mark)
        out = out.withColumn(new, masks if number in scanning else F.when(F.array_contains(F.col(may), number), masks).otherwise(F.col(new)))
    columns = {c: col(c) for c in docs.columns} | {text_col: F.col(new)}
    if length_col in docs.columns:
        size = F.length(new).cast(docs.schema[length_col].dataType)
        columns[length_col] = F.when(F.col(new) != col(text_col), size).otherwise(col(length_col))
    return out.select(*[columns[c].alias(c) for c in docs.columns])
