"""One query for each operator on whole tables, with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlekit.llm import bpe, decontaminate, extract, langid, pii, prefixes, quality, rules, secrets, sharding, simhash, spelling, toxicity
from titlekit.llm.common import table

#: The key of this query's surrogates; a user of the operator gives a secret one.
PII_KEY = b"surrogates of the query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def tokenizer_file() -> str:
    """The vocabulary on this machine; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_quality_line_field(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by the field over its lines."""
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op2_toxicity_machine(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by the factorization machine."""
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op4_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


OP6_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
starts AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[s:s + 9], ' ') AS win FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM lowered, lengths WHERE len(ws) >= n),
strings AS (SELECT rid, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win FROM places),
met AS (SELECT rid, s, n, item FROM strings JOIN windows USING (n, win)),
covered AS (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM met)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM covered GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM met GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hits USING (rid) LEFT JOIN found USING (rid)
"""


@query(OP6_SQL)
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("items")


def secrets_sql(kinds: tuple[secrets.Rule, ...]) -> str:
    """Spans by splitting each text at the rules' matches."""
    parts = []
    for n, rule in enumerate(kinds):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""
  SELECT rid, {n} AS rule, '{rule.kind}' AS kind, start, start + length(found[i]) AS "end" FROM (
    SELECT rid, found, groups, i,
           list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT rid, string_split_regex(body, {pattern}) AS gaps, regexp_extract_all(body, {pattern}) AS found,
             regexp_extract_all(body, {pattern}, {rule.group}) AS groups FROM texts)))
  WHERE length(groups[i]) >= {rule.least}""")
    base = [n for n, r in enumerate(kinds) if r.base]
    counts = ", ".join(f"count(*) FILTER (rule = {n}) AS n_{kinds[n].kind}" for n in base)
    own = f"rule IN ({', '.join(map(str, base))})"
    spelled = "kind || ':' || start::BIGINT || ':' || \"end\"::BIGINT"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
listed AS (
  SELECT rid, {counts},
         coalesce(string_agg({spelled}, ',' ORDER BY start, rule) FILTER ({own}), '') AS base,
         string_agg({spelled}, ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kinds[n].kind}, 0)::BIGINT AS n_{kinds[n].kind}" for n in base)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (rid)
"""


@query(secrets_sql(secrets.RULES))
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.report(table(spark, folder, "documents"))


@query()
def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, and what decoding them gives back."""
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer_file())


OP10_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS body FROM documents),
worded AS (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws FROM docs),
starts AS (SELECT rid, ws, unnest(range(1, len(ws) - {rules.WINDOW} + 2)) AS s FROM worded WHERE len(ws) >= {rules.WINDOW}),
windows AS (SELECT rid, s, count(*) OVER (PARTITION BY rid, array_to_string(ws[s:s + {rules.WINDOW - 1}], ' ')) AS n FROM starts),
repeats AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(s, s + {rules.WINDOW})) AS p FROM windows WHERE n > 1) GROUP BY rid),
pieces AS (SELECT rid, host, unnest(string_split(body, chr(10))) AS line FROM docs),
lines AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM pieces WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
copies AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
plain AS (SELECT rid, host, n, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare,
                 regexp_replace(trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), '[0-9]', '0', 'g') AS norm FROM lines),
own AS (SELECT rid, host, CASE WHEN norm = '' THEN bare ELSE norm END AS norm, sum(n) AS n FROM plain GROUP BY ALL),
hosts AS (SELECT host, greatest({rules.MIN_DOCS}, {rules.SHARE} * count(*)) AS most FROM docs GROUP BY host),
sets AS (SELECT rid, md5(string_agg(norm, chr(10) ORDER BY norm)) AS lines FROM own GROUP BY rid),
common AS (
  SELECT o.host, norm FROM own o JOIN sets USING (rid) JOIN hosts h ON o.host IS NOT DISTINCT FROM h.host
  GROUP BY o.host, norm HAVING count(DISTINCT lines) > any_value(most)),
gone AS (
  SELECT rid, sum(n) AS gone FROM own m JOIN common c ON m.host IS NOT DISTINCT FROM c.host AND m.norm = c.norm GROUP BY rid),
measured AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(gone, 0)::BIGINT AS n_common_words
  FROM docs JOIN worded USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN copies USING (rid) LEFT JOIN gone USING (rid)),
failed AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEATED_PERCENT} * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND NOT (n_common_words > 0 AND (n_words - n_common_words < {rules.LEFT_WORDS}
       OR n_words - n_common_words < {rules.LEFT_SHARE} * n_words)) AS kept
FROM failed
"""


@query(OP10_SQL)
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document and the verdict on it."""
    return rules.verdicts(table(spark, folder, "documents"))


@query()
def op5_language_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by its nearest centroid."""
    return langid.predicted(table(spark, folder, "documents"))


@query()
def op8_html_content_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract.extracted(table(spark, folder, "pages"))


@query()
def op3_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with personal data replaced by surrogates."""
    return pii.surrogated(table(spark, folder, "documents"), PII_KEY)


#: A CTE with the table of CRC-32, and the checksum of a text's UTF-8 bytes by it.
CRC_TABLE = """crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"""


def crc_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex({text}), '..'),
    lambda z: ('0x' || z)::BIGINT)), lambda c, z: xor(c >> 8, crc_table[xor(c & 255, z) + 1])))"""


OP11_SQL = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS n, c - c % {prefixes.FAMILY} AS base FROM turns GROUP BY c),
shared AS (SELECT convs.*, {crc_sql("c::VARCHAR")} % {prefixes.MOST_SHARED} AS h FROM convs, crcs),
lent AS (SELECT s.*, least(h, coalesce(b.n, 0)) AS lent FROM shared s LEFT JOIN convs b ON b.c = s.base),
rebuilt AS (
  SELECT l.c, p AS depth, role, body FROM lent l JOIN turns t ON t.c = l.base AND p <= lent
  UNION ALL SELECT l.c, lent + p - h, role, body FROM lent l JOIN turns t ON t.c = l.c AND p > h),
paths AS (
  SELECT c, depth, string_agg(md5(length(role) || ':' || role || body), '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth) AS node,
         strlen(body) AS bytes, depth = max(depth) OVER (PARTITION BY c) AS ended FROM rebuilt
  UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM rebuilt) FROM convs),
nodes AS (
  SELECT node, any_value(depth) AS depth, min(c) AS c, count(*) AS n_convs, any_value(bytes) AS bytes, bool_and(ended) AS leaf,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256
  FROM paths GROUP BY node),
sums AS (
  SELECT p.node, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * n.bytes) AS saved
  FROM nodes n JOIN paths p ON p.c = n.c AND p.depth <= n.depth GROUP BY p.node),
ups AS (SELECT *, CASE WHEN depth > 0 THEN node[:(depth - 1) * 32] END AS up FROM nodes),
children AS (SELECT up, count(*) AS n FROM ups GROUP BY up)
SELECT n.c AS conv_id, n.depth::BIGINT AS depth, u.c AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM ups n JOIN sums s ON s.node = n.node LEFT JOIN nodes u ON u.node = n.up LEFT JOIN children k ON k.up = n.node
"""


@query(OP11_SQL)
def op11_conversation_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, with sums over its subtree."""
    return prefixes.conversation_trie(table(spark, folder, "conversations"), branch=True)


#: Runs whose checksum this divides lose a character.
DAMAGED = 31

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[{spelling.LETTERS}]{{{spelling.LEAST_CHARS},}}')) AS run
  FROM documents),
hashed AS (SELECT run, {crc_sql("id || ':' || run")} AS h FROM runs, crcs),
words AS (
  SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, count(*) AS n
  FROM hashed GROUP BY word HAVING length(word) >= {spelling.LEAST_CHARS} AND count(*) >= {spelling.LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
shorter AS (SELECT DISTINCT p.word AS a, w.word AS b FROM places p JOIN words w ON w.word = left(p.word, i) || substring(p.word, i + 2)),
masked AS (SELECT word, left(word, i) || '*' || substring(word, i + 2) AS pattern FROM places),
pairs AS (
  SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
  UNION ALL SELECT x.word, y.word FROM masked x JOIN masked y ON x.pattern = y.pattern AND x.word <> y.word),
ranked AS (
  SELECT a AS word, b AS near, w.n AS near_n, count(*) OVER (PARTITION BY a) AS n_near,
         row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS place
  FROM pairs JOIN words w ON w.word = b),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {spelling.RATIO} * w.n THEN r.near END AS form,
         CASE WHEN r.near_n >= {spelling.RATIO} * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
walk AS (
  SELECT word, word AS reached FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = reached WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, reached FROM walk JOIN formed f ON f.word = reached WHERE f.form IS NULL)
SELECT word, n::BIGINT AS n, n_near::BIGINT AS n_near, form, form_n::BIGINT AS form_n, reached AS root FROM formed JOIN ends USING (word)
"""


@query(OP12_SQL)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the documents, the near word that each is a variant of, and the last such word."""
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), damaged=DAMAGED))


SHARDS = 24
SHUFFLE_KEY = 20_240_229


def permutation_sql(key: int) -> str:
    """The network once over x, with a and b in scope, two rounds a step."""
    keys = sharding.round_keys(key)
    steps = ", ".join(f"[{f}, {s}, {g}, {t}]" for (f, s), (g, t) in zip(keys[::2], keys[1::2]))

    def mixed(x: str, factor: str, summand: str) -> str:
        y = f"(({x} % {sharding.PRIME} * {factor} + {summand}) % {sharding.PRIME})"
        return f"(({y} * {y} + {factor}) % {sharding.PRIME})"

    left = f"((z[1] + {mixed('z[2]', 'k[1]', 'k[2]')}) % a)"
    right = f"((z[2] + {mixed(left, 'k[3]', 'k[4]')}) % b)"
    return f"list_reduce(list_prepend([x % a, x // a, 0, 0], [{steps}]::BIGINT[][]), lambda z, k: [{left}, {right}, 0, 0])"


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
measured AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + {sharding.OVERHEAD})::BIGINT AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crcs),
rows AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS r FROM measured),
halves AS (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM rows),
sides AS (SELECT n, a, (n + a - 1) // a AS b FROM halves),
walk AS (
  SELECT r, n, a, b, {permutation_sql(SHUFFLE_KEY)} AS z FROM (SELECT r, r AS x, n, a, b FROM rows, sides)
  UNION ALL
  SELECT r, n, a, b, {permutation_sql(SHUFFLE_KEY)} FROM (SELECT r, z[2] * a + z[1] AS x, n, a, b FROM walk WHERE z[2] * a + z[1] >= n)),
placed AS (SELECT r, z[2] * a + z[1] AS place FROM walk WHERE z[2] * a + z[1] < n)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place % {SHARDS})::INTEGER AS shard, (place // {SHARDS})::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM rows JOIN placed USING (r)
"""


@query(OP13_SQL)
def op13_shuffled_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document; shards have equal counts of rows."""
    found = sharding.assigned(table(spark, folder, "documents"), SHARDS, SHUFFLE_KEY)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
