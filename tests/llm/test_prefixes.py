from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from titlekit.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, x string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows, hashes, branch):
    """Turns of every conversation in order, by the contract; ties by role, then by the hashes Spark gives."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "").encode(), *hashes[role or "", text or ""], (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts, key=lambda t: t[:-1])] for c, ts in own.items()}
    if not branch:
        return own
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves, saved = (0, 0) if children[node] else (1, 0)
        saved += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for child in children[node]:
            leaves, saved = leaves + sums[child][0], saved + sums[child][1]
        sums[node] = (leaves, saved)
    out = []
    for node, cs in members.items():
        ended = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), *sums[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def held(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def hashes_of(df):
    role, text = F.coalesce("role", F.lit("")).cast("binary"), F.coalesce("text", F.lit("")).cast("binary")
    rows = df.select(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("second"), role, text).alias("y"))
    return {(r["r"], r["t"]): (r["x"], r["y"]) for r in rows.collect()}


def talk(rng, convs=60, turns=9):
    rows = []
    for c in range(-7, convs):
        for t in range(rng.randrange(0, turns)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é漢", "", None])))
    return rows


@pytest.mark.parametrize("branch", [False, True])
@pytest.mark.parametrize("height", [1, 2, 3, None])
def test_against_brute_force(spark, branch, height):
    rows = talk(random.Random(height or 0))
    rows += rows[:9] + [(None, 1, "user", "x"), (10**9, 1, "user", "a"), (10**9, 1, "user", "a")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    want = brute(rebuilt(rows, hashes_of(df), branch))
    assert held(prefixes.conversation_trie(df, branch, height)) == want


def test_one_long_and_many_equal_conversations(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(300)]
    rows += [(c, t, "user", f"turn {t}") for c in range(2, 200) for t in range(3)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    want = brute(rebuilt(rows, hashes_of(df), False))
    for height in (7, None):
        assert held(prefixes.conversation_trie(df, False, height)) == want


def test_pieces_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS_AT_ONCE", 3)
    rows = [(c, 1, "user", "same") for c in range(100)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert held(prefixes.conversation_trie(df)) == brute(rebuilt(rows, hashes_of(df), False))


def test_odd_values(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefixes.conversation_trie(none, True).count() == 0
    rows = spark.sql("SELECT 1L AS conv_id, 1L AS turn, 'user' AS role, cast(X'ff4162' AS string) AS text UNION ALL SELECT 2L, 1L, 'user', repeat('long ', 200000)")
    got = held(prefixes.conversation_trie(rows))
    assert [r[:4] for r in got] == [(1, 0, None, 2), (1, 1, 1, 1), (2, 1, 1, 1)]


def test_turnless_conversations_are_members_of_the_root(spark):
    """A conversation that lends nothing and has no more turns than it drops."""
    short = [c for c in range(200) if zlib.crc32(str(c).encode()) % 9 >= 1 and c % 5]
    rows = [(c, 0, "user", "x") for c in short]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = held(prefixes.conversation_trie(df, True))
    assert got == brute(rebuilt(rows, hashes_of(df), True)) and len(got) == 1 and got[0][3] == len(short)
