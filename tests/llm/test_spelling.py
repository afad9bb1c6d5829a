from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from titlekit.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def slow_counts(rows, damaged=0):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damaged and h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(n):
    forms, out = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, n[w], out[w], forms[w], n.get(forms[w]), root))
    return sorted(rows)


def held(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


def vocabulary(rng, size=150):
    words = set()
    while len(words) < size:
        base = "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(7, 10)))
        words.add(base)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(base))
            words.add(rng.choice([base[:i] + base[i + 1 :], base[:i] + rng.choice("abcdÀÿ") + base[i:], base[:i] + rng.choice("xyz") + base[i + 1 :]]))
    return {w: int(10 ** rng.uniform(0.4, 5)) for w in words if len(w) >= 7}


@pytest.mark.parametrize("part_bytes", [32, 256, 1 << 20])
def test_variants_against_all_pairs(spark, part_bytes):
    """The same in one pass and in many; parts of 32 bytes hold a single block."""
    n = vocabulary(random.Random(5), 60 if part_bytes == 32 else 150)
    n |= {"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 600, "z" * 400: 3, "z" * 401: 40, "z" * 255: 2, "z" * 256: 30, "z" * 257: 400}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert held(spelling.variants(df, part_bytes=part_bytes)) == slow_variants(n)


def test_other_letters_and_long_words(spark):
    n = {"слово": 1, "слова": 10, "漢字漢字": 3, "漢字漢": 30, "😀😀x": 1, "😀x": 10, "q" * 30000: 1, "q" * 30001: 20}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert held(spelling.variants(df)) == slow_variants(n)


def test_counts(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for damaged in (0, 3, 31):
        got = {r["word"]: r["n"] for r in spelling.word_counts(odd, damaged=damaged).collect()}
        assert got == slow_counts(rows, damaged)
    assert spelling.variants(spelling.word_counts(nothing)).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'ff416263646566676820616263646566676820' AS string) AS text")
    assert [tuple(r) for r in spelling.word_counts(broken).collect()] == [("abcdefgh", 2)]


def test_documents(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert held(spelling.variants(spelling.word_counts(odd, damaged=3))) == slow_variants(slow_counts(rows, 3))
    with pytest.raises(ValueError):
        spelling.variants(spelling.word_counts(odd), ratio=1)


def test_few_false_positives(spark):
    """Almost all candidates that are shuffled are words."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(20000)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    layout = spelling.Layout({9: len(words)})
    from titlekit.llm.spelling import candidates, filters

    import numpy as np

    rows = filters(df, layout).collect()
    table = np.zeros((layout.total, 4), dtype=np.uint64)
    for r in rows:
        table[r["block"]] = np.array([r[f"w{k}"] for k in range(4)], dtype=np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(table)
    edits = 9 * 15 * len(words)
    assert candidates(df, layout, sent, 0, sorted(map(ord, "abcdefghijklmnop"))).count() < 0.002 * edits
