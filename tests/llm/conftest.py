from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, word string, fingerprint int, id int, key int, kept string, row string, hash int, spans string, items string, ids string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, repeats, and columns whose names operators use inside."""
    long = "\n".join(f"line {i} of a long text with number {i * 7919 % 1000}" for i in range(6000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty words here"
    texts = [
        (1, base), (1, base), (2, base), (3, None), (4, ""), (5, "   \n\t "), (6, long), (None, base), (None, None),
        (7, "short"), (8, "ÉCOLE été 漢字 😀 " * 9), (9, base + "\n" + base), (10, "x" * 5000), (11, "a\x00b \x1c c"), (3, None),
    ]
    rows = []
    for i, (k, t) in enumerate(texts):
        rows.append((k, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "host", None if t is None else len(t), "fp", "word", 1, 2, 3, "kept", "row", 4, "s", "i", "x"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
