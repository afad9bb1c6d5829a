from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from titlekit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = list("abcdefghij ttheennzz  \n\t'’s've éßñ漢字😀0123456789\x1c\x85​ ") + ["<|endoftext|>", "the", " and", "ing", "   ", "'ll", "́", "\x00", "Ⅷ", "²", "aaaaaaaa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokens():
    return bpe.Tokens(bpe.vocabulary(PATH))


def ids(tokens, text):
    return np.frombuffer(b"".join(tokens.encode(text)), dtype="<u4").tolist()


def test_like_the_library(tokens, library):
    random.seed(2)
    for _ in range(3000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(tokens, text) == want, repr(text)
        assert tokens.decode(np.array(want)).decode() == library.decode(want, skip_special_tokens=False)


def test_long_pieces_and_texts(tokens, library):
    random.seed(5)
    for text in ("a" * 20000, "ab" * 9000 + " " * 500, "".join(random.choice("abcdefgh") for _ in range(30000)), ("Some words, 12 of them. " * 60000)):
        assert ids(tokens, text) == library.encode(text, add_special_tokens=False).ids


def test_pairs_that_fit(tokens, library):
    random.seed(6)
    known = {v: k for k, v in tokens.bytes.items()}
    for _ in range(3000):
        a, b = random.randrange(2000), random.randrange(2000)
        both = tokens.bytes[a] + tokens.bytes[b]
        assert tokens.fits(a, b) == (merged(tokens, known, both) == [a, b])


def merged(tokens, known, raw: bytes) -> list[int]:
    """Byte-pair merges, one by one."""
    parts = [known[raw[i : i + 1]] for i in range(len(raw))]
    while True:
        ranks = [(tokens.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not ranks or min(ranks)[0] == 1 << 30:
            return parts
        rank, i = min(ranks)
        parts[i : i + 2] = [known[tokens.bytes[parts[i]] + tokens.bytes[parts[i + 1]]]]


def test_tables(spark, odd, nothing, library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(odd, PATH).collect()}
    want = set()
    for r in odd.collect():
        own = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(own), hashlib.sha256(np.array(own, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    back = bpe.decoded(bpe.encoded(odd, PATH), PATH)
    assert sorted(str(r["text"]) for r in back.collect()) == sorted(str(r["text"] or "") for r in odd.collect())
    assert bpe.round_trip(nothing, PATH).count() == 0 and bpe.encoded(nothing, PATH).count() == 0


def test_undecodable_ids(spark):
    rows = spark.createDataFrame([(1, [99999, 128]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decoded(rows, PATH).collect()}[3] == ""


def test_small_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    small = bpe.Tokens(bpe.vocabulary(PATH))
    text = "the cat and the dog and the bird saw the cat"
    assert ids(small, text) == library.encode(text, add_special_tokens=False).ids
