from __future__ import annotations

from collections import defaultdict

import pytest

from titlekit.llm import pii
from titlekit.llm.entities import FIRST_NAMES, candidate, iban_rest, luhn, mentions, name_finder, script_of, written

KEY = b"a key for tests"
LETTER = (
    "Mr John Smith met Frau Anna Müller. Mr. Smith wrote to John.Smith@Mail.Example.org, JOHN.SMITH@MAIL.EXAMPLE.ORG or john.smith@mail.example.org; "
    "call +1 (017) 555-7713 or 017-555-7713; IBAN DE89 3704 0044 0532 0130 00, card 4929 3483 8514 6306, 078-05-1120, host 10.1.2.3; Иван Петров, г. Москва."
)


def kinds(text):
    return [(m.kind.split(":")[0], text[m.start : m.end]) for m in mentions(text, name_finder())]


def test_mentions():
    assert kinds(LETTER) == [
        ("first", "John"), ("last", "Smith"), ("first", "Anna"), ("last", "Müller"), ("last", "Smith"), ("email", "John.Smith@Mail.Example.org"),
        ("email", "JOHN.SMITH@MAIL.EXAMPLE.ORG"), ("email", "john.smith@mail.example.org"), ("phone", "+1 (017) 555-7713"), ("phone", "017-555-7713"),
        ("iban", "DE89 3704 0044 0532 0130 00"), ("card", "4929 3483 8514 6306"), ("social", "078-05-1120"), ("ip", "10.1.2.3"), ("first", "Иван"), ("last", "Петров"),
    ]


RUNNING = "Smith was late. John Smith called. Smith said John's car and Smith’s dog were SMITH-owned; blacksmith, smith, Smithson and Mr O'Neill's Dog. O'Neill left, a_Smith too."


def test_names_are_found_again(spark):
    """Bare names before and after the full one, with an owner's s, in capitals, beside a hyphen."""
    found = kinds(RUNNING)
    assert [w for _, w in found] == ["Smith", "John", "Smith", "Smith", "John", "Smith", "SMITH", "O'Neill", "O'Neill"]
    assert all(k == ("first" if w == "John" else "last") for k, w in found)
    docs = spark.createDataFrame([(1, RUNNING), (2, "Smith alone is a trade")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.surrogated(docs, KEY).collect()}
    last, first = got[1].split()[0], got[1].split()[3]
    assert got[1].startswith(f"{last} was late. {first} {last} called. {last} said {first}'s car and {last}’s dog were {last.upper()}-owned; blacksmith, smith, Smithson and Mr ")
    assert "John" not in got[1] and "Neill" not in got[1] and got[1].count("'s") == 2 and got[2] == "Smith alone is a trade"


@pytest.mark.parametrize("text", ["", "no data", "1.2.3", "999.1.1.1", "version 1.2.3.4.5", "4929348385146307", "a@b", "2020-2021 2022", "Anna Anna Anna", "The Mr", "0123456789abcdef0123456789abcdef", "token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\""])
def test_no_mentions(text):
    assert kinds(text) == []


def test_surrogates_keep_their_kind():
    card = candidate(KEY, "card:16", "4929348385146306", 0)
    assert luhn(card) and card[0] == "4" and card != "4929348385146306"
    account = candidate(KEY, "iban", "DE89370400440532013000", 0)
    assert account[:2] == "DE" and iban_rest(account) == 1 and account[4:].isdigit()
    assert candidate(KEY, "first:f:latin", "anna", 0) in [n.casefold() for n in FIRST_NAMES["f", "latin"].split()]
    assert script_of(candidate(KEY, "last:cyrillic", "петров", 0)) == "cyrillic"
    assert candidate(KEY, "ip", "10.1.2.3", 0).startswith("10.")
    one, two = (candidate(KEY, "email", f"{x}@same.example.org", 0).split("@") for x in ("a.b1", "cd"))
    assert one[1] == two[1] and len(one[0]) == 4 and one[0][1] == "." and one[0][3].isdigit()
    assert candidate(KEY, "phone:10", "0175557713", 0) != candidate(b"other", "phone:10", "0175557713", 0)
    assert written("0941112222", "+1 (017) 555-7713", "phone:10") == "+1 (094) 111-2222"
    assert written("4111222233334444", "4929-3483-8514-6306", "card:16") == "4111-2222-3333-4444"


def test_distinct_and_coreferent(spark):
    """Two digits leave few addresses: many draws meet, and all are settled."""
    rows = [("ip", f"{a}.0.0.{b}") for a in (10, 11, 224) for b in range(100)] + [("social", f"{i:09d}") for i in range(300)]
    rows += [("first:f:latin", f"name{i}") for i in range(200)] + [("email", f"{c}@x.yy") for c in "abcdefghij0123"]
    entities = spark.createDataFrame(rows + rows, "kind string, canonical string")
    got = pii.assigned(entities, KEY).collect()
    assert len(got) == len(rows) == len({(r["kind"], r["canonical"]) for r in got}) == len({(r["kind"], r["surrogate"]) for r in got})
    assert not {(r["kind"], r["surrogate"]) for r in got} & set(rows)
    again = pii.assigned(entities, KEY).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rewritten_texts(spark):
    docs = spark.createDataFrame([(1, LETTER), (2, "Reach 0.0.0.7 or JOHN.SMITH@mail.example.org"), (2, "Reach 0.0.0.7 or JOHN.SMITH@mail.example.org"), (3, "clean 漢字 text")], "doc_id bigint, text string")
    got = defaultdict(list)
    for r in pii.surrogated(docs, KEY).collect():
        got[r["doc_id"]].append(r)
    one = got[1][0]
    before, after = kinds(LETTER), [x for x in one["text"].split()]
    assert one["n_mentions"] == len(before)
    for _, value in before:
        assert value not in one["text"]
    assert after[0] == "Mr" and "Frau" in after and one["text"].endswith("г. Москва.")
    emails = [w.strip(",;").lower() for w in after if "@" in w]
    assert len(set(emails)) == 1 and emails[0] in got[2][0]["text"].lower()
    assert one["text"].split("Mr. ")[1].split()[0] == after[2]  # both mentions of the last name
    assert got[2][0] == got[2][1] and got[3][0]["text"] == "clean 漢字 text" and got[3][0]["n_mentions"] == 0


def test_odd_rows(spark, odd, nothing):
    got = pii.surrogated(odd, KEY)
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert pii.surrogated(nothing, KEY).count() == 0
