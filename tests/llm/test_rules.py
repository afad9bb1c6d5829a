from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from titlekit.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    covered = {p for v in places.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered), n < 20 or 100 * len(covered) > 30 * n


def slow_verdicts(rows, min_docs, share, left_words=rules.LEFT_WORDS, left_share=rules.LEFT_SHARE):
    """Rows are (id, host, text)."""
    own = []
    for _, host, text in rows:
        lines = Counter()
        for line in (text or "").split("\n"):
            if WORD.search(line):
                lines[rules.normalised(line.encode())] += len(WORD.findall(line))
        own.append((host, lines))
    hosts = Counter(h for h, _ in own)
    limit = {h: max(min_docs, share * n) for h, n in hosts.items()}
    holders = defaultdict(set)
    for h, lines in own:
        for x in lines:
            holders[h, x].add(frozenset(lines))
    out = []
    for (k, _, text), (h, lines) in zip(rows, own):
        counts = slow_counts(text)
        gone = sum(n for x, n in lines.items() if len(holders[h, x]) > limit[h])
        depleted = gone > 0 and (counts[0] - gone < left_words or counts[0] - gone < left_share * counts[0])
        out.append((k, *counts, not counts[-1] and not depleted, gone))
    return sorted(out, key=repr)


def check(spark, rows, **limits):
    table = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = sorted((tuple(r) for r in rules.verdicts(table, **limits).collect()), key=repr)
    assert got == slow_verdicts(rows, limits.get("min_docs", rules.MIN_DOCS), limits.get("share", rules.SHARE))
    return {r[0]: r for r in got}


def sentence(random, n):
    return " ".join("".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(n))


def corpus():
    r = random.Random(4)
    rows = []
    footer = "all rights reserved by the owner 2024 of this page"
    for k in range(40):  # different texts with one footer, written in several ways
        rows.append((k, "a", sentence(r, 30) + "\n" + footer.replace("2024", str(2000 + k)).title()))
    for k in range(40, 60):  # little but the footer
        rows.append((k, "a", sentence(r, 5) + "\n" + "\n".join([footer + f" {i}" for i in range(10)][:1] * 1) + "\n" + footer + "\n" + footer.upper()))
    story = [sentence(r, 12) for _ in range(6)]
    for k in range(60, 100):  # copies, some in another order, in capitals or with a line twice
        lines = story[k % 6 :] + story[: k % 6] + story[:k % 2]
        rows.append((k, "b", "\n".join(lines).upper() if k % 3 else "\n".join(lines)))
    for k in range(100, 140):  # one line in six is each document's own
        lines = [f"{x} of the template" for x in story]
        lines[k % 6] = sentence(r, 8)
        rows.append((k, "b", "\n".join(lines)))
    rows += [(200, None, sentence(r, 30)), (201, None, None), (202, "a", ""), (None, "a", sentence(r, 25)), (203, "b", "x " * 40), (203, "b", "x " * 40)]
    return rows


def test_counts_against_brute_force():
    texts = ["", "a b", "x " * 30, "a b c d e f g h\n" * 3, "é| " * 25, "\x1c a #b", "one\r\none\n one\none", "\n\n", "a" * 70000]
    r = random.Random(1)
    texts += [" ".join(r.choices("abc", k=r.randint(0, 60))) for _ in range(200)]
    got = rules.measure([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[j][i]) for j in range(5)) == slow_counts(t)[:5], t


def test_lines_of_a_host(spark):
    found = check(spark, corpus(), min_docs=5, share=0.02)
    assert all(found[k][-2] and found[k][-1] > 0 for k in range(40))  # the footer goes, the text stays
    assert not any(found[k][-2] for k in range(40, 60))  # nothing is left
    assert all(found[k][-2] and found[k][-1] == 0 for k in range(60, 100))  # copies are not boilerplate
    assert not any(found[k][-2] for k in range(100, 140))  # a template with a line of its own is


def test_other_limits(spark):
    check(spark, corpus(), min_docs=1, share=0.0)
    check(spark, corpus(), min_docs=3, share=0.6)


def test_accepted(spark):
    rows = corpus()
    table = spark.createDataFrame([(k, t, "en", h, len(t) if t else 0) for k, h, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"]: r for r in rules.accepted(table, min_docs=5).collect()}
    want = {r[0] for r in slow_verdicts(rows, 5, rules.SHARE) if r[-2]}
    assert set(kept) == want
    first = kept[0]
    assert "Rights" not in first["text"] and first["text"] == rows[0][2].split("\n")[0] and first["n_chars"] == len(first["text"])
    assert kept[60]["text"] == next(t for k, _, t in rows if k == 60)


def test_odd_rows(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "text").collect()]
    got = sorted((tuple(r) for r in rules.verdicts(odd).collect()), key=repr)
    assert got == slow_verdicts(rows, rules.MIN_DOCS, rules.SHARE)
    kept = rules.accepted(odd)
    assert kept.columns == odd.columns
    assert rules.accepted(nothing).count() == 0 and rules.verdicts(nothing).count() == 0


def test_one_limit_for_every_host(spark):
    """A footer under 30 different documents goes in a host of 30 and in one of 3,000."""
    r = random.Random(6)
    footer = "all rights reserved by the owner of this page"
    rows = [(k, "small" if k < 30 else "hot", sentence(r, 25) + ("\n" + footer if k < 60 else "")) for k in range(3030)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    gone = {r["doc_id"]: r["n_common_words"] for r in rules.verdicts(table).collect()}
    assert all(gone[k] == (9 if k < 60 else 0) for k in gone)


def test_pages_that_are_mostly_template(spark):
    """500 different pages with 60 words of template: with 20 words of their own they lose it, with 10 they go; 500 copies
    of one page are one document."""
    r = random.Random(8)
    template = "\n".join(sentence(r, 12) for _ in range(5))
    one = sentence(r, 10)
    rows = []
    for k in range(500):
        rows += [(k, "some", template + "\n" + sentence(r, 20)), (1000 + k, "thin", template + "\n" + sentence(r, 10)), (2000 + k, "copied", template + "\n" + one)]
    found = check(spark, rows)
    assert all(found[k][-2:] == (True, 60) and found[1000 + k][-2:] == (False, 60) and found[2000 + k][-2:] == (True, 0) for k in range(500))


def test_as_many_documents_as_the_limit(spark):
    """A line goes with one document above the limit, however many copies those have."""
    r = random.Random(9)
    for n, gone in ((20, 0), (21, 5)):
        texts = ["a line of five words\n" + sentence(r, 25) for _ in range(n)]
        rows = [(i * 10 + j, "h", t) for i, t in enumerate(texts) for j in range(3)]
        assert {x[-1] for x in check(spark, rows).values()} == {gone}
