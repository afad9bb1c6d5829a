from __future__ import annotations

import hashlib
import random
import re

from titlekit.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(docs, items, width=10):
    windows = {}
    for name, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + width]), set()).add(name)
    out = []
    for k, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        listed = sorted(x for x in found if x is not None)
        out.append((k, len(words), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def check(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id string, text string")
    got = [tuple(r)[:6] for r in decontaminate.contamination(d, i, **options).collect()]
    assert sorted(got, key=repr) == slow(docs, items, options.get("width", 10))


def texts():
    random.seed(11)
    vocabulary = ["ab", "Ba", "é", "c1", "the", "x"]
    items = [(str(i), " ".join(random.choices(vocabulary, k=random.choice([1, 2, 3, 5, 9, 10, 11, 14, 25])))) for i in range(40)]
    items += [("7", "other words for seven"), (None, "a nameless item of ten words or a little more than that"), ("e", ""), ("n", None)]
    docs = [(1, None), (2, ""), (2, ""), (3, "...!"), (4, "  the  "), (5, "A NAMELESS item-of ten words, or a little more than that!")]
    for k in range(60):
        words = random.choices(vocabulary, k=random.randint(0, 400))
        if k % 3 == 0:
            words[5:5] = (random.choice(items)[1] or "").split()
        docs.append((k, random.choice([" ", ", ", "\n", "--"]).join(words)))
    return docs, items


def test_against_brute_force(spark):
    check(spark, *texts())


def test_several_tables(spark):
    check(spark, *texts(), table_windows=7)


def test_other_widths(spark):
    check(spark, *texts(), width=1)
    check(spark, *texts(), width=3)


def test_no_items_and_no_documents(spark, nothing):
    check(spark, [(1, "some words")], [])
    items = spark.createDataFrame([("1", "some words")], "item_id string, text string")
    assert decontaminate.contamination(nothing, items).count() == 0


def test_odd_rows_pass_with_their_columns(spark, odd, nothing):
    items = spark.createDataFrame([("1", "eleven twelve thirteen")], "item_id string, text string")
    kept = decontaminate.decontaminated(odd, items)
    assert kept.schema.names == odd.schema.names
    want = odd.where("text IS NULL OR text NOT LIKE '%eleven twelve thirteen%'")
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
    assert decontaminate.decontaminated(nothing, items).count() == 0


def test_shift_table_skips(monkeypatch):
    """A text that shares no block with the windows is looked at once in nine words."""
    names, tables = decontaminate.tables_of([("1", b" ".join(b"w%d" % i for i in range(30)))], 10)
    words = decontaminate.Words([b" ".join(b"z%d" % i for i in range(9000))], decontaminate.ALNUM)
    codes = words.codes()
    looked = []
    monkeypatch.setattr(decontaminate, "block", lambda a, b, real=decontaminate.block: looked.append(len(a)) or real(a, b))
    assert len(tables[0].ends(codes, words.first)) <= 20
    assert sum(looked) < 9000 / 7
