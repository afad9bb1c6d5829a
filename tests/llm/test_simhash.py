from __future__ import annotations

import random
from collections import defaultdict

import xxhash

from titlekit.llm import components, simhash


def slow_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    codes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for x in parent:
        out[find(x)].add(x)
    return sorted(map(sorted, out.values()))


def smallest_reachable(ids, prints):
    """The smallest id over all paths of links of at most two bits, by comparing all pairs."""
    different = sorted(set(prints))
    linked = groups([(p, q) for p in different for q in different if bin(p ^ q).count("1") <= 2])
    return {f"{p:016x}": min((i for i, q in zip(ids, prints) if q in own and i is not None), default=None) for own in map(set, linked) for p in own}


def test_component_ids_over_chains(spark):
    """Texts made so that their fingerprints chain: each near copy differs from the one before in a few words."""
    random.seed(11)
    words = [f"word{i}" for i in range(120)]
    texts = []
    for chain in range(6):
        own = random.sample(words, 90)
        for _ in range(8):
            texts.append(" ".join(own))
            own[random.randrange(90)] = random.choice(words)
    ids = list(range(len(texts)))
    random.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    prints = [slow_fingerprint(t) for t in texts]
    got = {r["fingerprint"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == smallest_reachable(ids, prints) and 6 <= len(set(got.values())) < len(set(prints))


def test_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    rows = odd.select("doc_id", "text").collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    assert {r["fingerprint"]: r["component_id"] for r in got} == smallest_reachable([r["doc_id"] for r in rows], prints)
    want = sorted((str(r["doc_id"]), f"{p:016x}") for r, p in zip(rows, prints))
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == want


def test_links_against_all_pairs(spark):
    random.seed(3)
    prints = set()
    for _ in range(60):
        base = random.getrandbits(64)
        prints.add(base)
        for _ in range(random.randint(0, 12)):
            x = base
            for _ in range(random.randint(1, 4)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    prints |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2, 1 << 63, 1 << 63 | 1 << 62}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    fps = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    links = [(r["a"], r["b"]) for r in simhash.links(fps).collect()]
    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    want = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert groups(links) == groups(want)
    found = defaultdict(set)
    for r in components.components(simhash.links(fps)).collect():
        found[r["root"]].add(r["node"])
    assert sorted(map(sorted, found.values())) == groups(want)


def test_many_near_copies_make_few_links(spark):
    """All 2,080 neighbours at up to two bits: links in proportion to them, not to their pairs."""
    near = {0} | {1 << a | 1 << b for a in range(64) for b in range(64)}
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in near], "fp bigint")
    assert simhash.links(fps).count() < 70 * len(near)
    roots = {r["root"] for r in components.components(simhash.links(fps)).collect()}
    assert len(roots) == 1


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (1001, 1000), (5, 5)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert len({found[i] for i in range(501)}) == 1 and found[1000] == found[1001] != found[0] and len(found) == 503


def test_keep_one(spark, odd, nothing):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    components_left = {r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted(components_left) and len(ids) == len(set(ids))
    assert simhash.keep_one(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def test_component_without_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "quite another text here")], "doc_id bigint, text string")
    got = sorted(str(r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert got == ["2", "None", "None"]
    assert simhash.keep_one(rows).count() == 2
