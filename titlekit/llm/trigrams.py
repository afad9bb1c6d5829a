"""Boolean trigram queries that any match of a regular expression must satisfy.

A query is in disjunctive form: a set of clauses, each a set of trigrams that all have to occur (in lower case). The
empty set of trigrams is satisfied by every text, and a query with that clause says nothing.
"""

from __future__ import annotations

import re

from re import _constants as op
from re import _parser as parser

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])
MOST_STRINGS = 64
MOST_CLAUSES = 64
SMALL_CLASS = 8


def simplest(clauses) -> Clauses:
    """Without clauses that another one makes superfluous; nothing is demanded if there are too many."""
    least = frozenset(c for c in clauses if not any(d < c for d in clauses))
    return least if len(least) <= MOST_CLAUSES else ANY


def both(a: Clauses, b: Clauses) -> Clauses:
    return simplest({x | y for x in a for y in b})


def of_strings(strings: frozenset[str]) -> Clauses:
    return simplest({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def letters(items) -> frozenset[str] | None:
    """The few characters of a class in lower case; None if there are many."""
    found = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < SMALL_CLASS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= SMALL_CLASS else None


def walk(nodes) -> tuple[frozenset[str] | None, Clauses]:
    """(all strings it can match, or None; what a match needs) of a sequence of parsed nodes."""
    run, whole, need = frozenset([""]), True, ANY
    for kind, value in nodes:
        strings, own = part(kind, value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            continue
        need = both(need, both(of_strings(run), own if strings is None else ANY))
        whole = False
        run = strings if strings is not None else frozenset([""])
    return (run if whole else None), both(need, of_strings(run))


def part(kind, value) -> tuple[frozenset[str] | None, Clauses]:
    if kind is op.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if kind is op.IN:
        return letters(value), ANY
    if kind is op.SUBPATTERN:
        return walk(value[-1])
    if kind is op.AT:
        return frozenset([""]), ANY
    if kind is op.BRANCH:
        found = [walk(branch) for branch in value[1]]
        if all(s is not None for s, _ in found):
            return frozenset().union(*(s for s, _ in found)), simplest({c for _, q in found for c in q})
        return None, simplest({c for _, q in found for c in q})
    if kind is op.MAX_REPEAT:
        low, high, inner = value
        strings, need = walk(inner)
        if strings is not None and high == 1:
            return strings | (frozenset([""]) if low == 0 else frozenset()), need if low else ANY
        if strings is not None and low and len(strings) ** low <= MOST_STRINGS and low <= 8:
            grown = frozenset([""])
            for _ in range(low):
                grown = frozenset(a + b for a in grown for b in strings)
            return (grown if low == high else None), of_strings(grown)
        return None, need if low else ANY
    return None, ANY


def demanded(pattern: str) -> Clauses:
    """The clauses of a regular expression; ``ANY`` if it has no mandatory trigram."""
    return walk(parser.parse(pattern, re.ASCII))[1]
