"""Personal entities in a text, and candidates for what may stand in their place.

An entity is a class and a canonical form, the same for every way of writing it: an address in lower case, the digits of
a number, a name's word in lower case. A mention is where it stands and how it is written there. A candidate is drawn from
a keyed hash of class, canonical form and attempt; it keeps the class, and with it script, gender, length and check digits.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from typing import NamedTuple

import ahocorasick

#: Titles by gender, and first names by gender and script from which surrogates are drawn.
TITLES = {
    "m": "Mr Herr Señor Sr Monsieur Signor господин",
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle Signora госпожа",
    "n": "Dr Prof Doctor Professor доктор профессор",
}
FIRST_NAMES = {
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Hans Klaus Jürgen Stefan Pierre Michel Jean Luc Carlos José Luis Miguel Antonio Giovanni",
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Nancy Anna Helga Ursula Monika Sabine Marie Sophie Camille Claire Isabelle María Carmen Lucía Elena Giulia Francesca",
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Николай Михаил Андрей Владимир Павел Юрий",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила",
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Βασιλική Αικατερίνη",
}
#: Vowels and consonants of each script, and how made-up names of a gender end.
LETTERS = {
    "latin": ("aeiou", "bcdfghjklmnprstvwz"),
    "cyrillic": ("аеиоу", "бвгдзклмнпрстфх"),
    "greek": ("αειου", "βγδθκλμνπρστφχ"),
}
ENDINGS = {("m", "latin"): "o", ("f", "latin"): "a", ("m", "cyrillic"): "р", ("f", "cyrillic"): "а", ("m", "greek"): "ος", ("f", "greek"): "α"}
LISTED_ATTEMPTS = 6
LOOSE_ATTEMPTS = 12

EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)")
PHONE = re.compile(r"(?<![\w.])(?:\+(\d{1,3})[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)")
SOCIAL = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
ADDRESS = re.compile(r"(?<![\w.-])(?:\d{1,3}\.){3}\d{1,3}(?![\w-]|\.\d)")
DIGIT = re.compile(r"[0-9]")
NAME_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
NAME_PART = re.compile(r"[^\W\d_]+")
OWNED = re.compile(r"['’][sS]\Z")


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    canonical: str


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def script_of(word: str) -> str | None:
    name = unicodedata.name(word[0], "").split(" ")[0].lower()
    return name if name in LETTERS else None


def name_finder() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for gender, titles in TITLES.items():
        for t in titles.split():
            found.add_word(t, (t, "title", gender))
    for (gender, _), names in FIRST_NAMES.items():
        for n in names.split():
            found.add_word(n, (n, "first", gender))
    found.make_automaton()
    return found


def names_again(text: str, names: list[Mention]) -> list[Mention]:
    """Where else the words of ``names`` stand: alone, with an owner's s, in capitals, or beside a hyphen."""
    kinds: dict[str, str] = {}
    for m in names:
        kinds.setdefault(m.canonical, m.kind)
    there = {m.start for m in names}
    out = []
    for whole in NAME_WORD.finditer(text) if kinds else ():
        start, end = whole.span()
        if not text[start].isupper() and not any(map(str.isupper, whole[0])) or start and (text[start - 1].isalnum() or text[start - 1] == "_") or end < len(text) and (text[end].isalnum() or text[end] == "_"):
            continue
        word = OWNED.sub("", whole[0])
        found = [(start, word)] if word.casefold() in kinds else [(start + p.start(), p[0]) for p in NAME_PART.finditer(word)]
        for at, w in found:
            kind = kinds.get(w.casefold())
            if kind and w[0].isupper() and at not in there:
                out.append(Mention(at, at + len(w), kind, w.casefold()))
    return out


def names_in(text: str, finder: ahocorasick.Automaton) -> list[Mention]:
    """Names after a title, or of a known first name and a capitalised word after it; and their words elsewhere."""
    out, done = [], 0
    n = len(text)
    for last, (word, kind, gender) in finder.iter(text):
        start, at = last - len(word) + 1, last + 1
        if start < done or start and (text[start - 1].isalnum() or text[start - 1] in "_'’-") or at < n and (text[at].isalnum() or text[at] in "_'’-"):
            continue
        words = []
        if kind == "first":
            words.append((start, at, word))
        elif at < n and text[at] == ".":
            at += 1
        while len(words) < 3 and at < n and text[at] == " ":
            m = NAME_WORD.match(text, at + 1)
            if not m or not m[0][0].isupper() or len(m[0]) < 2 or m[0].isupper() or script_of(m[0]) is None:
                break
            name = OWNED.sub("", m[0])
            words.append((m.start(), m.start() + len(name), name))
            at = m.end()
            if name != m[0]:
                break
        # a first name needs another name after it; one that only repeats itself is no name
        if not words or kind == "first" and (len(words) < 2 or len({w for _, _, w in words}) < len(words)):
            continue
        done = words[-1][1]
        known = {x.casefold(): g for (g, _), names in FIRST_NAMES.items() for x in names.split()} if gender == "n" else {}
        for k, (a, b, w) in enumerate(words):
            script = script_of(w)
            if k < len(words) - 1:
                sex = known.get(w.casefold(), "m") if gender == "n" else gender
                out.append(Mention(a, b, f"first:{sex}:{script}", w.casefold()))
            else:
                out.append(Mention(a, b, f"last:{script}", w.casefold()))
    return out + names_again(text, out)


def mentions(text: str, finder: ahocorasick.Automaton) -> list[Mention]:
    """Mentions from left to right; of two that overlap, the one of the class named first below."""
    found: list[Mention] = []
    if "@" in text:
        found += [Mention(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and iban_rest(plain) == 1:
                found.append(Mention(m.start(), m.end(), "iban", plain))
        for m in CARD.finditer(text):
            plain = re.sub(r"\D", "", m[0])
            if luhn(plain) and len(set(plain)) > 1:
                found.append(Mention(m.start(), m.end(), f"card:{len(plain)}", plain))
        for m in PHONE.finditer(text):
            code = m[1] or ""
            plain = re.sub(r"\D", "", m[0])[len(code) :]
            if 7 <= len(plain) <= 12:
                found.append(Mention(m.start(), m.end(), f"phone:{len(plain)}", plain))
        found += [Mention(m.start(), m.end(), "social", m[0].replace("-", "")) for m in SOCIAL.finditer(text)]
        for m in ADDRESS.finditer(text):
            parts = [int(p) for p in m[0].split(".")]
            if max(parts) < 256:
                found.append(Mention(m.start(), m.end(), "ip", ".".join(map(str, parts))))
    found += names_in(text, finder)
    kept: list[Mention] = []
    rank = {id(m): i for i, m in enumerate(found)}
    for m in sorted(found, key=lambda m: (m.start, rank[id(m)])):
        if kept and m.start < kept[-1].end:
            if rank[id(m)] < rank[id(kept[-1])]:
                kept[-1] = m
        else:
            kept.append(m)
    return kept


class Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str):
        self.seed = hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest()
        self.left = b""
        self.count = 0

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left += hashlib.sha256(self.seed + self.count.to_bytes(4, "big")).digest()
            self.count += 1
        value, self.left = self.left[:8], self.left[8:]
        return int.from_bytes(value, "big") % n

    def like(self, c: str) -> str:
        """A digit for a digit; a vowel for a vowel and a consonant for a consonant of the same script and case."""
        if c.isdigit():
            return str(self.below(10))
        if not c.isalpha():
            return c
        vowels, consonants = LETTERS[script_of(c) or "latin"]
        base = unicodedata.normalize("NFD", c.lower())[0]
        pool = vowels if base in vowels else consonants
        new = pool[self.below(len(pool))]
        return new.upper() if c.isupper() else new


def candidate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """What may stand for an entity, in canonical form; each attempt gives another."""
    stream = Stream(key, kind, canonical, str(attempt))
    name = kind.split(":")[0]
    if name == "email":
        local, _, domain = canonical.rpartition("@")
        labels, dot, top = domain.rpartition(".")
        host = Stream(key, "domain", domain)  # a domain keeps one surrogate wherever it occurs
        longer = "".join(stream.like("a") for _ in range(max(0, attempt - LOOSE_ATTEMPTS)))
        return "".join(map(stream.like, local)) + longer + "@" + "".join(map(host.like, labels)) + dot + top
    if name == "card":
        body = canonical[0] + "".join(map(stream.like, canonical[1:-1]))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if name == "iban":
        body = "".join(map(stream.like, canonical[4:]))
        rest = iban_rest(canonical[:2] + "00" + body)
        return f"{canonical[:2]}{98 - rest:02d}{body}"
    if name == "ip":
        # private, loopback and group addresses stay in their own kind of network
        first = int(canonical.split(".")[0]) if attempt <= LOOSE_ATTEMPTS else 1  # a full network lends from the public ones
        kept = str(first) if first in (0, 10, 127) or first >= 224 else str(next(x for x in iter(lambda: 11 + stream.below(212), None) if x != 127))
        return ".".join([kept, *(str(stream.below(256)) for _ in range(3))])
    if name in ("phone", "social"):
        lead = str(2 + stream.below(8)) if canonical[0] != "0" else "0"
        longer = "".join(stream.like("0") for _ in range(max(0, attempt - LOOSE_ATTEMPTS)))
        return lead + "".join(map(stream.like, canonical[1:])) + longer
    parts = kind.split(":")
    if name == "first":
        gender, script = parts[1], parts[2]
        listed = FIRST_NAMES[gender, script].split()
        if attempt < LISTED_ATTEMPTS:
            return listed[stream.below(len(listed))].casefold()
        end = ENDINGS[gender, script]
    else:
        script, end = parts[1], ""
    vowels, consonants = LETTERS[script]
    size = 2 + stream.below(2) + max(0, attempt - LOOSE_ATTEMPTS)
    made = "".join(consonants[stream.below(len(consonants))] + vowels[stream.below(len(vowels))] for _ in range(size))
    if end:
        return (made[:-1] + end).casefold()
    return (made + consonants[stream.below(len(consonants))]).casefold()


def written(surrogate: str, mention: str, kind: str) -> str:
    """The surrogate in the mention's way of writing."""
    name = kind.split(":")[0]
    if name in ("card", "social", "phone", "iban"):
        skipped = 0
        if name == "phone" and mention.startswith("+"):
            skipped = max(0, sum(c.isdigit() for c in mention) - len(surrogate))
        rest, out = iter(surrogate), []
        for c in mention:
            if not c.isalnum() or skipped:
                skipped -= bool(skipped and c.isalnum())
                out.append(c)
            else:
                out.append(next(rest))
        return "".join([*out, *rest])
    if name == "email":
        if mention.isupper():
            return surrogate.upper()
        if len(surrogate) == len(mention):
            return "".join(s.upper() if c.isupper() else s for s, c in zip(surrogate, mention))
        return surrogate
    if name == "ip":
        return surrogate
    return surrogate.upper() if mention.isupper() else surrogate[:1].upper() + surrogate[1:]
