"""A page as a tree of blocks: which blocks there are, what text stands in each, and what can be measured of it.

The reader follows the main rules of HTML for tags, comments, raw text and elements that close each other, in one pass
and in linear time. Inline elements belong to the block around them; a part of the page that is cut off inside a tag, a
comment, a script or a style is no text.
"""

from __future__ import annotations

import html
import re

import numpy as np

#: Elements by the role they play in reading a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split()) | frozenset(
    "math semantics annotation mrow mi mo mn ms mtext mspace mstyle mpadded mphantom menclose merror mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that show no text; one without an end tag hides nothing else.
HIDDEN = frozenset("svg template".split())
HEAD = frozenset("head meta link base title script style noscript template".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: Elements that end when a like one starts, and the element that shelters those outside it.
SAME_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dd dt", "table tbody thead tr td th", "blockquote pre", "figure figcaption", "button select label fieldset input option legend", "noscript", "html body")
TAG_PLACE = {t: i for i, group in enumerate(TAGS) for t in group.split()}
#: Words in class, id and role that tell what a block is for.
HINTS = (r"nav|menu|breadcrumb|pager|pagination|\btoc\b|tabs", r"foot|copyright|legal", r"header|masthead|topbar|banner|logo", r"side|aside|widget|related|recommend|popular|trending|rail|more-", r"\bads?\b|advert|sponsor|promo|dfp|adsense|\bad[-_]|[-_]ad\b", r"cookie|consent|gdpr|notice|alert|modal|popup|newsletter|subscri|signup|paywall|disclaimer", r"share|social|follow", r"comment|disqus|respond|repl(?:y|ies)|discussion|reader", r"form|search|login|contact", r"article|content|post|entry|story|main|prose|\bbody\b|\btext\b")
HINT = [re.compile(h) for h in HINTS]
FURNITURE = frozenset("nav footer aside form button select".split())
FURNITURE_HINTS = (1 << 9) - 1  # all but the last
MEASURES = 12

ATTRIBUTES = r"(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?=[^\"'\s])|$))*+"
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)(" + ATTRIBUTES + ")>")
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|data-label)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: What may end a drawing: its end tag, a block outside a part that holds blocks, or another drawing within.
IN_DRAWING = re.compile(r"<(/?)(svg|foreignobject|title|desc|p|div|h[1-6]|ul|ol|dl|table|article|section|main|header|footer|nav|aside|blockquote|pre|body|span|strong|em)(?=[\s/>])", re.I)
TEMPLATE_END = re.compile(r"<(/?)template(?=[\s/>])", re.I)
STOPS = re.compile(r"[.,;:!?]")


class Page:
    """The blocks of a page in page order: parent (-1 for the root), tag, hints, text, measures, and a label if marked."""

    def __init__(self, page: str):
        self.parent, self.depth, self.tags, self.hints, self.labels = [-1], [0], ["html"], [0], [None]
        self.own: list[list[str]] = [[]]  # texts of each block, for its measures
        self.linked = [0]
        self.runs: list[tuple[int, str]] = []  # (block, text) in page order
        self._read(page)

    @staticmethod
    def _marks(attributes: str) -> tuple[int, str | None]:
        """Hints of class, id and role as bits, and the label."""
        hints, label = 0, None
        if "=" in attributes:
            for m in NAMED.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "data-label":
                    label = value
                else:
                    for k, hint in enumerate(HINT):
                        if hint.search(value):
                            hints |= 1 << k
        return hints, label

    def _open(self, tag: str, above: int, attributes: str) -> int:
        hints, label = self._marks(attributes)
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        self.tags.append(tag)
        self.hints.append(hints)
        self.labels.append(label)
        self.own.append([])
        self.linked.append(0)
        return len(self.parent) - 1

    def _text(self, block: int, text: str, in_link: bool) -> None:
        if "&" in text:
            text = html.unescape(text)
        if text:
            self.runs.append((block, text))
            self.own[block].append(text)
            if in_link:
                self.linked[block] += len(text.strip())

    def _raw(self, block: int, text: str) -> None:
        """Text that is shown as it is written."""
        if text:
            self.runs.append((block, text))
            self.own[block].append(text)

    @staticmethod
    def _hidden_end(page: str, tag: str, at: int) -> int:
        """Where a drawing or template ends that starts before ``at``; -1 for a template without an end tag.

        A drawing also ends before a block that stands in none of its parts for blocks.
        """
        depth, sheltered = 1, 0
        for m in (TEMPLATE_END if tag == "template" else IN_DRAWING).finditer(page, at):
            name = tag if tag == "template" else m[2].lower()
            if name == tag:
                depth += -1 if m[1] else 1
                if not depth:
                    end = page.find(">", m.end())
                    return end + 1 if end >= 0 else len(page)
            elif name in ("foreignobject", "title", "desc"):
                sheltered = max(0, sheltered + (-1 if m[1] else 1))
            elif not sheltered and not m[1]:
                return m.start()
        return -1 if tag == "template" else len(page)

    def _read(self, page: str) -> None:
        stack, open_tags, links, at, n = [(0, "html")], {"html": 1}, 0, 0, len(page)
        unclosed: set[str] = set()
        while at < n:
            start = page.find("<", at)
            if start < 0:
                self._text(stack[-1][0], page[at:], links > 0)
                break
            if start > at:
                self._text(stack[-1][0], page[at:start], links > 0)
            following = page[start + 1 : start + 2]
            if following == "!" or following == "?" or following == "/" and not page[start + 2 : start + 3].isalpha():
                if page.startswith("<!--", start):
                    end = page.find("-->", start + 2)
                    at = end + 3 if end >= 0 else n
                else:
                    end = page.find(">", start)
                    at = end + 1 if end >= 0 else n
                continue
            if not (following.isascii() and following.isalpha() or following == "/"):
                self._text(stack[-1][0], "<", links > 0)
                at = start + 1
                continue
            m = TAG.match(page, start)
            if not m:
                break  # the page ends inside a tag
            at = m.end()
            closing, tag, attributes = m[1], m[2].lower(), m[3]
            if closing:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag not in INLINE and open_tags.get(tag) and tag not in ("html", "body"):
                    while True:
                        _, name = stack.pop()
                        open_tags[name] -= 1
                        if name == tag:
                            break
                    links = 0
                continue
            if tag in RAW and not attributes.endswith("/"):
                found = None if tag in unclosed else RAW_END[tag].search(page, at)
                if not found and tag == "noembed":
                    unclosed.add(tag)
                    continue
                if tag == "xmp":
                    self._raw(stack[-1][0], page[at : found.start() if found else n])
                if not found:
                    break
                end = page.find(">", found.end())
                at = end + 1 if end >= 0 else n
                continue
            if tag in HIDDEN and not attributes.endswith("/"):
                if tag not in unclosed:
                    end = self._hidden_end(page, tag, at)
                    if end < 0:
                        unclosed.add(tag)  # no end tag from here on, so none later
                    else:
                        at = end
                continue
            if tag == "a":
                links += 1
                continue
            if tag in ("br", "hr"):
                self.runs.append((stack[-1][0], " "))
                self.own[stack[-1][0]].append(" ")
                continue
            if tag == "html":
                self.hints[0], self.labels[0] = self._marks(attributes)
                continue
            if tag in INLINE or tag in VOID:
                continue
            if tag == "body" and open_tags.get("body"):
                continue
            if open_tags.get("head") and tag not in HEAD:
                self._close({"head"}, frozenset(), stack, open_tags)
            if tag in CLOSES_PARAGRAPH and open_tags.get("p"):
                self._close({"p"}, frozenset(("td", "th", "button")), stack, open_tags)
                links = 0
            if tag in SAME_ENDS:
                self._close(*SAME_ENDS[tag], stack, open_tags)
            block = self._open(tag, stack[-1][0], attributes)
            if not attributes.endswith("/") or tag in CLOSES_PARAGRAPH:
                stack.append((block, tag))
                open_tags[tag] = open_tags.get(tag, 0) + 1

    @staticmethod
    def _close(tags, shelter, stack, open_tags) -> None:
        """Close the elements down to the lowest open one of ``tags`` that nothing of ``shelter`` stands above."""
        if not any(open_tags.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] in shelter:
                return
            if stack[k][1] in tags:
                for _, name in stack[k:]:
                    open_tags[name] -= 1
                del stack[k:]
                # a row also ends the cells that stand in it
                k = len(stack)
                if not any(open_tags.get(t) for t in tags) or stack[-1][1] not in tags:
                    return

    def measures(self) -> np.ndarray:
        """One row of features for each block."""
        n = len(self.parent)
        rows = np.zeros((n, len(TAGS) + 2 * len(HINTS) + MEASURES))
        length = np.array([sum(len(t.strip()) for t in own) for own in self.own], dtype=np.float64)
        stops = np.array([sum(len(STOPS.findall(t)) for t in own) for own in self.own], dtype=np.float64)
        linked = np.array(self.linked, dtype=np.float64)
        # what stands in furniture: parts whose tag or hints say that they are none of the story
        aside = np.array([t in FURNITURE or h & FURNITURE_HINTS > 0 for t, h in zip(self.tags, self.hints)])
        for i in range(1, n):
            aside[i] |= aside[self.parent[i]]
        plain = np.where(aside, 0.0, length)
        below, linked_below, stops_below, paragraphs = length.copy(), linked.copy(), stops.copy(), np.array([t == "p" for t in self.tags], dtype=np.float64)
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            below[up] += below[i]
            linked_below[up] += linked_below[i]
            stops_below[up] += stops_below[i]
            paragraphs[up] += paragraphs[i]
            plain[up] += plain[i]
        total = max(below[0], 1.0)
        before = (np.cumsum(length) - length) / total
        places = np.array([TAG_PLACE.get(t, -1) for t in self.tags])
        known = np.flatnonzero(places >= 0)
        rows[known, places[known]] = 1
        hints, up = np.array(self.hints), np.maximum(np.array(self.parent), 0)
        above = hints[up] | hints[up[up]]  # of the block around and the one around that
        for k in range(len(HINTS)):
            rows[:, len(TAGS) + k] = (hints >> k) & 1
            rows[:, len(TAGS) + len(HINTS) + k] = (above >> k) & 1
        at = len(TAGS) + 2 * len(HINTS)
        for k, values in enumerate((np.log1p(length), np.log1p(below), linked / (length + 1), linked_below / (below + 1), np.minimum(stops / (length + 1) * 10, 1), np.minimum(stops_below / (below + 1) * 10, 1), np.log1p(paragraphs), before, np.minimum(np.array(self.depth), 12) / 4, below / total, plain / max(plain[0], 1.0), aside)):
            rows[:, at + k] = values
        return rows

    def text(self, keep: np.ndarray) -> str:
        """The texts of the blocks to keep: white space is one blank, and so is the border of a block."""
        parts, last = [], -1
        for block, text in self.runs:
            if keep[block]:
                if block != last:
                    parts.append(" ")
                parts.append(text)
            last = block
        return " ".join("".join(parts).split())
