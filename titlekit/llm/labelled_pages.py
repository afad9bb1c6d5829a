"""Labelled pages for training: layouts written by hand, with ``data-label`` on blocks that are content or not.

A mark holds for everything inside a block unless a block inside has its own. The layouts' slots are filled with
sentences of made-up words, so that lengths vary.
"""

from __future__ import annotations

import numpy as np

#: Parts of pages. {s} is a sentence, {w} a word, {l} a list of links, {p} some paragraphs, {q} one
#: or two, {c} comments of readers.
TOPS = (
    "<nav><ul>{l}</ul></nav>",
    "<header><div class='logo'>{w}</div><nav>{l}</nav></header>",
    "<div id='header'><a href='/'>{w}</a><p>{s}</p></div><div class='menu'><ul>{l}</ul></div>",
    "<div class='topbar'><a href='/'>{w}</a> | <a href='/in'>{w}</a></div><ul class='nav'>{l}</ul>",
    "<header><h2>{w} {w}</h2><p>{s}</p></header>",
    "<ul>{l}</ul>",
    "",
)
NOTICES = (
    "<div class='cookie-notice'><p>{s} {s}</p><button>{w}</button></div>",
    "<div class='ad'>{s}</div>",
    "<div class='advert'><p>{s}</p><p>{s}</p></div>",
    "<aside class='ad'>{s} {s}</aside>",
    "<div class='newsletter'><h3>{w} {w}</h3><p>{s}</p><form><input name='m'><button>{w}</button></form></div>",
    "<div class='breadcrumb'><a href='/'>{w}</a> <a href='/a'>{w}</a></div>",
    "<form class='search'><label>{w}</label><input><button>{w}</button></form>",
    "<div role='alert'>{s}</div>",
    "<div id='consent'>{s} {s} {s}<a href='/more'>{w}</a></div>",
    "",
    "",
)
BODIES = (
    "<article data-label='content'><h1>{s}</h1>{p}</article>",
    "<article data-label='content'><h1>{s}</h1>{p}{p}</article>",
    "<main><article data-label='content'><header><h1>{s}</h1></header>{p}<h2>{s}</h2>{p}</article></main>",
    "<div class='content'><div class='post' data-label='content'><h1>{s}</h1>{p}<blockquote><p>{s}</p></blockquote>{p}</div></div>",
    "<div id='main'><div data-label='content'><h1>{w} {w}</h1>{p}<ul><li>{s}</li><li>{s}</li></ul>{p}</div></div>",
    "<main data-label='content'><h1>{s}</h1>{p}<table><tr><th>{w}</th><td>{s}</td></tr><tr><th>{w}</th><td>{w}</td></tr></table>{p}</main>",
    "<section class='story' data-label='content'><h1>{s}</h1><div>{p}</div><div class='share' data-label='other'><a href='/f'>{w}</a><a href='/t'>{w}</a></div><div>{p}</div></section>",
    "<article data-label='content'><h1>{s}</h1>{p}<div class='ad' data-label='other'>{s}</div>{p}<section class='comments' data-label='other'><h3>{w}</h3><div class='comment'><p>{s}</p></div><div class='comment'><p>{s} {s}</p></div></section></article>",
    "<article data-label='content'><h1>{s}</h1><figure><figcaption>{s}</figcaption></figure>{p}<aside data-label='other'><h4>{w}</h4><ul>{l}</ul></aside>{p}</article>",
    "<div data-label='content'><h1>{s}</h1>{p}{p}</div>",
    "<table class='layout'><tr><td class='side'><ul>{l}</ul></td><td data-label='content'><h1>{s}</h1>{p}{p}</td></tr></table>",
    "<div class='wrap'><div class='entry-content' data-label='content'><h2>{s}</h2><p>{s}</p><pre>{s}</pre><h3>{w} {w}</h3>{p}<ol><li>{s}</li><li><p>{s}</p></li></ol></div></div>",
    "<article data-label='content'><h1>{s}</h1>{p}<section class='comments' data-label='other'><h3>{w}</h3><div class='comment'><p>{s} {s}</p></div></section></article>",
    "<main><article data-label='content'><h1>{s}</h1>{p}<div id='comments' data-label='other'><h2>{w} {w}</h2><ol><li><p>{s}</p><p>{s}</p></li></ol></div></article></main>",
    "<article data-label='content'><h1>{s}</h1>{p}<div class='social' data-label='other'><span>{w}</span> <a href='/s'>{w}</a></div><div class='promo' data-label='other'><h3>{s}</h3><p>{s}</p></div>{p}</article>",
    "<article data-label='content'><p>{s}</p></article>",
    "<div class='{w}' data-label='content'><h1>{s}</h1>{q}</div>",
    "<div class='{w}' data-label='content'><h2>{w} {w}</h2>{q}{p}</div>",
    "<div data-label='content'><h1>{s}</h1>{q}</div>",
    "<div class='{w}'><div id='{w}' data-label='content'><h1>{w} {w}</h1>{q}</div></div>",
    "<div data-label='content'>{q}</div>",
    "<main data-label='content'>{q}</main>",
    "<main><div class='{w}' data-label='content'>{q}</div></main>",
    "<main data-label='content'>{q}<section class='comments' data-label='other'><h3>{w}</h3>{c}</section></main>",
    "<main data-label='content'><h1>{s}</h1>{q}<div class='comments' data-label='other'>{c}</div></main>",
    "<section data-label='content'><h2>{s}</h2><div>{s}</div>{q}</section>",
    "<article data-label='content'><h1>{s}</h1>{q}<section><h2>{s}</h2><div>{s} {s}</div></section>{p}</article>",
    "<article data-label='content'><section class='{w}'><h2>{w} {w}</h2><div>{s}</div><div><p>{s}</p></div></section></article>",
    "<article data-label='content'><h1>{w}</h1><p>{w}.</p></article>",
    "<article data-label='content'><h1>{s}</h1>{p}<form data-label='other'><label>{w}</label><input><button>{w}</button></form><div class='related' data-label='other'><h3>{w}</h3><ul>{l}</ul><p>{s}</p></div></article>",
)
ENDS = (
    "<footer>&copy; {w} {s}</footer>",
    "<div id='footer'><p>{s}</p><ul>{l}</ul></div>",
    "<section id='comments'><h2>{w}</h2><ol><li><div><p>{s} {s}</p><p>{s}</p></div></li><li><p>{s}</p></li></ol><form><textarea></textarea><button>{w}</button></form></section><footer><p>{s}</p></footer>",
    "<aside><h3>{w}</h3><ul>{l}</ul><p>{s}</p></aside><footer>{s}</footer>",
    "<div class='sidebar'><div class='widget'><h4>{w}</h4><p>{s}</p></div><div class='widget'><ul>{l}</ul></div></div><div class='footer'>{s}</div>",
    "<div class='comments'><p>{s}</p><div class='reply'><p>{s} {s}</p></div></div><footer><a href='/i'>{w}</a> <a href='/p'>{w}</a></footer>",
    "<div class='related'><h3>{w}</h3><div><a href='/r'>{s}</a></div><div><a href='/r'>{s}</a></div></div><footer>{s}</footer>",
    "<div class='comments'><h3>{w}</h3>{c}</div>",
    "<div id='comments'>{c}</div><footer>{s}</footer>",
    "<section class='discussion'><h2>{w} {w}</h2>{c}{c}</section><div class='footer'>{s}</div>",
    "<footer>&copy; {w}. {s}</footer>",
    "<div class='disclaimer'><p>{s} {s}</p></div><footer>{s}</footer>",
    "",
)
#: Pages without any layout.
WHOLE = (
    "<html><body data-label='content'><h1>{s}</h1>{p}{p}</body></html>",
    "<html data-label='content'>{s} {s}",
    "<html data-label='content'><p>{s}",
    "<html data-label='content'>{s}<br>{s}<br><br>{s}",
    "<html><body data-label='content'><h2>{s}</h2>{p}<hr>{p}<ul data-label='other'>{l}</ul></body></html>",
)


def filled(part: str, random: np.random.Generator) -> str:
    def word() -> str:
        return "".join(random.choice(list("aeioulnrstdmk"), random.integers(2, 9)))

    # some texts shout, some are full of signs
    mark = ("", "", "", "", "", "!!", "###", " |", "%%%")[random.integers(9)]

    def sentence() -> str:
        words = [word() + (mark if random.random() < 0.9 else "") for _ in range(int(random.integers(1, 26)))]
        if mark == "!!":
            words = [w.upper() for w in words]
        for k in range(len(words) - 1):
            if random.random() < 0.1:
                words[k] += ","
        return " ".join(words).capitalize() + "."

    def paragraph() -> str:
        text = " ".join(sentence() for _ in range(int(random.integers(1, 9))))
        if random.random() < 0.2:
            text += f" <a href='/x'>{word()}</a> {sentence()}"
        return f"<p>{text}" + ("</p>" if random.random() < 0.9 else "")

    out = []
    for piece in part.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece == "{w}":
            out.append(word())
        elif piece == "{s}":
            out.append(sentence())
        elif piece == "{l}":
            out.append("".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(int(random.integers(2, 9)))))
        elif piece == "{q}":
            out.append("".join(paragraph() for _ in range(int(random.integers(1, 3)))))
        elif piece == "{c}":
            out.append("".join(f"<div class='comment'><p>{sentence()}</p></div>" for _ in range(int(random.integers(1, 16)))))
        elif piece == "{p}":
            out.append("".join(paragraph() for _ in range(int(random.integers(1, 7)))))
        else:
            out.append(piece)
    return "".join(out)


def labelled_pages(seed: int = 5, bodies: tuple[str, ...] = BODIES, times: int = 7) -> list[str]:
    """Every body ``times`` times with several tops, notices and ends."""
    random = np.random.default_rng(seed)
    pages = []
    for body in bodies:
        for _ in range(times):
            parts = [TOPS, NOTICES, (body,), NOTICES, ENDS]
            chosen = [filled(options[random.integers(len(options))], random) for options in parts]
            pages.append("<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(chosen) + "</body></html>")
    pages += [filled(whole, random) for whole in WHOLE for _ in range(6)]
    return pages
