"""Labelled pages for the extractor's training: ``pages(n)`` builds them from page plans.

A page is a list of (markup, keep) parts: the article's blocks are kept, all furniture is
not. Plans vary the article's container, the names of classes and ids, and which furniture
stands where (also inside the article). Words are drawn from made-up syllables, so no
feature can lean on a language.
"""

from __future__ import annotations

import random

#: A private character at the head of a block says whether it is kept.
KEEP, DROP = "\ue000", "\ue001"

SYLLABLES = "an be co da el fi go hu in ja ke lo mi no or pe qu ra so ti un ve wo ya zu ther tion eau sch ción ing".split()
MENU = "Home About Contact News Archive Login Register Search Help Terms Privacy Shop Blog FAQ Jobs".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def _sentence(r: random.Random, low: int = 4, high: int = 22) -> str:
    w = [_word(r) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
    return " ".join(w).capitalize().rstrip(",") + "."


def _paragraph(r: random.Random) -> str:
    return " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 3, 5, 8])))


def _links(r: random.Random, mark: str) -> str:
    n = r.randint(3, 9)
    names = [r.choice(MENU) if r.random() < 0.5 else _word(r) for _ in range(n)]
    if r.random() < 0.7:
        return "<ul>" + "".join(f'<li><a href="/{x}">{mark}{x}</a></li>' for x in names) + "</ul>"
    return " | ".join(f'<a href="/{x}">{mark}{x}</a>' for x in names)


def _box(r: random.Random, names: list[str], inside: str, tags: tuple[str, ...] = ("div",)) -> str:
    tag = r.choice(tags)
    name = r.choice(names)
    attr = r.choice([f' class="{name}"', f' id="{name}"', f' class="x {name}-box"', f" class={name}"])
    if tag not in ("div", "section") and r.random() < 0.5:
        attr = ""
    return f"<{tag}{attr}>{inside}</{tag}>"


def _furniture(r: random.Random, kind: str) -> str:
    d = DROP
    if kind == "menu":
        return _box(r, ["nav", "menu", "navbar", "breadcrumb", "topnav"], _links(r, d), ("nav", "nav", "div", "ul"))
    if kind == "header":
        return _box(r, ["header", "masthead", "site-header", "branding"], f"<h1>{d}{_word(r).title()}</h1><p>{d}{_sentence(r, 2, 6)}</p>", ("header", "div"))
    if kind == "footer":
        return _box(r, ["footer", "site-footer", "copyright", "colophon"], f"{d}&copy; {r.randint(1999, 2024)} {_word(r)}.example.com &middot; {_sentence(r, 3, 9)}", ("footer", "footer", "div"))
    if kind == "ad":
        return _box(r, ["ad", "ads", "advert", "sponsored", "promo", "banner"], d + (_paragraph(r) if r.random() < 0.4 else _sentence(r)), ("div", "div", "aside"))
    if kind == "sidebar":
        body = f"<h3>{d}{_sentence(r, 1, 3)}</h3>" + (_links(r, d) if r.random() < 0.6 else f"<p>{d}{_paragraph(r)}</p>")
        return _box(r, ["sidebar", "related", "widget", "recommended", "aside"], body, ("aside", "aside", "div"))
    if kind == "notice":
        return _box(r, ["cookie", "notice", "consent", "gdpr-banner", "popup", "alert"], f"<p>{d}{_sentence(r, 6, 24)}</p><button>{d}{r.choice(['OK', 'Accept', 'Close'])}</button>", ("div", "div", "dialog"))
    if kind == "form":
        return f"<form action='/x'><label>{d}{_sentence(r, 1, 4)}</label><input name=q><select><option>{d}{_word(r)}</option><option>{d}{_word(r)}</option></select><button>{d}{_word(r)}</button></form>"
    if kind == "share":
        return _box(r, ["share", "social", "tags", "byline-share"], _links(r, d))
    if kind == "newsletter":
        return _box(r, ["newsletter", "subscribe", "signup"], f"<p>{d}{_sentence(r, 5, 18)}</p>")
    one = lambda: _box(r, ["comment", "reply", "response"], f"<b>{d}{_word(r).title()}</b><p>{d}{_paragraph(r)}</p>", ("div", "li", "article"))
    return _box(r, ["comments", "discussion", "disqus", "responses", "respond"], f"<h3>{d}{r.randint(1, 99)} {_word(r)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))), ("section", "div", "div"))


def _article(r: random.Random) -> str:
    k, parts = KEEP, []
    for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
        x = r.random()
        if x < 0.72:
            text = _paragraph(r)
            if r.random() < 0.15:
                text += f' <a href="/y">{_word(r)}</a> {_sentence(r)}'
            parts.append(f"<p>{k}{text}" + ("</p>" if r.random() < 0.9 else ""))
        elif x < 0.8:
            parts.append(f"<h2>{k}{_sentence(r, 1, 6)}</h2>")
        elif x < 0.86:
            parts.append(f"<p><b>{k}{_sentence(r, 1, 9)}<br><p>{k}{_paragraph(r)}</p>")
        elif x < 0.88:
            parts.append(f"<p><b>{k}{_word(r)}<br>")
        elif x < 0.91:
            parts.append("<ul>" + "".join(f"<li>{k}{_sentence(r, 2, 10)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif x < 0.94:
            parts.append(f"<blockquote>{k}{_sentence(r)}</blockquote>")
        elif x < 0.97:
            parts.append("<table>" + "".join(f"<tr><td>{k}{_word(r)}</td><td>{k}{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        else:
            parts.append(f"<pre>{k}{_word(r)} = {_word(r)}</pre>")
    for kind in ("ad", "share", "sidebar", "newsletter", "notice", "form"):
        if r.random() < 0.12:
            parts.insert(r.randint(0, len(parts)), _furniture(r, kind))
    body = f"<h1>{k}{_sentence(r, 2, 10)}</h1>" * (r.random() < 0.85) + "".join(parts)
    x = r.random()
    if x < 0.55:
        return f"<article>{body}" + "</article>" * (r.random() < 0.95)
    if x < 0.7:
        return f"<main>{body}</main>"
    if x < 0.82:  # no container of its own
        return body if r.random() < 0.7 else k + _paragraph(r) + body
    return _box(r, ["content", "post", "entry-content", "article-body", "story", "main-text"], body)


def page(seed: int) -> str:
    r = random.Random(seed)
    before = [_furniture(r, k) for k in ("notice", "header", "menu", "ad", "sidebar", "form") if r.random() < (0.75 if k in ("menu", "ad") else 0.3)]
    after = [_furniture(r, k) for k in ("ad", "share", "comments", "sidebar", "newsletter", "form", "menu", "footer") if r.random() < (0.75 if k == "footer" else 0.28)]
    if r.random() < 0.15:
        before = []
    if r.random() < 0.15:
        after = []
    wrap = ("<div class=wrapper>", "</div>") if r.random() < 0.3 else ("", "")
    return f"<!DOCTYPE html><html><head><title>{_word(r)}</title></head><body>{wrap[0]}{''.join(before)}{_article(r)}{''.join(after)}{wrap[1]}</body></html>"


def pages(n: int, first: int = 0) -> list[str]:
    return [page(first + i) for i in range(n)]
