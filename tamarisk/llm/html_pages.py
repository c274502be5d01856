"""Labelled pages to train the extractor on: generated, so that the label of every element is known."""

from __future__ import annotations

import random

#: Names that pages give to parts of either kind.
CONTENT_NAMES = ("content", "main", "article", "post", "entry", "story", "body", "text", "article-body", "post-content", "entry-content", "page-content", "main-content")
NOISE = {
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "main-menu", "tabs", "pagination"),
    "header": ("header", "site-header", "masthead", "banner", "topbar", "logo", "page-header"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom", "colophon"),
    "aside": ("sidebar", "aside", "widget", "related", "side", "rail", "trending", "popular", "recommended", "tags"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner-ad", "ad-slot", "adbox"),
    "notice": ("cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "disclaimer", "paywall"),
    "form": ("form", "subscribe", "newsletter", "signup", "login", "search", "contact-form"),
    "comments": ("comments", "comment", "comment-list", "replies", "reply", "disqus", "discussion", "respond", "reader-comments", "feedback"),
    "share": ("share", "social", "social-links", "sharing", "byline-share", "follow"),
}
_SYLLABLES = ("an", "er", "tion", "the", "lo", "ma", "ver", "que", "sch", "el", "ta", "re", "ing", "ou", "de", "la", "ber", "co", "mi", "es")


def _sentence(r: random.Random, least: int = 4, most: int = 22) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
    for i in range(3, len(words) - 1, 6):
        words[i] += r.choice((",", "", ""))
    return " ".join(words).capitalize() + r.choice((".", ".", ".", "!", "?"))


def _text(r: random.Random, sentences: int) -> str:
    return " ".join(_sentence(r) for _ in range(sentences))


def _tag(tag: str, label: int, inner: str, name: str = "", closed: bool = True) -> str:
    return f'<{tag} data-y="{label}"' + (f' {name}' if name else "") + ">" + inner + (f"</{tag}>" if closed else "")


def _named(r: random.Random, names: tuple[str, ...]) -> str:
    return f'{r.choice(("class", "class", "id"))}="{r.choice(names)}"'


def _links(r: random.Random, label: int) -> str:
    return _tag("ul", label, "".join(_tag("li", label, _tag("a", label, _sentence(r, 1, 3).rstrip(".!?"), f'href="/{i}"')) for i in range(r.randint(2, 7))))


def _noise(r: random.Random, kind: str) -> str:
    tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
    tag = tag if r.random() < 0.65 else r.choice(("div", "section"))
    name = _named(r, NOISE[kind]) if tag in ("div", "section") or r.random() < 0.5 else ""
    if kind in ("nav", "share"):
        inner = _links(r, 0)
    elif kind == "header":
        inner = _tag("a", 0, _sentence(r, 1, 3), 'href="/"') + (_links(r, 0) if r.random() < 0.5 else _tag("p", 0, _sentence(r, 2, 6)))
    elif kind == "footer":
        inner = "&copy; " + _text(r, r.randint(1, 3)) + (_links(r, 0) if r.random() < 0.4 else "")
    elif kind == "aside":
        inner = _tag(r.choice(("h2", "h3", "h4")), 0, _sentence(r, 1, 4)) + (_links(r, 0) if r.random() < 0.7 else _tag("p", 0, _text(r, 2)))
    elif kind == "form":
        inner = _tag("label", 0, _sentence(r, 1, 4)) + "<input>" + _tag("p", 0, _sentence(r, 2, 8))
    elif kind == "comments":
        one = lambda: _tag("div", 0, _tag("b", 0, _sentence(r, 1, 2)) + _tag("p", 0, _text(r, r.randint(1, 4))), _named(r, NOISE["comments"]))
        inner = _tag("h3", 0, _sentence(r, 1, 3)) + "".join(one() for _ in range(r.randint(1, 5)))
    else:
        body = _text(r, r.randint(1, 3))
        inner = body if r.random() < 0.5 else _tag("p", 0, body) + _tag("a", 0, _sentence(r, 1, 3), 'href="#"')
    return _tag(tag, 0, inner, name)


def _article(r: random.Random) -> str:
    parts = [_tag("h1", 1, _sentence(r, 3, 12))] if r.random() < 0.85 else []
    for _ in range(r.choice((0, 1, 2, 3, 4, 5, 6, 8))):
        kind = r.random()
        if kind < 0.68:
            inner = _text(r, r.randint(1, 6))
            if r.random() < 0.02:  # very long, and hardly a sentence
                inner = r.choice((" ", ", ")).join([_sentence(r, 1, 1)[:-1]] * r.randint(100, 1500))
            inner = inner if r.random() < 0.7 else _tag(r.choice(("b", "i", "em", "span")), 1, _sentence(r, 2, 6), closed=r.random() < 0.8) + " " + inner
            inner = inner if r.random() < 0.8 else inner + " " + _tag("a", 1, _sentence(r, 1, 3), 'href="/x"') + " " + _sentence(r)
            parts.append(_tag(r.choice(("p", "p", "p", "p", "div")), 1, inner, closed=r.random() < 0.9))
        elif kind < 0.76:
            parts.append(_tag(r.choice(("h2", "h3")), 1, _sentence(r, 2, 7)))
        elif kind < 0.84:
            parts.append(_tag(r.choice(("ul", "ol")), 1, "".join(_tag("li", 1, _sentence(r)) for _ in range(r.randint(2, 5)))))
        elif kind < 0.9:
            parts.append(_tag("blockquote", 1, _tag("p", 1, _text(r, 2))))
        elif kind < 0.94:
            parts.append(_tag("table", 1, "".join(_tag("tr", 1, "".join(_tag("td", 1, _sentence(r, 1, 3)) for _ in range(3))) for _ in range(2))))
        else:
            parts.append(_noise(r, r.choice(("ad", "share", "aside", "notice", "form"))))
    return "".join(parts) or _tag("p", 1, _text(r, 2))


def _plain(r: random.Random) -> str:
    """Text that is set as it is."""
    lines = [_sentence(r, 4, 12) for _ in range(r.randint(2, 12))]
    return _tag("pre", 1, "\n".join(lines), _named(r, CONTENT_NAMES) if r.random() < 0.2 else "")


def _in_body(r: random.Random) -> tuple[str, str]:
    """An article that stands right in the body, and the body's own label: paragraphs, text set as it is, or bare text."""
    kind = r.random()
    if kind < 0.55:
        return _article(r), "0"
    if kind < 0.8:
        return (_tag("h1", 1, _sentence(r, 2, 8)) if r.random() < 0.4 else "") + _plain(r), "0"
    return (_tag("h1", 1, _sentence(r, 2, 8)) if r.random() < 0.4 else "") + "<br>".join(_text(r, r.randint(1, 4)) for _ in range(r.randint(1, 6))), "1"


def labelled_page(seed: int) -> str:
    """A page; elements carry their label in data-y."""
    r = random.Random(seed)
    top = [_noise(r, k) for k in ("header", "nav", "notice", "ad") if r.random() < 0.6]
    end = [_noise(r, k) for k in ("comments", "aside", "share", "form", "ad", "notice") if r.random() < 0.4] + ([_noise(r, "footer")] if r.random() < 0.9 else [])
    r.shuffle(top)
    tag = r.choice(("article", "article", "article", "main", "div", "section"))
    body = "0"
    if r.random() < 0.25:
        inner, body = _in_body(r)
    else:
        own = _plain(r) if r.random() < 0.05 else _article(r)
        if r.random() < 0.12:  # with a header of its own
            own = _tag("header", 1, _tag("h1", 1, _sentence(r, 3, 12)) + (_tag("p", 1, _sentence(r, 2, 8)) if r.random() < 0.3 else "")) + _tag("p", 1, _text(r, r.randint(1, 4))) + (own if r.random() < 0.4 else "")
        inner = _tag(tag, 1, own, _named(r, CONTENT_NAMES) if tag == "div" or r.random() < 0.4 else "")
        if tag != "main" and r.random() < 0.4:
            inner = _tag(r.choice(("main", "div")), 0, inner + (_noise(r, "aside") if r.random() < 0.4 else ""), _named(r, ("container", "wrapper", "page", "layout", "row")))
    return f'<!DOCTYPE html><html data-y="0"><head><title>t</title></head><body data-y="{body}">{"".join(top)}{inner}{"".join(end)}' + ("</body></html>" if r.random() < 0.9 else "")
