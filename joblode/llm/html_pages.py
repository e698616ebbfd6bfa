"""Labelled training pages: random layouts whose main blocks carry a data-main attribute.

The layouts differ in containers, names, order and nesting; their words are random, so a model can learn from
structure and text shape alone.
"""

from __future__ import annotations

import random

#: Usual names of the parts of a page.
MAIN = ("content", "post content", "entry-content", "article-body", "story-body", "post", "main", "main-content", "text", "body-text", "page-content", "articleBody", "blog-post", "entry", "story", "")
NAMES = {
    "menu": ("nav", "menu", "main-nav", "navbar", "topnav", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", ""),
    "header": ("header", "site-header", "masthead", "top-bar", "branding", "page-header", "logo", ""),
    "footer": ("footer", "site-footer", "bottom", "colophon", "copyright", "legal", "page-footer", ""),
    "side": ("sidebar", "side", "widget", "related", "rail", "popular", "recommended", "more-stories", "trending", "tags", "author-box", ""),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "sponsor", "promotion", "adsbygoogle", "partner"),
    "notice": ("cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "banner-notice", "paywall", "subscribe", "warning"),
    "form": ("search", "newsletter", "signup", "login", "contact-form", "subscribe-form", ""),
    "comments": ("comments", "comment", "comment-list", "reader-comments", "disqus", "discussion", "responses", "reply", "user-comments"),
    "share": ("share", "social", "social-share", "sharing", "follow"),
}


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(("an", "be", "co", "du", "er", "fi", "gha", "in", "ly", "mo", "nt", "ou", "re", "st", "té", "ver", "zu", "ción")) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def prose(self, sentences: int) -> str:
        return " ".join(self.phrase(2, 22) + self.r.choice((".", ".", ".", "?", "!")) for _ in range(sentences))

    def attribute(self, kind: str) -> str:
        name = self.r.choice(NAMES[kind])
        return f' {self.r.choice(("class", "class", "id"))}="{name}"' if name else ""

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def boiler(self, kind: str) -> str:
        r, a = self.r, self.attribute(kind)
        tag = {"menu": r.choice(("nav", "nav", "div", "ul")), "header": r.choice(("header", "header", "div")), "footer": r.choice(("footer", "footer", "div")), "side": r.choice(("aside", "aside", "div", "section"))}.get(kind, r.choice(("div", "div", "section")))
        if tag in ("div", "section", "ul") and not a:
            a = f' class="{next(x for x in NAMES[kind] if x)}"'
        if kind == "menu":
            return f"<ul{a}>" + "".join(f'<li><a href="/">{self.phrase(1, 2)}</a></li>' for _ in range(r.randint(2, 8))) + "</ul>" if tag == "ul" else f"<{tag}{a}>{self.links(2, 9)}</{tag}>"
        if kind == "header":
            inner = r.choice((f'<a href="/">{self.phrase(1, 3)}</a>', f"<h1>{self.phrase(1, 3)}</h1><p>{self.phrase(3, 9)}</p>", f"<div>{self.phrase(1, 4)}</div>", f"<p>{self.prose(1)}</p>"))
            return f"<{tag}{a}>{inner}</{tag}>"
        if kind == "footer":
            return f"<{tag}{a}>{r.choice(('&copy; ', '© 2024 ', ''))}{r.choice((self.phrase(2, 8), self.prose(1), self.prose(2)))}{self.links(1, 4) if r.random() < 0.5 else ''}</{tag}>"
        if kind == "side":
            return f"<{tag}{a}><h3>{self.phrase(1, 4)}</h3>{r.choice((self.links(2, 7), f'<p>{self.prose(r.randint(1, 3))}</p>'))}</{tag}>"
        if kind == "form":
            inner = f"<label>{self.phrase(1, 3)}</label><input name=q>{r.choice((f'<p>{self.prose(1)}</p>', ''))}<button>{self.phrase(1, 2)}</button>"
            return f"<form{a}>{inner}</form>"
        if kind == "comments":
            one = r.choice(("div", "li", "article", "p", "section"))
            each = "".join(f'<{one} class="comment"><b>{self.phrase(1, 2)}</b> {r.choice(("", "<p>"))}{self.prose(r.randint(1, 4))}</{one}>' for _ in range(r.randint(1, 4)))
            return f"<{tag}{a}><h3>{self.phrase(1, 2)}</h3>{each}</{tag}>"
        if kind == "share":
            return f"<div{a}>{self.links(2, 4)}</div>"
        body = r.choice((self.prose(r.randint(1, 3)), f"<p>{self.prose(r.randint(1, 2))}</p>", f'<a href="/x">{self.phrase(2, 9)}</a>', f"<span>{self.prose(1)}</span><button>{self.phrase(1, 2)}</button>"))
        return f"<{tag}{a}>{body}</{tag}>"

    def main(self) -> str:
        r = self.r
        parts = []
        if r.random() < 0.85:
            title = f"<h1 data-main=1>{self.phrase(1, 12)}</h1>"
            parts.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.76:
                parts.append(f"<p data-main=1>{r.choice(('', '', '', '<b>'))}{self.prose(r.choice((1, 1, 2, 3, 5, 8)))}{r.choice(('</p>', '</p>', '</p>', '<br>'))}")
            elif kind < 0.84:
                parts.append(f"<h{(h := r.randint(2, 4))} data-main=1>{self.phrase(1, 8)}</h{h}>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li data-main=1>{self.phrase(2, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote data-main=1>{self.prose(2)}</blockquote>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td data-main=1>{self.phrase(1, 3)}</td><td data-main=1>{self.phrase(1, 3)}</td></tr>" for _ in range(2)) + "</table>")
            else:
                parts.append(f"<pre data-main=1>{self.phrase(2, 12)}</pre>")
            if r.random() < 0.1:
                parts.append(self.boiler(r.choice(("ad", "notice", "form", "share", "side", "menu"))))
        name = r.choice(MAIN)
        tag = r.choice(("article", "article", "article", "main", "div", "section", "td"))
        a = f' {r.choice(("class", "id"))}="{name}"' if name else ""
        inner = "".join(parts)
        if r.random() < 0.15:
            inner += self.boiler("comments")
        body = f"<table><tr><td{a}>{inner}</td></tr></table>" if tag == "td" else f"<{tag}{a}>{inner}</{tag}>"
        return f"<main>{body}</main>" if tag != "main" and r.random() < 0.2 else body

    def page(self) -> str:
        r = self.r
        before = [self.boiler(k) for k in ("notice", "header", "menu", "ad", "form", "side") if r.random() < 0.5]
        after = [self.boiler(k) for k in ("share", "comments", "side", "ad", "form", "notice") if r.random() < 0.4]
        foot = [self.boiler("footer")] if r.random() < 0.85 else []
        if r.random() < 0.4:
            r.shuffle(before)
            r.shuffle(after)
        inner = "".join([*before, self.main(), *after, *foot])
        if r.random() < 0.3:
            inner = f'<div class="{r.choice(("wrapper", "container", "page", "site", "row"))}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.phrase(1, 8)}</title><style>p{{}}</style></head><body>{inner}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    return [_Writer(seed * 1_000_003 + i).page() for i in range(n)]
