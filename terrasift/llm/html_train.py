"""Trains the block labeller on generated pages: python -m terrasift.llm.html_train

Pages are drawn from many layouts with known labels; their words are invented, so that the labeller learns from paths,
shapes and neighbours, with some usual words of menus, notices and forms. Nothing of any given table is used.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from terrasift.llm.block_lstm import BlockLabeller, features
from terrasift.llm.html_blocks import blocks

MARK = "\u2063"  # an invisible character that labels generated main text and is taken out before training

SYLLABLES = "an ber con de el fa gre hi in jo ka lo mi no or pe qui ra st tu un ver wo xi za ch é ü ß ñ tion ing".split()
NOISE = {
    "nav": "Home About Contact News Products Blog Archive Login Search Sports Weather Video Help Menu".split(),
    "footer": ["Copyright 2024", "All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Impressum", "© Site"],
    "cookie": ["We use cookies to improve your experience", "Accept all", "Reject", "This site uses cookies", "Cookie settings"],
    "form": ["Subscribe to our newsletter", "Your e-mail", "Sign up", "Send", "Name", "Search this site", "Log in"],
    "share": ["Share this", "Tweet", "Print", "Email this article", "Follow us"],
    "related": ["Related articles", "Read more", "You may also like", "Most popular", "Trending now", "Recommended"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Limited offer", "Sponsored content"],
    "comments": ["Comments", "Reply", "3 comments", "Leave a comment", "Report"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(SYLLABLES, k=r.choice((1, 1, 2, 2, 3)))) for _ in range(n))

    def sentence(self, long_: bool = True) -> str:
        text = self.words(self.r.randint(3, 24) if long_ else self.r.randint(1, 8))
        return text.capitalize() + self.r.choice((".", ".", ".", "!", "?", "")) if self.r.random() < 0.95 else text

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 4, 6))))

    def some(self, *choices: str) -> str:
        return self.r.choice(choices)

    def menu(self) -> str:
        items = self.r.choices(NOISE["nav"], k=self.r.randint(2, 7)) if self.r.random() < 0.5 else [self.words(1) for _ in range(self.r.randint(2, 7))]
        inner = "".join(f'<li><a href="/{k}">{x}</a></li>' for k, x in enumerate(items))
        return self.some(f"<nav><ul>{inner}</ul></nav>", f'<div class="{self.some("menu", "navbar", "main-nav", "breadcrumb", "breadcrumbs", "navigation")}"><ul>{inner}</ul></div>', f'<ul id="{self.some("menu", "topnav")}">{inner}</ul>', "<nav>" + " ".join(f"<a href=#>{x}</a>" for x in items) + "</nav>")

    def wrapped(self, names: tuple[str, ...], inner: str, tags: tuple[str, ...] = ("div", "section", "aside")) -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        return f'<{tag} {self.some("class", "class", "id")}="{name}">{inner}</{tag}>'

    def noise(self, kind: str) -> str:
        """Boilerplate; its text may be as long as prose."""
        r = self.r
        usual = r.choice(NOISE[kind]) if r.random() < 0.5 else self.sentence(r.random() < 0.6)
        body = self.some(usual, f"<p>{usual}</p>", f"<p>{self.prose()}</p>", f"<h3>{usual}</h3><p>{self.prose()}</p>")
        if kind == "nav":
            return self.menu()
        if kind == "footer":
            return self.some(f"<footer>{body}</footer>", f"<footer>&copy; {self.words(1)} &middot; {self.prose()}</footer>", self.wrapped(("footer", "site-footer", "page-footer", "copyright", "legal"), body, ("div", "footer")))
        if kind == "cookie":
            return self.wrapped(("cookie-notice", "cookie-banner", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "banner"), body + self.some("", "<button>OK</button>"))
        if kind == "form":
            return self.some(f'<form action="/x"><label>{usual}</label><input name="q"><button>{self.words(1)}</button></form>', self.wrapped(("newsletter", "subscribe", "signup", "search", "login"), f"<form>{body}</form>"), f"<form><select><option>{self.words(1)}<option>{self.words(2)}</select><p>{self.prose()}</p></form>")
        if kind == "share":
            return self.wrapped(("share", "social", "sharing", "share-buttons", "social-links"), "".join(f"<a href=#>{x}</a> " for x in r.choices(NOISE["share"], k=3)))
        if kind == "related":
            inner = f"<h3>{usual}</h3><ul>" + "".join(f"<li><a href=#>{self.sentence()}</a></li>" for _ in range(r.randint(2, 6))) + "</ul>"
            return self.some(self.wrapped(("sidebar", "related", "recommended", "widget", "popular", "more-stories", "rail"), inner), f"<aside>{inner}</aside>", f"<aside>{body}</aside>", self.wrapped(("sidebar", "side", "widget"), body))
        if kind == "ad":
            return self.wrapped(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"), self.some(body, self.prose()))
        comment = lambda: self.wrapped(("comment", "comment-body", "reply"), f"<p>{self.prose()}</p>", ("div", "li", "article", "section"))
        return self.wrapped(("comments", "comment-list", "disqus", "discussion", "responses", "reader-comments"), f"<h3>{usual}</h3>" + "".join(comment() for _ in range(r.randint(1, 5))), ("div", "section", "ol", "aside"))

    def main_block(self) -> str:
        """One to three blocks of main text, marked."""
        r, m = self.r, MARK
        t = lambda long_=True: m + (self.prose() if long_ else self.sentence(False))
        kind = r.random()
        if kind < 0.62:
            return self.some(f"<p>{t()}</p>", f"<p>{t()}", f"<p><b>{t()}</b></p>", f"<p><b>{t()}<br><p>{t()}</p>", f'<p>{t()} <a href="#">{self.words(2)}</a> {self.words(5)}</p>')
        if kind < 0.74:
            h = self.some("h2", "h3", "h4")
            return f"<{h}>{t(False)}</{h}><p>{t()}</p>"
        if kind < 0.82:
            tag = self.some("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{t(r.random() < 0.5)}</li>" for _ in range(r.randint(2, 4))) + f"</{tag}>"
        if kind < 0.87:
            return f"<blockquote>{self.some(t(), f'<p>{t()}</p>')}</blockquote>"
        if kind < 0.91:
            return "<table>" + "".join(f"<tr><td>{t(False)}</td><td>{t(False)}</td></tr>" for _ in range(2)) + "</table>"
        if kind < 0.95:
            return f"<figure><img src=x><figcaption>{t(False)}</figcaption></figure>"
        return self.some(f"<pre>{t()}</pre>", f"<div>{t()}</div>", f"<dl><dt>{t(False)}<dd>{t()}</dl>")

    def page(self) -> str:
        r = self.r
        any_of = lambda kinds, p: "".join(self.noise(k) for k in kinds if r.random() < p)
        body = [self.main_block() for _ in range(r.choice((0, 1, 2, 3, 5, 8, 12)))]
        for kind in ("ad", "share", "related", "form", "cookie"):
            if body and r.random() < 0.15:
                body.insert(r.randrange(len(body) + 1), self.noise(kind))
        title = f"<h1>{MARK}{self.sentence(False)}</h1>" if r.random() < 0.85 else ""
        if r.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = title + "".join(body) + (self.noise("comments") if r.random() < 0.15 else "")
        kind = r.random()
        if kind < 0.5:
            main = f"<article>{inner}</article>"
        elif kind < 0.62:
            main = f"<main>{self.some(inner, f'<article>{inner}</article>')}</main>"
        elif kind < 0.66:
            main = inner
        else:
            main = self.wrapped(("content", "main-content", "post", "entry-content", "article-body", "story", "text", "post-body", "main"), inner, ("div", "section", "div"))
        if r.random() < 0.3:
            main = f'<div class="{self.some("wrapper", "container", "page", "row", "layout")}">{any_of(("related",), 0.3)}{main}{any_of(("related",), 0.3)}</div>'
        head = f'<head><title>{self.sentence()}</title><style>p{{}}</style><script>var t="</p>";</script></head>'
        top = any_of(("nav", "cookie", "form", "ad"), 0.45)
        if r.random() < 0.4:
            name = self.words(2)
            top = self.some(f"<header><div>{name}</div>{top}</header>", f'<div id="header"><h2>{name}</h2>{top}</div>', f"<header><h1>{name}</h1><p>{self.sentence()}</p></header>{top}", f'<header class="site-header"><a href="/">{name}</a></header>{top}')
        low = any_of(("comments", "related", "share", "form", "cookie", "ad", "nav"), 0.2) + any_of(("footer",), 0.8)
        return f"<!DOCTYPE html><html>{head}<body>{top}{main}{low}" + self.some("</body></html>", "", "</html>")


def made(seed: int, n: int):
    """Blocks and labels of n generated pages."""
    maker, pages, labels = Maker(seed), [], []
    for _ in range(n):
        found = blocks(maker.page())
        if found:
            labels.append([MARK in b.text for b in found])
            for b in found:
                b.text = b.text.replace(MARK, "")
            pages.append(found)
    return pages, labels


def train(pages: int = 4000, epochs: int = 6, seed: int = 1, batch: int = 32) -> BlockLabeller:
    """Adam over shuffled batches."""
    data, labels = made(seed, pages)
    model, r = BlockLabeller(seed=seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        order, losses = r.permutation(len(data)), []
        for a in range(0, len(order), batch):
            own = [data[i] for i in order[a : a + batch]]
            y = np.array([v for i in order[a : a + batch] for v in labels[i]], np.float32)
            loss, grad = model.gradients(features(own), np.array([len(p) for p in own]), y)
            losses.append(loss)
            step += 1
            rate = 0.01 * 0.5 ** (epoch // 2)
            for k, g in grad.items():
                g = np.clip(g, -1, 1).astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {np.mean(losses):.4f}", file=sys.stderr)
    return model


def accuracy(model: BlockLabeller, seed: int = 999, n: int = 500) -> float:
    pages, labels = made(seed, n)
    scores = model.logits(pages)
    return float(np.mean(np.concatenate([(s > 0) == np.array(y) for s, y in zip(scores, labels, strict=True)])))


if __name__ == "__main__":
    best = train()
    print(f"held-out accuracy {accuracy(best):.4f}", file=sys.stderr)
    best.save()
