"""Fit the block labeller: ``python -m lakeloom.llm.train_blocks`` writes htmlblocks.npz beside this module.

Labelled pages are made from a seed: many layouts of article, menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, well or badly closed, in invented words and in the usual words of page furniture.
"""

from __future__ import annotations

import os
import random
import re

import numpy as np

from lakeloom.llm.htmlblocks import BiLSTM, _sigmoid, blocks, vectors

# Words that page furniture uses.
FURNITURE = (
    "home about contact login sign in up register subscribe newsletter cookie cookies accept privacy policy terms conditions share tweet follow us related posts popular latest "
    "advertisement sponsored ad buy now reply comment comments leave a says copyright all rights reserved menu search submit next previous read more tags categories archive sitemap"
).split()
_MAIN = ["article", "article", "article", "main", "main", 'div class="content"', 'div id="main-content"', 'div class="post entry"', 'div class="article-body"', 'section class="story"', 'div role="main"', 'div class="entry-content"']
_NAV = ["nav", 'div class="menu"', 'ul class="nav"', 'div id="navigation"', 'div class="breadcrumb"', 'div role="navigation"', 'div class="navbar"']
_HEAD = ["header", 'div class="header"', 'div id="masthead"', 'div class="banner"', 'div class="topbar"']
_FOOT = ["footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer"', 'div class="copyright"']
_SIDE = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'div class="widget"', 'section class="recommended"', 'div class="popular"']
_NOTE = ['div class="cookie"', 'div class="notice"', 'div id="gdpr-banner"', 'div class="alert"', 'div class="cookie-consent"', 'div class="subscribe"', 'div class="newsletter"', 'div role="dialog"', 'div class="modal"']
_AD = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div id="ad-top"', 'aside class="sponsored"', 'div class="promo"', 'ins class="adsbygoogle"', 'div class="advertisement"']
_SHARE = ['div class="share"', 'div class="social"', 'ul class="share-buttons"', 'div class="tags"', 'div class="byline-links"', 'div class="pagination"', 'div class="popup"', 'div style="display:none"']
_TALK = ['div class="comments"', 'section id="comments"', 'div id="disqus"', 'ol class="comment-list"', 'div class="comment"', 'section class="reader-comments"', 'div class="responses"']


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def start(self) -> None:
        """A page's own language: syllables, frequent words, and how its sentences are punctuated."""
        r = self.r
        letters = "abcdefghijklmnopqrstuvwxyzéèàçñóíäöüß"
        self.syllables = ["".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 40))]
        self.frequent = [self.fresh() for _ in range(r.randint(2, 12))]
        self.gap = r.choice((" ", " ", " ", " ", " ", " | ", " - ", ", ", "### "))
        self.stop = r.choice((". ", ". ", ". ", " ", "! ", "? ", ", "))

    def fresh(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def word(self) -> str:
        return self.r.choice(self.frequent) if self.r.random() < 0.4 else self.fresh()

    def words(self, n: int, furniture: float = 0.0) -> str:
        return " ".join(self.r.choice(FURNITURE) if self.r.random() < furniture else self.word() for _ in range(n))

    def prose(self) -> str:
        n = self.r.choice((1, 2, 5, 12, 30, 60))
        text = self.stop.join(self.words(self.r.randint(1, n)).capitalize() for _ in range(self.r.choice((1, 1, 2, 5))))
        return text.replace(" ", self.gap) + self.r.choice((".", ".", ".", "", "!"))

    def wrap(self, tag: str, inside: str) -> str:
        return f"<{tag}>{inside}</{tag.split()[0]}>"

    def links(self, n: int) -> str:
        made = [f'<a href="/{self.word()}">{self.words(self.r.randint(1, 3), 0.3)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>" if self.r.random() < 0.7 else " | ".join(made)

    def article(self) -> str:
        out = []
        if self.r.random() < 0.8:
            title = self.words(self.r.randint(2, 12)) if self.r.random() < 0.4 else self.prose()[: self.r.choice((20, 60, 120))]
            out.append(self.wrap(self.r.choice(("h1", "h1", "h2")), title))
        style = self.r.random()
        for _ in range(self.r.choice((1, 2, 4, 8, 15))):
            k = self.r.random()
            if style < 0.08 and k < 0.8:
                out.append(self.wrap(self.r.choice(("div", 'div class="text"', "section")), self.prose()))
            elif style < 0.12 and k < 0.8:
                out.append(f"<span>{self.prose()}</span><br><br>")
            elif k < 0.7:
                p = self.prose()
                if self.r.random() < 0.2:
                    p = f"<b>{p}" + self.r.choice(("</b>", "<br>", "<br>"))
                if self.r.random() < 0.2:
                    p += f' <a href="/x">{self.word()}</a> {self.words(5)}.'
                out.append(f"<p>{p}" + ("</p>" if self.r.random() < 0.85 else ""))
            elif k < 0.78:
                out.append(self.wrap(self.r.choice(("h2", "h3")), self.words(4)))
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.prose()}</li>" for _ in range(self.r.randint(1, 4))) + "</ul>")
            elif k < 0.91:
                out.append(self.wrap("blockquote", self.wrap("p", self.prose())))
            elif k < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(self.wrap("pre", self.words(6)))
        return "".join(out)

    def page(self) -> str:
        """A page; a mark (character 2) stands where main text follows a tag."""
        r = self.r
        self.start()
        top, bottom = [], []
        filler = lambda: self.prose() if r.random() < 0.6 else self.words(r.randint(2, 10), 0.5)
        if r.random() < 0.5:
            top.append(self.wrap(r.choice(_HEAD), self.wrap(r.choice(("h1", "div", "p", "span")), self.words(3, 0.4)) + (self.links(3) if r.random() < 0.4 else "")))
        if r.random() < 0.85:
            top.append(self.wrap(r.choice(_NAV), self.links(r.randint(2, 8))))
        for _ in range(r.choice((0, 1, 1, 2))):
            (top if r.random() < 0.6 else bottom).append(self.wrap(r.choice(_AD), filler()))
        if r.random() < 0.4:
            (top if r.random() < 0.6 else bottom).append(self.wrap(r.choice(_NOTE), self.wrap("p", filler()) if r.random() < 0.5 else filler()))
        if r.random() < 0.5:
            (top if r.random() < 0.3 else bottom).append(self.wrap(r.choice(_SIDE), self.wrap("h3", self.words(2, 0.6)) + (self.links(4) if r.random() < 0.5 else self.wrap("p", filler()))))
        talk = lambda: self.wrap(r.choice(_TALK), self.wrap(r.choice(("h2", "h3", "p")), self.words(2, 0.7)) + "".join(self.wrap(r.choice(("p", "li", "div", "article", 'div class="comment-body"')), self.prose()) for _ in range(r.randint(1, 5))))
        if r.random() < 0.4:
            bottom.append(talk())
        if r.random() < 0.2:
            (top if r.random() < 0.4 else bottom).append(self.wrap(r.choice(_SHARE), self.links(3)))
        if r.random() < 0.25:
            (top if r.random() < 0.4 else bottom).append(self.wrap("form", self.wrap("label", self.words(2, 0.8)) + '<input type="text">' + self.wrap("p", filler())))
        if r.random() < 0.85:
            bottom.append(self.wrap(r.choice(_FOOT), f"&copy; {self.word()}.example &middot; {filler()}" if r.random() < 0.6 else self.wrap("p", filler()) + (self.links(3) if r.random() < 0.4 else "")))
        r.shuffle(bottom)
        body = re.sub(r">(?=[^<])", ">\x02", self.article())
        inner = ""
        extras = [lambda: self.wrap(r.choice(_AD), filler()), lambda: self.wrap(r.choice(_SIDE), self.wrap("p", filler())), lambda: self.wrap(r.choice(_NOTE), filler()), lambda: self.wrap(r.choice(_SHARE), self.links(3))]
        extras += [talk, lambda: self.wrap("form", self.wrap("label", self.words(2, 0.8)) + "<input>" + self.wrap("p", filler())), lambda: self.wrap("footer", self.wrap("p", filler())), lambda: self.wrap("nav", self.links(3))]
        for piece in extras:
            if r.random() < 0.08:
                made = piece()
                if r.random() < 0.5 and "</p>" in body:  # among the paragraphs
                    cut = body.index("</p>") + 4
                    body = body[:cut] + made + body[cut:]
                else:
                    inner += made
        main = self.wrap(r.choice(_MAIN), body + inner) if r.random() < 0.95 else body
        whole = "".join(top) + main + "".join(bottom)
        if r.random() < 0.3:
            whole = self.wrap(r.choice(('div class="wrapper"', 'div id="page"', 'div class="container"')), whole)
        head = f'<!DOCTYPE html><html lang="en"><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>'
        return head + whole + (r.choice(("</body></html>", "", "</html>")))


def labelled(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    make, x, y = Maker(seed), [], []
    for _ in range(n):
        b = blocks(make.page())
        y.append(np.array([float("\x02" in k.text) for k in b], np.float32))
        for k in b:
            k.text = " ".join(k.text.replace("\x02", "").split()) or "x"
            k.linked = min(k.linked, len(k.text))
        x.append(vectors(b))
    return x, y


def gradients(net: BiLSTM, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients by backpropagation through time in both directions."""
    k, g = net.hidden, {n: np.zeros_like(w) for n, w in net.w.items()}
    tapes: dict[str, list] = {"f": [], "b": []}
    h = np.concatenate([net.run(x, mask, d, tapes[d]) for d in "fb"], axis=2)
    p = _sigmoid(h @ net.w["o"] + net.w["p"])
    loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / mask.sum()
    e = mask * (p - y) / mask.sum()
    g["o"], g["p"] = np.einsum("nt,ntk->k", e, h), e.sum(keepdims=True).reshape(1)
    for n, d in enumerate("fb"):
        dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
        for s, h0, c0, i, f, o, q, c2, m in reversed(tapes[d]):
            dh = dh + e[:, s, None] * net.w["o"][n * k : (n + 1) * k]
            t = np.tanh(c2)
            a = m * dh
            dc2 = m * dc + a * o * (1 - t * t)
            z = np.concatenate((dc2 * q * i * (1 - i), dc2 * c0 * f * (1 - f), a * t * o * (1 - o), dc2 * i * (1 - q * q)), axis=1)
            g[f"x{d}"] += x[:, s].T @ z
            g[f"h{d}"] += h0.T @ z
            g[f"c{d}"] += z.sum(axis=0)
            dh = (1 - m) * dh + z @ net.w[f"h{d}"].T
            dc = (1 - m) * dc + dc2 * f
    return float(loss), g


def fit(pages: int = 20000, rounds: int = 7, batch: int = 64, rate: float = 0.01, seed: int = 5) -> BiLSTM:
    x, y = labelled(pages, seed)
    net, rng = BiLSTM(), np.random.default_rng(seed)
    m1, m2, step = {n: np.zeros_like(w) for n, w in net.w.items()}, {n: np.zeros_like(w) for n, w in net.w.items()}, 0
    for k in range(rounds):
        order = sorted(range(len(x)), key=lambda j: (len(x[j]), rng.random()))
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        rng.shuffle(groups)
        total = 0.0
        for some in groups:
            t = max(1, max(len(x[j]) for j in some))
            a, mask, b = np.zeros((len(some), t, x[0].shape[1]), np.float32), np.zeros((len(some), t), np.float32), np.zeros((len(some), t), np.float32)
            for r, j in enumerate(some):
                n = len(x[j])
                a[r, :n], mask[r, :n], b[r, :n] = x[j], 1, y[j]
            loss, g = gradients(net, a, mask, b)
            total += loss
            step += 1
            for n in net.w:
                m1[n] = 0.9 * m1[n] + 0.1 * g[n]
                m2[n] = 0.999 * m2[n] + 0.001 * g[n] ** 2
                net.w[n] = (net.w[n] - rate * 0.7**k * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"round {k}: loss {total / len(groups):.4f}", flush=True)
    return net


def accuracy(net: BiLSTM, pages: int = 500, seed: int = 99) -> float:
    x, y = labelled(pages, seed)
    p = net.chances(x)
    return float(np.mean(np.concatenate([(a >= 0.5) == (b > 0.5) for a, b in zip(p, y)])))


if __name__ == "__main__":
    made = fit()
    print("held-out blocks right:", accuracy(made))
    made.save(os.path.join(os.path.dirname(os.path.abspath(__file__)), "htmlblocks.npz"))
