"""Trains the block labeller on pages written by a seeded generator: python -m tarnbridge.llm.train_blocks

The generator deals out many page layouts (with and without sectioning elements, with class names of many kinds), puts
furniture before, between and after the article's blocks, and draws all words at random, so only tags, names, shapes
and neighbourhood tell blocks apart. Every page is parsed by the extractor's own parser; a mark in each block's text
says whether it is part of the article.
"""

from __future__ import annotations

import sys

import numpy as np

from .html_blocks import DIM, HIDDEN, WEIGHTS, Block, blocks, lstm, padded, scores, vectors

SYLLABLES = "the an er on re ti in es ed ou th ing de la que le eau ent ión cia os der ung ein sch ver be zu ar mo ka lo su".split()
FURNITURE = {
    "nav": ["nav", "div.menu", "div.navbar", "ul.nav", "div#navigation", "div.breadcrumb", "div.main-menu", "div.topbar", "nav.pagination", "div.tabs", "div.toc"],
    "header": ["header", "div.header", "div#header", "div.masthead", "div.site-header", "div.banner", "div.logo"],
    "footer": ["footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.legal", "div.bottom"],
    "side": ["aside", "div.sidebar", "div#sidebar", "div.related", "div.widget", "section.recommended", "div.share", "div.social", "div.author-box", "div.tags", "div.promo", "div.trending", "div.newsletter"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div#banner-ad", "ins.adsbygoogle", "section.ad", "aside.ad", "p.ad", "div.ad-slot"],
    "notice": ["div.notice", "div.cookie", "div.cookie-banner", "div.alert", "div.gdpr", "div.popup", "div.modal", "div.consent", "div.paywall", "section.notice", "p.notice", "div.disclaimer", "div.subscribe"],
    "form": ["form", "form.search", "form.login", "div.search-form", "fieldset", "form.newsletter"],
    "comments": ["section.comments", "div.comments", "div#comments", "ol.comment-list", "div.comment", "ul.comments", "div.responses", "div.discussion", "div#disqus_thread", "section#comments", "div.replies"],
}
MAIN = ["article", "main", "div.content", "div.post", "div#content", "div.article", "div.entry-content", "div.story", "section.article-body", "div.post-body", "main.content", "article.post", "div.text", "div.main", "section", "div"]


class Writer:
    """Writes one page; '@1@' marks the article's blocks, '@0@' all others."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.out = rng, []

    def pick(self, options):
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        out = ["".join(self.pick(SYLLABLES) for _ in range(self.rng.integers(1, 5))) for _ in range(n)]
        out[0] = out[0].capitalize()
        return " ".join(w + (self.pick([",", ".", ".", ";"]) if self.chance(0.1) else "") for w in out)

    def tag(self, spec: str) -> tuple[str, str]:
        name, rest = spec, ""
        for mark, attr in ((".", "class"), ("#", "id")):
            if mark in name:
                name, _, value = name.partition(mark)
                rest = f' {attr}="{value}"'
        return f"<{name}{rest}>", f"</{name}>"

    def block(self, tag: str, main: int, lo: int, hi: int, close: float = 0.9, link: float = 0.0) -> None:
        text = self.words(lo, hi) + self.pick([".", ".", "", "!"])
        if self.chance(link):
            text = f'<a href="/x">{text}</a>'
        elif self.chance(0.2):
            text = f"<b>{text}" + ("</b>" if self.chance(0.6) else "")
        elif self.chance(0.2):
            text = text.replace(" ", " <a href='#'>", 1).replace(".", "</a>.", 1) if "." in text else text
        if self.chance(0.1):
            text += "<br>"
        start, end = self.tag(tag)
        self.out.append(f"{start}@{main}@ {text}" + (end if self.chance(close) or tag not in ("p", "li") else ""))

    def furniture(self, kind: str) -> None:
        start, end = self.tag(self.pick(FURNITURE[kind]))
        self.out.append(start)
        prose = self.chance(0.5)  # furniture may read like the article
        if kind == "nav" or (kind in ("header", "footer", "side") and self.chance(0.4)):
            wrap = self.chance(0.8)
            self.out.append("<ul>" if wrap else "")
            for _ in range(self.rng.integers(2, 9)):
                self.block("li" if wrap else self.pick(["span", "div", "p"]), 0, 1, 3, link=0.9)
            self.out.append("</ul>" if wrap else "")
        elif kind == "form":
            for _ in range(self.rng.integers(1, 4)):
                self.block(self.pick(["label", "p", "div", "legend"]), 0, 1, 30 if prose else 4)
                self.out.append('<input type="text">')
            self.block("button", 0, 1, 2)
        elif kind == "comments":
            self.block(self.pick(["h2", "h3", "p"]), 0, 1, 4)
            for _ in range(self.rng.integers(1, 7)):
                inner = self.chance(0.6)
                self.out.append(self.tag(self.pick(["div.comment", "li.comment", "article.comment", "div.comment-body"]))[0] if inner else "")
                self.block(self.pick(["p", "div", "span"]), 0, 2, 60)
                if self.chance(0.3):
                    self.block(self.pick(["p", "div", "blockquote"]), 0, 3, 60)
                if inner:
                    self.out.append("</div>" if "div" in self.out[-4] or "div" in self.out[-3] else "</li>")
        else:
            for _ in range(self.rng.integers(1, 4)):
                bare = self.chance(0.4)
                if bare:
                    self.out.append(f"@0@ {'&copy; ' if kind == 'footer' else ''}{self.words(3, 40 if prose else 8)}.")
                    break
                self.block(self.pick(["p", "div", "h3", "span", "li"]), 0, 2, 50 if prose else 8, link=0.2)
        self.out.append(end)

    def article(self) -> None:
        outer = self.chance(0.3)
        if outer:
            self.out.append(self.pick(["<main>", '<div class="container">', '<div id="page">', '<div class="wrapper">']))
        start, end = self.tag(self.pick(MAIN) if self.chance(0.6) else "article")
        self.out.append(start)
        if self.chance(0.8):
            head = self.chance(0.15)
            self.out.append("<header>" if head else "")
            self.block(self.pick(["h1", "h1", "h1", "h2"]), 1, 2, 14)
            self.out.append("</header>" if head else "")
        for _ in range(self.rng.integers(1, 12)):
            r = self.rng.random()
            if r < 0.72:
                self.block("p", 1, 2, 120, 0.85)
            elif r < 0.78:
                self.block(self.pick(["h2", "h3"]), 1, 1, 8)
            elif r < 0.84:
                self.out.append(self.pick(["<ul>", "<ol>"]))
                for _ in range(self.rng.integers(1, 5)):
                    self.block("li", 1, 2, 25)
                self.out.append("</ul></ol>")
            elif r < 0.88:
                self.out.append("<blockquote>")
                self.block("p", 1, 4, 50)
                self.out.append("</blockquote>")
            elif r < 0.90:
                self.out.append(f"<pre>@1@ {self.words(3, 30)}</pre>")
            elif r < 0.92:
                self.out.append("<table><tr>")
                for _ in range(self.rng.integers(1, 5)):
                    self.block("td", 1, 1, 8)
                self.out.append("</tr></table>")
            elif r < 0.94:
                self.out.append("<figure><img src='x'>")
                self.block("figcaption", 1, 3, 15)
                self.out.append("</figure>")
            elif r < 0.97:
                self.block(self.pick(["div", "section"]), 1, 5, 60)
            else:
                self.furniture(self.pick(["ad", "side", "notice", "form", "ad"]))
        if self.chance(0.12):
            self.furniture(self.pick(["footer", "comments", "side"]))
        self.out.append(end)
        self.out.append("</div></main>" if outer else "")

    def page(self) -> str:
        self.out.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        for kind, p in (("notice", 0.3), ("header", 0.4), ("nav", 0.8), ("form", 0.2), ("ad", 0.6), ("side", 0.2)):
            if self.chance(p):
                self.furniture(kind)
        self.article()
        for kind, p in (("ad", 0.2), ("comments", 0.35), ("side", 0.4), ("form", 0.2), ("notice", 0.2), ("footer", 0.85)):
            if self.chance(p):
                self.furniture(kind)
        self.out.append("</body></html>")
        return "".join(self.out)


def example(rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    found, labels = [], []
    for b in blocks(Writer(rng).page()):
        marks = [m for m in ("@0@", "@1@") if m in b.text]
        if len(marks) == 1:
            text = b.text.replace(marks[0], "").strip()
            if text:
                found.append(Block(b.path, " ".join(text.split()), b.linked))
                labels.append(marks[0] == "@1@")
    return found, np.array(labels, np.float32)


def _gradients(x, mask, y, w) -> tuple[float, dict[str, np.ndarray]]:
    runs = {d: lstm(x, mask, w["w" + d], w["u" + d], w["b" + d], d == "b") for d in "fb"}
    h = np.concatenate([np.stack([s[-1] for s in runs[d]]) for d in "fb"], axis=2)
    p = 1 / (1 + np.exp(-np.clip(h @ w["v"] + x @ w["s"] + w["c"], -30, 30)))
    m, total = mask[:, :, 0], mask.sum()
    loss = -(m * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total
    dz = m * (p - y) / total
    g = {"v": np.einsum("tn,tnh->h", dz, h), "s": np.einsum("tn,tnd->d", dz, x), "c": dz.sum(keepdims=False).reshape(())}
    for k, d in enumerate("fb"):
        dh_out = dz[:, :, None] * w["v"][k * HIDDEN : (k + 1) * HIDDEN]
        steps = len(x)
        dh = np.zeros((x.shape[1], HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        gu, dpre = np.zeros_like(w["u" + d]), np.zeros((steps, x.shape[1], 4 * HIDDEN), np.float32)
        for t in range(steps) if d == "b" else range(steps - 1, -1, -1):
            h0, c0, i, f, o, gg, tc, mm, _ = runs[d][t]
            dh = dh + dh_out[t]
            dnew = mm * dh
            dc2 = mm * dc + dnew * o * (1 - tc * tc)
            z = np.concatenate([dc2 * gg * i * (1 - i), dc2 * c0 * f * (1 - f), dnew * tc * o * (1 - o), dc2 * i * (1 - gg * gg)], axis=1)
            dpre[t] = z
            gu += h0.T @ z
            dh = z @ w["u" + d].T + (1 - mm) * dh
            dc = dc2 * f + (1 - mm) * dc
        g["u" + d], g["w" + d], g["b" + d] = gu, np.einsum("tnd,tnz->dz", x, dpre, optimize=True), dpre.sum(axis=(0, 1))
    return float(loss), g


def train(pages: int = 3000, epochs: int = 5, batch: int = 48, seed: int = 5, rate: float = 0.01) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {"v": np.zeros(2 * HIDDEN), "s": np.zeros(DIM), "c": np.zeros(())}
    for d in "fb":
        w |= {"w" + d: rng.normal(0, 0.1, (DIM, 4 * HIDDEN)), "u" + d: rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), "b" + d: np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    w["v"] = rng.normal(0, 0.3, 2 * HIDDEN)
    w = {k: a.astype(np.float32) for k, a in w.items()}
    data = [(vectors(b), y) for b, y in (example(rng) for _ in range(pages)) if len(b)]
    first, second, n = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        losses = []
        for at in range(0, len(order), batch):
            some = [data[k] for k in order[at : at + batch]]
            x, mask = padded([v for v, _ in some])
            y = np.zeros(mask.shape[:2], np.float32)
            for k, (_, marks) in enumerate(some):
                y[: len(marks), k] = marks
            loss, g = _gradients(x, mask, y, w)
            losses.append(loss)
            n += 1
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - rate * (0.5**epoch) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {np.mean(losses):.4f}", file=sys.stderr)
    return w


def accuracy(w: dict[str, np.ndarray], pages: int = 400, seed: int = 99) -> tuple[float, float]:
    """Shares of blocks and of pages labelled rightly, on pages of another seed."""
    rng = np.random.default_rng(seed)
    data = [example(rng) for _ in range(pages)]
    found = scores([vectors(b) for b, _ in data], w)
    right = [((p >= 0.5) == y) for p, (_, y) in zip(found, data, strict=True) if len(y)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    trained = train()
    print("blocks, pages right on held-out pages:", accuracy(trained))
    np.savez_compressed(WEIGHTS, **{k: a.astype(np.float16) for k, a in trained.items()})
