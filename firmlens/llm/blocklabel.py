"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block gives a vector of hashed tag-path words, hashed text words and a few measures;
a bidirectional LSTM reads the whole sequence both ways and says for every block whether it belongs to the article.

There are no labelled pages, so the model is trained on pages whose labels are known because they were laid out for it: the
texts of a bounded sample of the input's pages, set into random layouts with marked article blocks.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm import lstm
from firmlens.llm.pageblocks import Block, blocks

PATH_SLOTS, WORD_SLOTS, MEASURES = 800, 48, 10
HIDDEN, ROUNDS, BATCH, RATE, SEED = 24, 8, 32, 0.01, 11
#: pages whose texts fill the training layouts, at most, and layouts trained on
SAMPLE_PAGES, LAYOUTS, SAMPLE_CHARS = 200, 1000, 20_000
#: blocks that are scored together; longer pages are scored alone
SCORED = 20_000
#: tag paths whose projection a task keeps
PATHS_KEPT = 20_000
#: private-use character in front of article texts in training layouts
MARK = "\ue000"
_TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+")


def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % slots


@lru_cache(maxsize=1 << 14)
def _names(tag: str, words: tuple[str, ...], place: str) -> tuple[int, ...]:
    names = [f"{place}t{tag}"] + [f"{place}w{w}" for w in words] + [f"{place}p{w[:5]}" for w in words if len(w) > 5]
    return tuple(_slot(n, PATH_SLOTS) for n in names)


def path_slots(path: tuple) -> list[int]:
    """Slots of a tag path: every ancestor's tag and names, and once more those of the two innermost."""
    found = {slot for tag, words in path for slot in _names(tag, words, "a")}
    return sorted(found.union(slot for tag, words in path[-2:] for slot in _names(tag, words, "i")))


def text_features(page: list[Block]) -> np.ndarray:
    """(blocks, word slots and measures) of one page."""
    out = np.zeros((len(page), WORD_SLOTS + MEASURES), np.float32)
    crc = zlib.crc32
    for row, block in enumerate(page):
        text, n = block.text, len(block.text)
        words = _TOKEN.findall(text.lower().encode("utf-8", "surrogatepass"))
        if words:
            hashed = np.bincount([crc(w) % WORD_SLOTS for w in words], minlength=WORD_SLOTS)
            out[row, :WORD_SLOTS] = np.sqrt(hashed / len(words))
        out[row, WORD_SLOTS:] = (
            math.log1p(n) / 8,
            math.log1p(len(words)) / 6,
            min(1.0, block.linked / n),
            sum(map(text.count, ".,;:!?")) * 10 / n,
            text[-1] in ".!?:;\"'”»)",
            sum(map(text.count, "0123456789")) / n,
            text[:1].isupper(),
            row / len(page),
            1 / (1 + row),
            1 / (len(page) - row),
        )
    return out


def features(page: list[Block]) -> np.ndarray:
    """(blocks, inputs) of one page: path slots, word slots, measures."""
    paths = np.zeros((len(page), PATH_SLOTS), np.float32)
    for row, block in enumerate(page):
        paths[row, path_slots(block.path)] = 1
    return np.hstack([paths, text_features(page)])


class Labeller:
    """A fitted model. Pages repeat their tag paths, so each path is multiplied with the input weights once."""

    def __init__(self, weights: lstm.Weights):
        self.weights = weights
        self._inputs, self._bias = lstm.input_weights(weights)
        self._paths: dict[tuple, np.ndarray] = {}

    def _path(self, path: tuple) -> np.ndarray:
        found = self._paths.get(path)
        if found is None:
            if len(self._paths) >= PATHS_KEPT:
                self._paths.clear()
            found = self._paths[path] = self._inputs[path_slots(path)].sum(axis=0) + self._bias
        return found

    def __call__(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of every block of every page (none without blocks)."""
        dense = [text_features(p) @ self._inputs[PATH_SLOTS:] for p in pages]
        return lstm.predict_projected([d + np.array([self._path(b.path) for b in p]) for d, p in zip(dense, pages)], self.weights)


# ---- layouts for training ---------------------------------------------------------------------------------------------

#: names that pages give to their parts
MAIN = "content article post entry main story body text page maincontent hentry blog news detail read".split()
NOISE = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav submenu tabs links pagination pager skip toc".split(),
    "header": "header header masthead topbar banner logo branding site title top hero toolbar".split(),
    "footer": "footer footer bottom colophon copyright legal imprint credits foot contentinfo contentinfo".split(),
    "sidebar": "sidebar side aside rail widget column related recommended popular trending more teaser right left secondary complementary".split(),
    "notice": "cookie consent notice gdpr privacy alert message popup modal overlay warning disclaimer banner info dialog paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adsbox commercial dfp outbrain taboola partner affiliate".split(),
    "form": "form newsletter subscribe signup search login contact register poll survey".split(),
    "comments": "comments comment commentlist respond reply replies discussion disqus responses reviews thread feedback".split(),
    "share": "share social sharing follow tags tools print buttons meta".split(),
}
HEADINGS = {
    "comments": ["Comments", "3 comments", "Leave a reply", "Kommentare", "Commentaires", "Comentarios", "Discussion"],
    "sidebar": ["Related", "Most read", "More stories", "Archive", "Artikel", "Lire aussi", "Popular"],
    "notice": ["We use cookies.", "Accept", "Cookies", "This site uses cookies."],
    "form": ["Subscribe", "Search", "Newsletter", "E-Mail", "Your name", "Sign up"],
    "advert": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Ad"],
    "footer": ["© 2024", "Terms", "Privacy", "Contact", "All rights reserved."],
    "menu": ["Home", "About", "News", "Contact", "Skip to content"],
    "header": ["Home", "Log in", "Daily News"],
    "share": ["Share", "Tweet", "Print", "Facebook"],
}


class Layout:
    """One random page around given texts; article texts carry MARK."""

    def __init__(self, rng: random.Random, texts: list[str]):
        self.rng, self.texts = rng, texts

    def _name(self, names: list[str]) -> str:
        r = self.rng
        name = r.choice(names)
        if r.random() < 0.4:
            name = r.choice(["{}-wrapper", "{}-area", "site-{}", "{}-box", "page-{}", "{}-1", "{}_inner", "{}-list", "js-{}", "{}-item", "{}-container", "{}-section"]).format(name)
        if names is not MAIN and r.random() < 0.25:
            name = r.choice([*MAIN, "reader", "user", "top", "block"]) + r.choice("-_") + name
        if r.random() < 0.2:
            name += " " + r.choice(["clearfix", "row", "col", "box", "block", "container", "inner", "wrap", "fade", "visible"])
        return name

    def _attrs(self, names: list[str]) -> str:
        return f' {self.rng.choice(["class", "class", "class", "id", "id", "role"])}="{self._name(names)}"'

    def _text(self, low: int, high: int, ends: bool = False) -> str:
        text = self.rng.choice(self.texts)
        words = text.split()
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(words) - n + 1))
        text = " ".join(words[at : at + n]) or "text"
        return html_lib.escape(text.rstrip(".,;") + "." if ends else text, quote=False)

    def paragraph(self, mark: str) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.55:
            text = self._text(8, 90, True)
            if r.random() < 0.2:
                text = text.replace(" ", ' <a href="/x">', 1) + "</a>" if r.random() < 0.3 else f"{text} <a href='#'>{self._text(1, 3)}</a> {self._text(3, 20, True)}"
            return f"<p>{mark}{text}</p>"
        if kind < 0.65:
            return f"<p>{mark}{self._text(1, 7, r.random() < 0.7)}</p>"
        if kind < 0.72:
            return f"<p><b>{mark}{self._text(2, 60, True)}<br>"
        if kind < 0.8:
            level = r.choice("2234")
            return f"<h{level}>{mark}{self._text(1, 9)}</h{level}>"
        if kind < 0.86:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{mark}{self._text(2, 25)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>"
        if kind < 0.9:
            return f"<blockquote>{mark}{self._text(8, 40, True)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{mark}{self._text(8, 40, True)}</p></blockquote>"
        if kind < 0.94:
            return f"<div>{mark}{self._text(8, 60, True)}</div>"
        if kind < 0.96:
            return f"<pre>{mark}{self._text(5, 30)}</pre>"
        return "<table>" + "".join(f"<tr><td>{mark}{self._text(1, 5)}</td><td>{mark}{self._text(1, 5)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"

    def links(self) -> str:
        r = self.rng
        texts = [f'<a href="/{i}">{self._text(1, r.choice([1, 2, 8]))}</a>' for i in range(r.randint(2, 9))]
        kind = r.random()
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(texts) if kind < 0.85 else "".join(f"<div>{t}</div>" for t in texts)

    def noise(self, kind: str) -> str:
        r = self.rng
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        native = tag != "div" and tag != "section" and r.random() < 0.5
        tag = tag if native else r.choice(["div", "div", "div", "section", "ul" if kind == "menu" else "div"])
        attrs = "" if native and r.random() < 0.6 else self._attrs(NOISE[kind])
        inside = []
        if r.random() < 0.5 and kind in HEADINGS:
            inside.append(f"<{(h := r.choice(['h2', 'h3', 'h4', 'p', 'span', 'div', 'strong']))}>{r.choice(HEADINGS[kind])}</{h}>")
        if kind == "menu":
            inside.append(self.links())
        elif kind == "header":
            inside.append(r.choice([f"<h1>{self._text(1, 6)}</h1>", f"<a href='/'>{self._text(1, 3)}</a>", f"<p>{self._text(3, 12)}</p>", self.links()]))
        elif kind == "footer":
            inside.append(r.choice([f"&copy; {self._text(2, 14)}", f"<p>{self._text(5, 40, True)}</p>", self.links(), f"&copy; example.org &middot; {self._text(2, 30, True)}"]))
        elif kind == "sidebar":
            inside += r.choices([self.links(), f"<p>{self._text(5, 60, True)}</p>", f"<div>{self._text(3, 30)}</div>", f"<h3>{self._text(1, 5)}</h3>"], k=r.randint(1, 4))
        elif kind in ("notice", "advert"):
            inside.append(r.choice([self._text(3, 40, True), f"<p>{self._text(3, 40, True)}</p>", f"<a href='#'>{self._text(2, 12)}</a>", f"<p>{self._text(5, 30)}</p><button>{self._text(1, 2)}</button>"]))
        elif kind == "form":
            inside.append(f"<label>{self._text(1, 4)}</label><input name=q>" + r.choice(["", f"<p>{self._text(4, 25, True)}</p>", f"<select><option>{self._text(1, 2)}<option>{self._text(1, 2)}</select>"]) + f"<button>{self._text(1, 2)}</button>")
            if tag != "form" and r.random() < 0.6:
                inside = ["<form action='/s'>", *inside, "</form>"]
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                text = f"<p>{self._text(3, 60, True)}</p>" if r.random() < 0.7 else self._text(3, 60, True)
                who = r.choice(["", f"<b>{self._text(1, 2)}</b>", f"<span class='author'>{self._text(1, 2)}</span> ", f"<cite>{self._text(1, 2)}</cite>"])
                item = r.choice(["div", "li", "article", "article"])
                inside.append(f"<{item}{self._attrs(NOISE['comments']) if r.random() < 0.5 else ''}>{who}{text}</{item}>")
        else:
            inside.append(self.links())
        return f"<{tag}{attrs}>{''.join(inside)}</{tag}>"

    def page(self) -> str:
        r = self.rng
        title = self._text(2, 12)
        depth = r.choice([0, 1, 1, 1, 1, 2, 3])
        body = []
        if r.random() < 0.8:
            heading = f"<h1>{MARK}{title}</h1>"
            around = r.choice([" class='entry-header'", " class='post-header'", " class='article-title'", ""])
            tag = r.choice(["header", "header", "div"])
            body.append(f"<{tag}{around}>{heading}</{tag}>" if depth and r.random() < 0.3 else heading)
            if r.random() < 0.3:
                body.append(self.paragraph(MARK) if r.random() < 0.3 else f"<p><b>{MARK}{title}<br>")
        for _ in range(r.choice([0, 1, 2, 4, 8, 12, 20])):
            body.append(self.paragraph(MARK))
            if r.random() < 0.08:
                body.append(self.noise(r.choice(["advert", "share", "sidebar", "form", "notice"])))
        body.append(f"<p>{MARK}{self._text(5, 60, True)}</p>")
        if r.random() < 0.25:
            body.append(self.noise(r.choice(["comments", "share", "sidebar", "form", "advert"])))
        main = "".join(body)
        for _ in range(depth):
            tag = r.choice(["article", "article", "main", "div", "div", "section"])
            attrs = "" if tag in ("article", "main") and r.random() < 0.7 else self._attrs(MAIN)
            main = f"<{tag}{attrs}>{main}</{tag}>"
        bare = r.random() < 0.06
        before = [] if bare else [self.noise(k) for k in ("header", "menu", "notice", "advert", "menu", "form", "sidebar") if r.random() < (0.7 if k in ("header", "menu") else 0.3)]
        after = [] if bare else [self.noise(k) for k in ("share", "comments", "sidebar", "advert", "sidebar", "form", "notice", "menu", "footer") if r.random() < (0.75 if k == "footer" else 0.35)]
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.2:
            r.shuffle(after)
        inner = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            inner = f"<div{self._attrs(['wrapper', 'page', 'container', 'site', 'app', 'root'])}>{inner}</div>"
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{inner}</body></html>"


def training_set(texts: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = random.Random(seed)
    inputs, labels = [], []
    for _ in range(layouts):
        page = blocks(Layout(rng, texts).page())
        truth = np.array([b.text.startswith(MARK) for b in page], np.float32)
        for b in page:
            b.text = b.text.replace(MARK, "").strip() or "."
        inputs.append(features(page))
        labels.append(truth)
    return inputs, labels


def sample_texts(pages: DataFrame, key: Column, html: Column, most: int = SAMPLE_PAGES) -> list[str]:
    """Block texts of at most ``most`` pages, those whose key has the smallest hash; at most SAMPLE_CHARS of each page."""
    keys = [r.h for r in pages.select(F.xxhash64(key).alias("h")).orderBy("h").limit(most).collect()]
    if not keys:
        return []
    rows = pages.select(F.xxhash64(key).alias("h"), F.substring(html, 1, SAMPLE_CHARS).alias("html")).where(F.col("h") <= keys[-1]).orderBy("h", F.xxhash64("html")).limit(most).collect()
    return [b.text for r in rows for b in blocks(r.html)]


def fit(texts: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> lstm.Weights:
    """Weights from layouts around the texts (single words if there is none)."""
    texts = [t for t in (t.replace(MARK, "") for t in texts) if t.strip()] or ["some words of a page that has no text of its own"]
    inputs, labels = training_set(texts, layouts, seed)
    return lstm.train(inputs, labels, HIDDEN, ROUNDS, BATCH, RATE, seed)


def main_texts(htmls: list[str | None], weights: lstm.Weights) -> list[str]:
    """Article text of each page: its positive blocks in page order, one line each."""
    label = Labeller(weights)
    pages = [blocks(h) for h in htmls]
    out = [""] * len(pages)
    todo = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while todo:
        group = [todo.pop()]
        while todo and (len(group) + 1) * len(pages[group[0]]) <= SCORED:
            group.append(todo.pop())
        for i, found in zip(group, label([pages[i] for i in group])):
            out[i] = "\n".join(b.text for b, p in zip(pages[i], found) if p >= 0.5)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", text_col: str = "text", sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> DataFrame:
    """``pages`` with the main text in ``text_col`` (replaced if there). Null html and pages without a block give the empty text.

    The model is fitted on the driver from a bounded sample of pages (``sample``) in a bounded number of layouts; it is a few
    hundred kilobytes and goes to the tasks with the function. Every page is read whole. Repeated rows give repeated results, an
    empty table an empty one.
    """
    weights = fit(sample_texts(pages, F.col(id_col), F.col(html_col), sample), layouts)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series(main_texts([h if isinstance(h, str) else None for h in htmls], weights), dtype=object)

    return pages.withColumn(text_col, of(F.col(html_col)))
