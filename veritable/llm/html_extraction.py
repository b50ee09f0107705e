"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks. Each block becomes a vector of hashed tag-path features, hashed
words and a few figures; a bidirectional LSTM in numpy reads the sequence in both directions, so
every block is classified with the whole page as context. Blocks that are judged main text are
joined by one blank.

The labeller is trained on layouts composed from the texts of a bounded sample of the pages:
menus, page headers, footers, sidebars, notices, adverts, forms, share bars and reader comments
in varied markup around and inside an article, whose blocks are the ones to keep. The bounds are
SAMPLE_PAGES and TRAIN_PAGES; every page is then read whole.

Defined cases: a null or empty page has no blocks and its text is empty. Repeated rows give
repeated rows; an empty table gives none and trains on built-in words. Other columns are
ignored. Training is seeded; the sample is the pages of least address hash.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.html_blocks import BLOCK, Block, Path, blocks
from veritable.llm.shared import slices

SAMPLE_PAGES = 200
TRAIN_PAGES = 1400
PATH_FEATURES = 2048
WORD_FEATURES = 128
FIGURES = 8
HIDDEN = 24
EPOCHS = 12
BATCH_PAGES = 32
_CELLS = 40_000


@lru_cache(maxsize=1 << 16)
def _word_slot(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_FEATURES


@lru_cache(maxsize=1 << 14)
def _own_slots(tag: str, names: tuple[str, ...]) -> frozenset[int]:
    return frozenset(zlib.crc32(t.encode()) % PATH_FEATURES for t in [f"t:{tag}", *(f"n:{word}" for word in names)])


@lru_cache(maxsize=1 << 14)
def _near_slots(near: tuple, last: tuple[str, ...]) -> frozenset[int]:
    tokens = {f"{k}:{word}" for k, (tag, names) in enumerate(near) for word in (tag, *names)} | {"/".join(last)}
    return frozenset(zlib.crc32(t.encode()) % PATH_FEATURES for t in tokens)


def _path_slots(path: Path) -> tuple[int, ...]:
    """Slots of a tag path: each tag and name word, the innermost ones with their distance too.

    Sets of outer tags are kept with the path and shared where an inner tag adds nothing to them.
    """
    todo, node = [], path
    while node.depth and node.slots is None:
        todo.append(node)
        node = node.outer
    every = (node.slots or (frozenset(),))[0]
    for node in reversed(todo):
        own = _own_slots(node.tag, node.names)
        every = every if own <= every else every | own
        node.slots = (every, None)
    if not path.depth or path.slots[1] is None:
        last = () if not path.depth else (path.tag,) if path.depth == 1 else (path.outer.tag, path.tag)
        slots = tuple(sorted(every | _near_slots(path.near, last)))
        if not path.depth:
            return slots
        path.slots = (every, slots)
    return path.slots[1]


def features(page: Sequence[Block]) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """For each block its path's slots, and its hashed words and figures."""
    at: list[int] = []
    weight: list[np.ndarray] = []
    figures = np.empty((len(page), FIGURES), np.float32)
    for k, block in enumerate(page):
        words = block.text.split(" ")
        base = k * WORD_FEATURES
        at += [base + _word_slot(w) for w in words]
        weight.append(np.full(len(words), 1.0 / len(words)))
        size, text = len(block.text), block.text
        signs = text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(";") + text.count(":")
        figures[k] = (
            np.log1p(size) / 8, np.log1p(len(words)) / 6, min(block.linked / size, 1.0), min(size / len(words) / 12, 2.0),
            signs / (len(words) + 1), k / max(len(page) - 1, 1), block.path.depth / 12, 1.0,
        )
    bag = np.bincount(at, weights=np.concatenate(weight), minlength=len(page) * WORD_FEATURES).reshape(len(page), WORD_FEATURES)
    return [_path_slots(b.path) for b in page], np.concatenate([bag.astype(np.float32), figures], axis=1)


class Batch:
    """Pages padded to the longest: which cells are blocks, their distinct paths, and their other features."""

    def __init__(self, pages: list[tuple]) -> None:
        sizes = np.array([len(paths) for paths, _ in pages])
        self.mask = np.arange(sizes.max()) < sizes[:, None]
        self.known: dict[tuple, int] = {}
        self.which = np.array([self.known.setdefault(path, len(self.known)) for paths, _ in pages for path in paths])
        self.dense = np.concatenate([dense for _, dense in pages])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs over a page's blocks, one in each direction, and a logistic output on their states and the block itself."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        inputs = PATH_FEATURES + WORD_FEATURES + FIGURES
        self.weights = {}
        for side in "fb":
            self.weights[f"x{side}"] = (rng.normal(size=(inputs, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.weights[f"h{side}"] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / HIDDEN**0.5).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.weights[f"b{side}"] = bias
        self.weights["o"] = (rng.normal(size=2 * HIDDEN) * 0.1).astype(np.float32)
        self.weights["s"] = np.zeros(inputs, np.float32)
        self.weights["d"] = np.zeros(1, np.float32)

    def _run(self, side: str, given: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States of one direction from each block's input; steps beyond a page's end leave its state as it is."""
        pages, steps, _ = given.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, tape = np.zeros((pages, steps, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ self.weights[f"h{side}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = f * c + i * g
            reach = np.tanh(new)
            tape.append((t, h, c, i, f, o, g, reach, m))
            h, c = np.where(m, o * reach, h), np.where(m, new, c)
            out[:, t] = h
        return out, tape

    def _given(self, side: str, batch: Batch) -> np.ndarray:
        """Input of each block: its path's weights, summed once for each distinct path, and its words' and figures'."""
        weights = self.weights[f"x{side}"]
        summed = np.stack([weights[list(path)].sum(axis=0) for path in batch.known])
        out = np.zeros((*batch.mask.shape, 4 * HIDDEN), np.float32)
        out[batch.mask] = summed[batch.which] + batch.dense @ weights[PATH_FEATURES:] + self.weights[f"b{side}"]
        return out

    def scores(self, pages: list[tuple]) -> np.ndarray:
        """How sure each block of each page is main text; zero-padded beyond a page's end."""
        batch = Batch(pages)
        states = np.concatenate([self._run(side, self._given(side, batch), batch.mask)[0] for side in "fb"], axis=2)
        return self._sure(batch, states)

    def _sure(self, batch: Batch, states: np.ndarray) -> np.ndarray:
        own = np.zeros(batch.mask.shape, np.float32)
        direct = self.weights["s"]
        of_path = np.array([direct[list(path)].sum() for path in batch.known], np.float32)
        own[batch.mask] = of_path[batch.which] + batch.dense @ direct[PATH_FEATURES:]
        return _sigmoid(states @ self.weights["o"] + own + self.weights["d"])

    def gradient(self, batch: Batch, y: np.ndarray) -> dict[str, np.ndarray]:
        mask = batch.mask
        forward, tape_f = self._run("f", self._given("f", batch), mask)
        backward, tape_b = self._run("b", self._given("b", batch), mask)
        states = np.concatenate([forward, backward], axis=2)
        error = (self._sure(batch, states) - y) * mask / mask.sum()
        direct = np.zeros_like(self.weights["s"])
        for path, grad in zip(batch.known, np.bincount(batch.which, weights=error[mask], minlength=len(batch.known))):
            direct[list(path)] += grad
        direct[PATH_FEATURES:] = error[mask] @ batch.dense
        grads = {"s": direct, "o": np.tensordot(error, states, ((0, 1), (0, 1))), "d": error.sum(keepdims=True).reshape(1)}
        back = error[:, :, None] * self.weights["o"]
        for side, tape, outer in (("f", tape_f, back[:, :, :HIDDEN]), ("b", tape_b, back[:, :, HIDDEN:])):
            into = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros_like(tape[0][1]), np.zeros_like(tape[0][1])
            recurrent = np.zeros_like(self.weights[f"h{side}"])
            for t, h, c, i, f, o, g, reach, m in reversed(tape):
                dh = dh + outer[:, t]
                own_h = np.where(m, dh, 0)
                own_c = np.where(m, dc, 0) + own_h * o * (1 - reach**2)
                dz = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * reach * o * (1 - o), own_c * i * (1 - g**2)], axis=1)
                into[:, t] = dz
                recurrent += h.T @ dz
                dh = np.where(m, 0, dh) + dz @ self.weights[f"h{side}"].T
                dc = np.where(m, own_c * f, dc)
            flat = into[mask]
            of_path = np.zeros((len(batch.known), 4 * HIDDEN), np.float32)
            np.add.at(of_path, batch.which, flat)
            inputs = np.zeros_like(self.weights[f"x{side}"])
            for path, grad in zip(batch.known, of_path):
                inputs[list(path)] += grad
            inputs[PATH_FEATURES:] = batch.dense.T @ flat
            grads[f"x{side}"] = inputs
            grads[f"h{side}"], grads[f"b{side}"] = recurrent, flat.sum(axis=0)
        return grads

    def fit(self, pages: list[tuple[tuple, np.ndarray]], epochs: int = EPOCHS, seed: int = 3) -> None:
        """Adam on batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        step = 0
        pages = sorted(pages, key=lambda p: len(p[1]))
        groups = [pages[k : k + BATCH_PAGES] for k in range(0, len(pages), BATCH_PAGES)]
        for epoch in range(epochs):
            rate = 0.015 * (1 - 0.8 * epoch / epochs)
            for k in rng.permutation(len(groups)):
                batch = Batch([p[0] for p in groups[k]])
                y = np.zeros(batch.mask.shape, np.float32)
                for row, (_, labels) in enumerate(groups[k]):
                    y[row, : len(labels)] = labels
                step += 1
                for name, grad in self.gradient(batch, y).items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad**2
                    self.weights[name] = (self.weights[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def keep(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(pages[order[stop]]) <= _CELLS // 16:
                stop += 1
            part = order[at:stop]
            for row, k in zip(self.scores([features(pages[k]) for k in part]), part):
                out[k] = row[: len(pages[k])] >= 0.5
            at = stop
        return out


# Names that sites give to parts of a page, for the composed layouts.
PARTS = {
    "menu": ("nav menu navbar breadcrumb breadcrumbs navigation topnav main-menu nav-links tabs mega-menu site-nav", "nav nav ul div div"),
    "header": ("header masthead site-header top topbar logo branding page-header tagline", "header header div div"),
    "footer": ("footer site-footer copyright legal colophon bottom page-footer footer-links imprint", "footer footer div div"),
    "sidebar": ("sidebar side widget related rail aside recommended more-stories popular trending widgets tags author-box", "aside aside div section"),
    "notice": ("cookie notice consent gdpr alert popup modal newsletter subscribe cookie-banner cookies paywall overlay toast privacy notification", "div div section aside dialog p"),
    "advert": ("ad ads advert advertisement sponsor sponsored promo banner adsbox ad-slot ad-container promotion dfp", "div div aside section p"),
    "form": ("form search login signup contact search-form subscribe-form", "form form"),
    "share": ("share social sharing social-links buttons toolbar", "div ul"),
    "comments": ("comments comment comment-list replies responses discussion disqus comment-thread reader-comments user-comments", "section div ol div"),
}
MAIN = ("content article post entry story main body text article-body post-content entry-content main-content story-body prose", "article article main div div section")
PHRASES = {
    "menu": ("Home", "About us", "Contact", "News", "Sports", "Login", "Menu", "Archive", "Next", "Previous"),
    "header": ("Skip to content", "The Daily", "Search", "Subscribe now"),
    "footer": ("&copy; 2024 All rights reserved", "Privacy policy &middot; Terms", "&copy; Imprint", "Powered by", "Contact us"),
    "sidebar": ("Most read", "Related articles", "You may also like", "Tags", "Popular now", "See also"),
    "notice": ("We use cookies", "Accept all cookies", "This site uses cookies to improve", "Sign up for our newsletter", "Notice"),
    "advert": ("Advertisement", "Sponsored", "Buy now", "Ad", "Special offer: 50% off"),
    "form": ("Your e-mail", "Name", "Send", "Subscribe", "Search"),
    "share": ("Share", "Tweet", "Facebook", "E-mail this"),
    "comments": ("Reply", "3 comments", "Posted by", "Leave a comment", "says:"),
}
FALLBACK = ("a plain sentence of some words that goes on for a while.", "another line here.", "short words", "the end of it all, as they say.")


class Composer:
    """Labelled pages from texts; what is to be kept carries a mark that no feature reads."""

    def __init__(self, texts: Sequence[str], seed: int = 1) -> None:
        self.texts = list(texts) or list(FALLBACK)
        self.pick = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        pool = self.pick.choice(self.texts).split(" ")
        size = self.pick.randint(low, high)
        at = self.pick.randint(0, max(len(pool) - size, 0))
        return " ".join(pool[at : at + size]).replace("&", "&amp;").replace("<", "&lt;")

    def attributes(self, names: str, chance: float = 0.85) -> str:
        if self.pick.random() > chance:
            return ""
        chosen = " ".join(self.pick.sample(names.split(), self.pick.choice((1, 1, 1, 2))))
        kind = self.pick.choice(("class", "class", "class", "id"))
        return f' {kind}="{chosen}"'

    def boilerplate(self, part: str) -> str:
        pick = self.pick
        names, tags = PARTS[part]
        tag = pick.choice(tags.split())
        telling = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        text = lambda low, high: pick.choice(PHRASES[part]) if pick.random() < 0.3 else self.words(low, high)
        items = []
        if part in ("menu", "share") or part in ("sidebar", "footer", "header") and pick.random() < 0.5:
            many = [f'<li><a href="/x">{text(1, 3)}</a></li>' for _ in range(pick.randint(1, 8))]
            items.append("".join(many) if tag == "ul" else "<ul>" + "".join(many) + "</ul>" if pick.random() < 0.7 else " ".join(f'<a href="/x">{text(1, 3)}</a>' for _ in range(pick.randint(1, 6))))
        if part == "form":
            items += [f"<label>{text(1, 3)}</label><input name='q'>" for _ in range(pick.randint(1, 3))] + [f"<button>{text(1, 2)}</button>"] * pick.randint(0, 1) + [f"<p>{self.words(3, 20)}</p>"] * pick.randint(0, 1)
        if part == "comments":
            items += [f"<{w}{self.attributes('comment reply user-comment comment-body', 0.6)}>{pick.choice(('<p>', '<b>', ''))}{self.words(2, 60)}</{w}>" for w in [pick.choice(("div", "li", "p", "article"))] for _ in range(pick.randint(1, 5))]
        if part in ("sidebar", "notice", "advert", "footer", "header") and (not items or pick.random() < 0.5):
            wrap = "" if tag == "p" else pick.choice(("p", "", "", "span", "h3", "div"))
            lines = [text(2, 40) for _ in range(pick.randint(1, 3))]
            items += [f"<{wrap}>{line}</{wrap}>" if wrap else line for line in lines]
        return f"<{tag}{self.attributes(names, 0.55 if telling else 1.0)}>{''.join(items)}</{tag}>"

    def kept(self, tag: str, low: int, high: int) -> str:
        text = self.words(low, high)
        style = self.pick.random()
        if style < 0.12:
            text = f"<b>{text}</b>"
        elif style < 0.2:
            text = f"<b>{text}<br>"
        elif style < 0.3:
            words = text.split(" ")
            text = " ".join([*words[: len(words) // 2], f'<a href="/y">{self.words(1, 4)}</a>', *words[len(words) // 2 :]])
        return f"<{tag} data-keep=1>{text}" + ("" if style < 0.2 and style >= 0.12 and tag == "p" else f"</{tag}>")

    def article(self) -> str:
        pick = self.pick
        out = []
        if pick.random() < 0.8:
            heading = self.kept("h1", 1, 14)
            out.append(f"<header>{heading}</header>" if pick.random() < 0.15 else heading)
        for _ in range(pick.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = pick.random()
            if kind < 0.72:
                out.append(self.kept("p", *pick.choice(((1, 4), (5, 30), (20, 120)))))
            elif kind < 0.8:
                out.append(self.kept(pick.choice(("h2", "h3")), 1, 8))
            elif kind < 0.86:
                out.append(f"<{w}>" + "".join(self.kept("li", 1, 25) for _ in range(pick.randint(1, 5))) + f"</{w}>" if (w := pick.choice(("ul", "ol"))) else "")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.kept('p', 4, 40)}</blockquote>")
            elif kind < 0.93:
                out.append(self.kept(pick.choice(("pre", "div", "section")), 3, 50))
            elif kind < 0.95:
                out.append("<table><tr>" + "".join(self.kept("td", 1, 8) for _ in range(pick.randint(1, 4))) + "</tr></table>")
            else:
                out.append(f"<figure><img src=x>{self.kept('figcaption', 2, 15)}</figure>")
            if pick.random() < 0.22:
                out.append(self.boilerplate(pick.choice(("advert", "notice", "share", "sidebar", "form", "menu"))))
        if pick.random() < 0.15:
            out.append(self.boilerplate("share"))
        if pick.random() < 0.2:
            out.append(self.boilerplate("comments"))
        names, tags = MAIN
        tag = pick.choice(tags.split())
        body = f"<{tag}{self.attributes(names, 0.4 if tag in ('article', 'main') else 0.95)}>{''.join(out)}</{tag}>"
        if pick.random() < 0.3:
            wrap = pick.choice(("main", "div"))
            body = f"<{wrap}{self.attributes('main container wrapper page content layout', 0.5)}>{body}</{wrap}>"
        return body

    def page(self) -> str:
        pick = self.pick
        if pick.random() < 0.06:
            return "".join(self.kept("p", 2, 40) for _ in range(pick.randint(1, 4)))
        before = [p for p, chance in (("notice", 0.25), ("header", 0.4), ("menu", 0.8), ("advert", 0.4), ("form", 0.15), ("sidebar", 0.15)) if pick.random() < chance]
        after = [p for p, chance in (("share", 0.15), ("comments", 0.35), ("sidebar", 0.4), ("advert", 0.25), ("form", 0.2), ("notice", 0.2), ("menu", 0.1), ("footer", 0.85)) if pick.random() < chance]
        if pick.random() < 0.3:
            pick.shuffle(before)
        if pick.random() < 0.3:
            pick.shuffle(after)
        parts = [self.boilerplate(p) for p in before] + ([self.article()] if pick.random() < 0.96 else []) + [self.boilerplate(p) for p in after]
        return f"<html><head><title>{self.words(1, 8)}</title></head><body>{''.join(parts)}</body></html>"


def trained(texts: Sequence[str], pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    """A labeller fitted to composed pages."""
    composer, rows = Composer(texts), []
    while len(rows) < pages:
        page = blocks(composer.page())
        if page:
            rows.append((features(page), np.array([b.marked for b in page], np.float32)))
    labeller = Labeller()
    labeller.fit(rows, epochs)
    return labeller


def sample_texts(pages: DataFrame, html: str = "html", sample_pages: int = SAMPLE_PAGES) -> list[str]:
    """Texts of blocks of at most `sample_pages` distinct pages, at most 2,000 characters of each.

    The pages with the least hashes are taken, each once, however many copies or nulls there are;
    tasks exchange and send hashes, and only the chosen pages come to the driver.
    """
    rows = pages.select(F.col(html).alias("h")).filter("h is not null").withColumn("place", F.xxhash64("h"))
    chosen = [row["place"] for row in rows.select("place").distinct().orderBy("place").limit(sample_pages).collect()]
    found = rows.filter(F.col("place").isin(chosen)).groupBy("place").agg(F.min("h").alias("h")).orderBy("place").limit(max(len(chosen), 1)) if chosen else rows.limit(0)
    return [b.text[:2000] for row in found.collect() for b in blocks(row["h"])]


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """Per page its address, its main text, and the text's number of code points."""
    labeller = labeller or trained(sample_texts(pages, html))
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "h"):
            found = [blocks(page) for page in batch.column("h").to_pylist()]
            texts = [" ".join(b.text for b, good in zip(page, keep) if good) for page, keep in zip(found, shared.value.keep(found))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), batch.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["i", "u", "text", "n_chars"])

    rows = pages.select(F.col(id_column).alias("i"), F.col(url).alias("u"), F.col(html).alias("h"))
    kinds = f"i {rows.schema['i'].dataType.simpleString()}, u {rows.schema['u'].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(run, kinds).select(F.col("i").alias(id_column), F.col("u").alias(url), "text", "n_chars")
