"""HTML extraction: gradient-boosted trees over DOM-node features, decoded hierarchically.

Every node gets a probability of belonging to the main text from boosted regression trees over its subtree density,
link share, attribute words, depth and sibling statistics. Decoding then chooses the most probable labelling in which
no kept node has a dropped ancestor: a tree dynamic program over log-probabilities. The trees are trained here, in
numpy, on pages drawn from a seeded generator of layouts (no labelled pages exist); the model is a few kilobytes.

Defined results: a null or empty page, and one without main text, gives the empty string; unclosed and stray tags are
read tolerantly; repeated rows are read alike; very long pages are read whole; other columns are never read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilspark.llm.common import bound_batches, in_slices
from veilspark.llm.html_nodes import GROUP_NAMES, GROUPS, HIDDEN_BIT, Page, blocks, read

TAG_KINDS = {
    "p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "div": 3, "article": 4, "main": 4, "section": 5, "nav": 6, "menu": 6, "header": 7,
    "footer": 8, "aside": 9, "form": 10, "button": 10, "select": 10, "option": 10, "label": 10, "fieldset": 10, "legend": 10, "dialog": 11,
    "ul": 12, "ol": 12, "dl": 12, "li": 13, "dt": 13, "dd": 13, "table": 14, "tbody": 14, "tr": 14, "td": 14, "th": 14,
    "blockquote": 15, "pre": 15, "figure": 15, "figcaption": 15, "html": 16,
}
N_KINDS = 17
DROPS = ("nav", "menu", "header", "footer", "aside", "form", "dialog")
#: Trees, their depth, bins of a feature, step length.
TREES, DEPTH, BINS, STEP = 60, 5, 24, 0.3
TRAINING_PAGES, SEED = 1500, 11


def node_features(pages: list[Page]) -> np.ndarray:
    """A row per node of all pages: own and inherited attributes and tags, densities, place among its siblings."""
    rows: list[tuple[float, ...]] = []
    for page in pages:
        n = len(page.tags)
        chars, links, words, stops, tags = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n
        paragraphs, long = [0] * n, [0] * n
        for node, _, text, linked in page.runs:
            size = len(text.strip())
            if size:
                chars[node] += size
                links[node] += size if linked else 0
                count = text.count(" ") + 1
                words[node] += count
                stops[node] += text.count(". ") + text.count(", ") + text.rstrip().endswith((".", "!", "?", ":", "…"))
                long[node] += count >= 12
        own = list(chars)
        kids, place = [0] * n, [0] * n
        for i in range(1, n):
            p = page.parents[i]
            place[i] = kids[p]
            kids[p] += 1
        for i in range(n - 1, 0, -1):
            p = page.parents[i]
            chars[p] += chars[i]
            links[p] += links[i]
            words[p] += words[i]
            stops[p] += stops[i]
            tags[p] += tags[i]
            long[p] += long[i]
            paragraphs[p] += paragraphs[i] + (page.tags[i] == "p")
        above, kinds, inside = [0] * n, [0] * n, [0] * n
        total = chars[0] or 1
        for i in range(n):
            p, tag, mask = page.parents[i], page.tags[i], page.masks[i]
            kinds[i] = TAG_KINDS.get(tag, 0)
            drop = (tag in DROPS) << 1 | (tag in ("article", "main"))
            if p >= 0:
                above[i], inside[i] = above[p] | page.masks[p], inside[p] | drop
                around = chars[p] or 1
            else:
                inside[i], around = drop, total
            size = chars[i]
            siblings = kids[p] if p >= 0 else 1
            rows.append((
                page.depths[i], kinds[i], mask, above[i], inside[i], size, words[i], links[i] / (size or 1), size / tags[i], stops[i] / (words[i] or 1),
                own[i] / (size or 1), tags[i], kids[i], place[i], siblings, (place[i] + 1) / siblings, size / around, size / total, paragraphs[i], long[i],
            ))
    plain = np.array(rows, np.float64).reshape(len(rows), 20)
    kind, mask, above = plain[:, 1].astype(np.int64), plain[:, 2].astype(np.int64), plain[:, 3].astype(np.int64)
    bits = np.arange(len(GROUP_NAMES) + 1)
    return np.hstack([
        np.delete(plain, [1, 2, 3, 4], axis=1), (kind[:, None] == np.arange(N_KINDS)), (mask[:, None] >> bits) & 1, (above[:, None] >> bits) & 1,
        (plain[:, 4].astype(np.int64)[:, None] >> np.arange(2)) & 1,
    ]).astype(np.float32)


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays: split feature and threshold of every inner node in level order, values of the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            score += v[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic boosting with second-order leaf values over binned features."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    # A value goes right of edge b when it is above it.
    offset = np.arange(width) * BINS
    flat = (binned + offset).astype(np.int64)
    base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(DEPTH):
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                own = np.flatnonzero(at == node)
                if len(own) >= 20:
                    cells = flat[own].ravel()
                    gs = np.bincount(cells, np.repeat(g[own], width), width * BINS).reshape(width, BINS).cumsum(1)
                    hs = np.bincount(cells, np.repeat(h[own], width), width * BINS).reshape(width, BINS).cumsum(1)
                    total_g, total_h = gs[0, -1], hs[0, -1]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    gain[(hs < 1) | (total_h - hs < 1)] = 0
                    k, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[k, b] > 1e-6 and b < len(edges[k]):
                        f[node], t[node] = k, edges[k][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        v = STEP * gs / (hs + 1)
        score += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Boosted(np.array(features), np.array(thresholds), np.array(values), base)


def decode(page: Page, probability: np.ndarray) -> list[bool]:
    """The most probable choice of kept nodes in which a dropped node drops its whole subtree; what is not shown is dropped."""
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    p[(np.array(page.masks) & HIDDEN_BIT) != 0] = 1e-300
    keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
    n = len(page.tags)
    for i in range(n - 1, 0, -1):
        q = page.parents[i]
        keep[q] += max(keep[i], drop[i])
        drop[q] += drop[i]
    kept = [True] * n  # the root stays: a page without main text drops all below it and its own text is judged with it
    kept[0] = keep[0] >= drop[0]
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and keep[i] >= drop[i]
    return kept


# The generator of training pages. A layout is a tree of (tag, attributes, label, children or text).

_SYLLABLES = "an be co da el fi go hu in jo ka le mi no or pa qui re so ta un ve wi xa yo zu ch sch eau tion".split()


class _Layouts:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[bool] = []
        self.manner = "p"

    def words(self, low: int, high: int) -> str:
        r = self.r
        own = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(w + r.choice(("", "", "", "", ",", ".")) for w in own)
        return text[:1].upper() + text[1:] + (r.choice(".!?") if r.random() < 0.85 else "")

    def open(self, tag: str, label: bool, attributes: str = "") -> None:
        self.out.append(f"<{tag}{attributes}>")
        self.labels.append(label)

    def leaf(self, tag: str, label: bool, low: int, high: int, attributes: str = "", linked: float = 0.0) -> None:
        self.open(tag, label, attributes)
        if self.r.random() < linked:
            self.out.append(f'<a href="/{self.r.randint(0, 999)}">{self.words(low, high)}</a>')
        else:
            text = self.words(low, high)
            if self.r.random() < 0.2:
                text = f"<b>{text}" + ("</b>" if self.r.random() < 0.5 else "<br>")
            elif self.r.random() < 0.2:
                text += f' <a href="/x">{self.words(1, 3)}</a> {self.words(1, 9)}'
            self.out.append(text)
        if tag != "p" or self.r.random() < 0.9:
            self.out.append(f"</{tag}>")

    def named(self, group: str, strength: float = 0.75) -> str:
        """Attributes whose words belong to a group, or meaningless ones."""
        r = self.r
        word = r.choice(GROUPS[group].split()) if r.random() < strength else r.choice(("box", "col", "wrap", "c1", "x7", "block"))
        extra = r.choice(("", "", "-1", " box", "-wrap", "_inner", " clearfix"))
        if group == "content" and r.random() < 0.2:  # stories whose own attributes hold a word of furniture
            extra += " " + r.choice(GROUPS[r.choice(("share", "header", "side", "notice", "comment"))].split())
        return r.choice((f' class="{word}{extra}"', f' id="{word}"', f" class='{extra.strip('-_')} {word}'"))

    def paragraph(self) -> None:
        """A paragraph of the story in the manner of the page: its own element, or text between line breaks."""
        r = self.r
        attributes = r.choice((' class="lead"', ' class="par"', ' class="text"', ' id="p1"', ' class="intro"', ' class="social"')) if r.random() < 0.08 else ""
        if self.manner == "br":
            self.out.append(self.words(8, 120) + r.choice(("<br>", "<br><br>", "<br/>")))
        else:
            self.leaf(self.manner, True, 1, 160, attributes)

    def furniture(self, kind: str) -> None:
        r = self.r
        tag = {"menu": r.choice(("nav", "nav", "div", "ul", "menu")), "header": r.choice(("header", "div")), "footer": r.choice(("footer", "footer", "div")), "side": r.choice(("aside", "div", "section")), "form": r.choice(("form", "form", "div", "section")), "notice": r.choice(("div", "section", "dialog", "aside", "p")), "advert": r.choice(("div", "div", "aside", "section", "p")), "comment": r.choice(("section", "div", "div", "ol")), "share": r.choice(("div", "ul", "section"))}[kind]
        plain = tag in ("nav", "menu", "footer", "aside", "form", "header", "dialog")
        attributes = ("" if r.random() < 0.6 else self.named(kind)) if plain else self.named(kind, 1.0 if kind in ("notice", "advert", "comment") else 0.8)
        if tag == "p":
            self.leaf("p", False, 2, 30, attributes)
            return
        self.open(tag, False, attributes)
        if kind in ("menu", "share", "side", "footer", "header") and tag not in ("ul", "menu") and r.random() < 0.25:
            self.links()
        elif kind in ("menu", "share") or kind == "side" and r.random() < 0.5:
            if tag != "ul":
                if r.random() < 0.3:
                    self.leaf("h3", False, 1, 3)
                self.open("ul", False)
            for _ in range(r.randint(2, 14)):
                self.leaf("li", False, 1, 5, linked=0.95)
            if tag != "ul":
                self.out.append("</ul>")
        elif kind == "form":
            if r.random() < 0.5:
                self.leaf("p", False, 2, 20)
            for _ in range(r.randint(1, 4)):
                self.leaf("label", False, 1, 3)
                self.out.append('<input name="q">')
            self.leaf("button", False, 1, 2)
        elif kind == "comment":
            if r.random() < 0.7:
                self.leaf(r.choice(("h2", "h3")), False, 1, 3)
            for _ in range(r.randint(1, 8)):
                if tag == "ol":
                    self.leaf("li", False, 3, 60, self.named("comment", 0.7))
                else:
                    self.open("div", False, self.named("comment", 0.7))
                    self.leaf("p", False, 2, 70)
                    if r.random() < 0.4:
                        self.leaf("p", False, 2, 40)
                    self.out.append("</div>")
        elif kind == "footer" and r.random() < 0.6 or kind == "advert" and r.random() < 0.6:
            self.out.append(self.words(1, 30))
        else:
            if kind == "header" and r.random() < 0.6:
                self.leaf("h1", False, 1, 5)
            for _ in range(r.randint(1, 3)):
                self.leaf(r.choice(("p", "div", "p")), False, 1, 30, linked=0.3)
        self.out.append(f"</{tag}>")

    def links(self) -> None:
        """Links in a row, divided by signs or line breaks."""
        r = self.r
        sign = r.choice((" | ", "<br>", "<br>", " ", " - ", " &middot; "))
        self.out.append(sign.join(f'<a href="/{r.randint(0, 999)}">{self.words(1, 4)}</a>' for _ in range(r.randint(2, 9))))

    def columns(self) -> None:
        """The story in a column beside others, in a table or in boxes."""
        r = self.r
        row, cell = r.choice((("table", "td"), ("div", "div"), ("section", "div"), ("div", "section")))
        self.open(row, True, r.choice(("", "", ' class="grid"', ' class="row"', ' id="columns"')))
        if row == "table":
            self.open("tr", True)
        kinds = [r.choice(("menu", "side", "side", "advert", "share", "form")) for _ in range(r.choice((0, 1, 1, 1, 2)))]
        kinds.insert(r.randint(0, len(kinds)), "story")
        for kind in kinds:
            if kind == "story":
                self.open(cell, True, r.choice(("", "", ' class="col-8"', ' class="grid-main"', self.named("content"))))
                self.content()
            elif r.random() < 0.5:
                self.open(cell, False, r.choice(("", ' width="120"', ' class="col-4"', self.named(kind))))
                self.links() if kind in ("menu", "side", "share") else self.furniture(kind)
            else:
                # A plain cell is the furniture's own box: nothing else is in it.
                self.open(cell, False)
                self.furniture(kind)
            self.out.append(f"</{cell}>")
        self.out.append("</tr></table>" if row == "table" else f"</{row}>")

    def content(self) -> None:
        r = self.r
        if r.random() < 0.65:
            if r.random() < 0.1:
                self.open("header", True)
                self.leaf("h1", True, 2, 14)
                self.out.append("</header>")
            else:
                self.leaf(r.choice(("h1", "h1", "h2")), True, 1, 14)
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 13, 20))):
            k = r.random()
            if k < 0.75:
                boxed = r.random() < 0.06
                if boxed:
                    self.open("div", True, r.choice(("", ' class="block"', ' class="dateline"', ' class="inner"')))
                self.paragraph()
                self.out.append("</div>" if boxed else "")
            elif k < 0.82:
                self.leaf(r.choice(("h2", "h3")), True, 1, 8)
            elif k < 0.88:
                self.open(r.choice(("ul", "ol")), True)
                tag = self.out[-1][1:3]
                for _ in range(r.randint(1, 6)):
                    self.leaf("li", True, 2, 30, linked=0.1)
                self.out.append(f"</{tag}>")
            elif k < 0.91:
                self.leaf(r.choice(("blockquote", "pre")), True, 3, 60)
            elif k < 0.94:
                self.open("table", True)
                for _ in range(r.randint(1, 4)):
                    self.open("tr", True)
                    self.leaf("td", True, 1, 6)
                    self.leaf("td", True, 1, 6)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif k < 0.96:
                self.leaf("div", True, 3, 80)
            elif r.random() < 0.7:
                self.furniture(r.choice(("advert", "advert", "share", "side", "form", "notice")))
        if r.random() < 0.1:
            self.furniture(r.choice(("share", "comment")))

    def page(self) -> tuple[str, list[bool]]:
        r = self.r
        self.out, self.labels = ["<!DOCTYPE html><html><head><title>t</title></head><body>"], [True]
        if r.random() < 0.12:  # a page that holds nothing else
            self.manner = r.choice(("p", "p", "p", "div", "br"))
            self.content()
            self.out.append("</body></html>")
            return "".join(self.out), self.labels
        wrap = r.random() < 0.4
        if wrap:
            self.open("div", True, r.choice(("", ' class="wrap"', ' id="page"', ' class="container"')))
        for kind in r.sample(("menu", "header", "notice", "advert", "form", "side"), r.choice((0, 1, 1, 2, 2, 3, 4))):
            self.furniture(kind)
        self.manner = r.choice(("p", "p", "p", "p", "div", "div", "div", "br"))
        if r.random() < 0.2:
            self.columns()
        elif r.random() < 0.97:
            tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td", "", "", ""))
            if tag == "td":
                self.open("table", True)
                self.open("tr", True)
            outer = r.random() < 0.2
            if outer:
                self.open("div", True, r.choice(("", ' class="row"', ' class="layout"', ' id="wrapper"')))
            twice = tag == "main" and r.random() < 0.5
            if tag:
                self.open(tag, True, "" if r.random() < (0.7 if tag in ("article", "main") else 0.3) else self.named("content", 0.7))
            if twice:
                self.open("article", True)
            self.content()
            self.out.append(("</article>" if twice else "") + (f"</{tag}>" if tag else "") + ("</div>" if outer else "") + ("</tr></table>" if tag == "td" else ""))
        for kind in r.sample(("side", "comment", "advert", "share", "form", "menu", "notice"), r.choice((0, 0, 1, 1, 2, 3))):
            self.furniture(kind)
        if r.random() < 0.8:
            self.furniture("footer")
        self.out.append("</div>" if wrap else "")
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


_model: Boosted | None = None


def trained() -> Boosted:
    """The trees, trained once by each process from the seeded generator: the same everywhere."""
    global _model
    if _model is None:
        layouts = _Layouts(SEED)
        pages, labels = [], []
        for _ in range(TRAINING_PAGES):
            source, own = layouts.page()
            page = read(source)
            if len(page.tags) == len(own):
                pages.append(page)
                labels += own
        _model = boost(node_features(pages), np.array(labels, np.float64))
    return _model


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    """Main texts of whole pages."""
    pages = [read(x) for x in sources]
    if not pages:
        return []
    p = model.probability(node_features(pages))
    out, at = [], 0
    for page in pages:
        own = p[at : at + len(page.tags)]
        at += len(page.tags)
        out.append(blocks(page, decode(page, own)) if page.runs else "")
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows ``(page_id, url, text, n_chars)``."""
    bound_batches(pages.sparkSession)
    src = pages.select(id_col, url_col, html_col)
    model = trained()
    schema = T.StructType([src.schema[id_col], src.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for at in range(0, b.num_rows, 64):  # nodes of so many pages at once
                texts += main_texts(b.column(2).slice(at, 64).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return src.mapInArrow(in_slices(run, 2), schema)
