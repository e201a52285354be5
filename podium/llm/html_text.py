"""Main text of web pages by gradient-boosted trees over the elements of a page.

Each block element of a page has features: its tag and attribute words and those around it, text,
link and tag density of its subtree, depth, and how it compares with its siblings. Boosted trees tell
how likely it is a part of the article. An article is then read off the whole tree: an element can only be in it
if its parent is, and of all such choices the one with the largest sum of log odds, weighted by
text, is taken.

No page comes with its main text marked. The trees learn from a bounded sample of the pages themselves
that have one ``article`` or ``main`` element, in which that element is the article; from each of them further pages are
made by dealing the same texts out under other tags and attribute words, with menus, notices, adverts, forms, comments and
side bars around and inside the article.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.boosting import BoostConfig, Trees, fit
from podium.llm.common import blocks
from podium.llm.dom import NAMES, Page, features
from podium.session import ship_package


@dataclass(frozen=True)
class PageConfig:
    sample: int = 300  # pages to learn from, at most
    variants: int = 4  # made from each
    elements: int = 200  # of a page, at most, in learning
    seed: int = 5
    boost: BoostConfig = BoostConfig()


def chosen(parent: list[int], logits: np.ndarray, own_chars: np.ndarray) -> np.ndarray:
    """The elements of the article: the best choice in which every chosen element's parent is chosen.

    An element adds its log odds times the characters of its own text; one without text adds them once.
    """
    gain = logits * np.maximum(own_chars, 1)
    gain[0] = 0  # the page itself
    for i in range(len(gain) - 1, 0, -1):
        gain[parent[i]] += max(gain[i], 0)
    keep = gain > 0
    keep[0] = True
    for i in range(1, len(gain)):
        keep[i] &= keep[parent[i]]
    return keep


def _marked(page: Page, runs: list) -> np.ndarray | None:
    """Which elements are the article, in a page with one article or main element; else nothing."""
    roots = [i for i, t in enumerate(page.tag) if t == "article"] or [i for i, t in enumerate(page.tag) if t == "main"]
    if len(roots) != 1:
        return None
    out = np.zeros(len(page.tag), bool)
    for i in range(roots[0], len(page.tag)):
        inside = i == roots[0] or out[page.parent[i]]
        out[i] = inside and page.tag[i] not in ("nav", "aside", "form", "footer")
    i = roots[0]
    while i >= 0:
        out[i], i = True, page.parent[i]
    return out if any(out[block] for block, _, _ in runs) else None


#: Elements that made pages consist of. Each is (opening tag, what is inside).
_HOMES = ["article", "main", 'div class="content"', 'div class="post-body"', 'section class="story"', 'div id="main"', 'div class="entry-content"', "div", "section"]
_AROUND = [
    ("nav", "links"), ('div class="menu"', "links"), ('ul class="navbar"', "items"), ('div class="breadcrumbs"', "line"), ("header", "line"),
    ('div id="header"', "line"), ('div class="masthead"', "links"), ("footer", "line"), ('div class="footer"', "line"), ('div id="copyright"', "line"),
    ("aside", "prose"), ('div class="sidebar"', "prose"), ('div class="related"', "links"), ('div class="widget"', "links"),
    ('div class="cookie-notice"', "line"), ('div class="notice"', "line"), ('div class="consent-banner"', "prose"), ('div class="ad"', "line"),
    ('div class="advert"', "prose"), ('div class="sponsored"', "prose"), ('div id="ads"', "line"), ("form", "fields"), ('form class="search"', "fields"),
    ('div class="newsletter"', "fields"), ('div class="login"', "fields"), ('div class="comments"', "comments"), ('section id="comments"', "comments"),
    ('ul class="comment-list"', "comments"), ('div class="comment"', "prose"), ('div class="share"', "links"), ('div class="social"', "links"),
    ("section", "links"), ("div", "links"),
]


def _made(texts: list[str], other: list[str], dice: random.Random) -> tuple[str, list[bool]]:
    """A page with ``texts`` as its article, and whether each of its blocks of text belongs to it."""
    words = " ".join(texts + other).split() or ["text"]
    parts: list[tuple[str, bool | None]] = []  # markup, and for text whether it is in the article

    def line(low, high):
        at = dice.randrange(len(words))
        return escape(" ".join((words + words)[at : at + dice.randint(low, high)]))

    def open_close(tag, body):
        return [(f"<{tag}>", None), *body, (f"</{tag.split()[0]}>", None)]

    def boilerplate():
        tag, kind = dice.choice(_AROUND)
        text = lambda low, high: [(line(low, high), False)]
        if kind in ("links", "items"):
            links = [p for _ in range(dice.randint(2, 7)) for p in open_close("li", [("<a href='/x'>", None), *text(1, 4), ("</a>", None)])]
            return open_close(tag, links if kind == "items" else open_close("ul", links))
        if kind == "line":
            return open_close(tag, text(3, 15))
        if kind == "fields":
            return open_close(tag, [*open_close("label", text(1, 3)), ("<input name='q'>", None), *open_close("button", text(1, 2))])
        if kind == "comments":
            each = [p for _ in range(dice.randint(1, 5)) for p in open_close("div class='comment'" if dice.random() < 0.7 else "li", open_close("p", text(5, 60)))]
            return open_close(tag, each)
        return open_close(tag, [p for _ in range(dice.randint(1, 3)) for p in open_close("p", text(8, 60))])

    body = []
    for i, text in enumerate(texts):
        draw = dice.random()
        tag = "h1" if i == 0 and draw < 0.7 else "h2" if draw < 0.05 else "div" if draw < 0.15 else "blockquote" if draw < 0.18 else "li" if draw < 0.25 else "p"
        piece = open_close(tag, [(escape(text), True)])
        body += open_close("ul", piece) if tag == "li" else piece
        if dice.random() < 0.06:
            body += boilerplate()
    home = open_close(dice.choice(_HOMES), body)
    if dice.random() < 0.3:
        home = open_close(dice.choice(['div class="wrapper"', "main", 'div id="page"']), [*home, *boilerplate()])
    for _ in range(dice.randint(1, 5)):
        parts += boilerplate()
    parts += home
    for _ in range(dice.randint(1, 4)):
        parts += boilerplate()
    return "<html><body>" + "".join(p for p, _ in parts) + "</body></html>", [kind for p, kind in parts if kind is not None and p.strip()]


def examples(html: str, config: PageConfig, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of a page whose article is marked, and of pages made from it."""
    page = Page(html)
    runs = page.texts()
    labels = _marked(page, runs)
    if labels is None:
        return np.zeros((0, len(NAMES)), np.float32), np.zeros(0, bool)
    dice = random.Random(seed)
    out = [(features(page, runs)[0], labels)]
    inside = [t for b, t, _ in runs if labels[b]]
    outside = [t for b, t, _ in runs if not labels[b]]
    for _ in range(config.variants):
        made, wanted = _made(inside[: config.elements], outside[: config.elements], dice)
        page = Page(made)
        runs = page.texts()
        if len(runs) != len(wanted):
            continue
        good = np.zeros(len(page.tag), bool)
        for (block, _, _), want in zip(runs, wanted):
            while want and block >= 0 and not good[block]:
                good[block], block = True, page.parent[block]
        out.append((features(page, runs)[0], good))
    x, y = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
    text = x[:, NAMES.index("chars")] > 0
    some = np.flatnonzero(text)
    some = np.sort(dice.sample(some.tolist(), min(len(some), config.elements * (1 + config.variants))))
    return x[some], y[some]


def learn_pages(pages: DataFrame, config: PageConfig = PageConfig()) -> Trees:
    """Learn from at most ``config.sample`` rows (page_id, html), drawn by a hash of page_id; features reach the driver, no pages."""
    ship_package(pages.sparkSession)
    total = pages.count()
    draw = F.xxhash64("page_id", F.lit(config.seed))
    most = int(-(2**63) + 2**64 * 2 * config.sample / total) if total > 2 * config.sample else 2**63 - 1

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y = examples(row["html"] or "", config, row["draw"])
                yield pa.RecordBatch.from_pydict({"draw": [row["draw"]], "x": [x.tobytes()], "y": [y.astype(np.uint8).tobytes()]})

    drawn = pages.select("html", draw.alias("draw")).where(F.col("draw") <= most)
    found = drawn.mapInArrow(run, "draw long, x binary, y binary").orderBy("draw", "x").limit(config.sample).collect()
    x = np.concatenate([np.zeros((0, len(NAMES)), np.float32), *(np.frombuffer(r["x"], np.float32).reshape(-1, len(NAMES)) for r in found)])
    y = np.concatenate([np.zeros(0), *(np.frombuffer(r["y"], np.uint8) for r in found)])
    if not len(y):  # no page with a marked article: pages made of nothing but their markup
        made = [examples(f"<article><h1>a b</h1>{'<p>a b c, d e f.</p>' * 5}</article>", config, i) for i in range(50)]
        x, y = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    return fit(x, y.astype(np.float64), config.boost)


def main_text(page: Page, runs: list, logits: np.ndarray, own: np.ndarray) -> str:
    keep = chosen(page.parent, logits, own)
    return "\n".join(text for block, text, _ in runs if keep[block])


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text).

    The blocks of the article in page order, one per line, with character references decoded and white space
    as one space. A null or empty html, or one without an article, has an empty text. A page of any length counts
    whole; other columns are ignored and repeated rows kept.
    """
    ship_package(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trees)
    shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in blocks(batches, "html", 2_000_000):
            parsed = [Page(html) for html in pc.fill_null(batch.column("html"), "").to_pylist()]
            runs = [p.texts() for p in parsed]
            made = [features(p, r) for p, r in zip(parsed, runs)]
            logits = np.split(sent.value.logits(np.concatenate([x for x, _ in made])), np.cumsum([len(x) for x, _ in made])[:-1])
            texts = [main_text(p, r, z, own) for p, r, z, (_, own) in zip(parsed, runs, logits, made)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=shape)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
