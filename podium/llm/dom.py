"""Web pages as trees of block elements, with features of each."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np

#: Element kinds of HTML, and words in class and id attributes that tell what an element is for.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title svg iframe canvas audio video select datalist".split())
BLOCKS = set(
    "html body p div section article main nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog hgroup menu center button label legend textarea".split()
)
KINDS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"li", "ul", "ol", "dl", "dt", "dd", "menu"}, {"div", "center"}, {"section"},
    {"article"}, {"main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "label", "legend", "textarea"},
    {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"blockquote", "pre", "figure", "figcaption"}, {"dialog", "details"},
]
GOOD = set("article content main post entry story body text page blog news".split())
BAD_WORDS = {
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager skip toolbar tabs",
    "edge": "header masthead footer foot top bottom copyright legal topbar",
    "side": "sidebar side aside widget related recommended more rail trending popular tags",
    "notice": "cookie cookies notice consent gdpr banner alert popup modal overlay disclaimer",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted outbrain taboola",
    "form": "form login signup signin subscribe newsletter search register",
    "comment": "comment comments reply replies respond discussion disqus responses",
    "share": "share sharing social follow like bookmark print author meta byline",
}
BAD = {word: i for i, words in enumerate(BAD_WORDS.values()) for word in words.split()}
#: What a head may hold; anything else ends it. What ends a drawing that was not closed, besides block elements.
IN_HEAD = set("script style noscript template title base basefont bgsound link meta noframes".split())
AFTER_SVG = set("b big br code em embed hr i img nobr ruby s small span strong strike sub sup tt u var".split())
#: Elements that an opening tag closes if they are open, up to the elements that shield them.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_CLOSES |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SHIELDS_HEAD = HIDDEN | {"foreignobject", "desc"}


class Page(HTMLParser):
    """Block elements in page order, and the runs of text between their borders.

    ``parent``, ``tag`` and ``tokens`` have an entry per block element, the first of which stands for
    the page. ``runs`` are (element, text, characters in links): what no block begins or ends in. The places of the
    open elements are kept by name, so a tag costs the same however many elements are open.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.tokens = [-1], ["html"], [()]
        self.runs: list[list] = []
        self.open: list[tuple[str, int]] = [("html", 0)]  # elements, with the block each is in
        self.places: dict[str, list[int]] = {}  # by name, of the open elements
        self.shields: list[int] = []  # places of what a drawing or a head may not be ended through, but for titles
        self.hidden = self.links = 0
        self.body = False  # whether its tag has been seen
        self.fresh = True
        self.endless: dict[str, int] = {}  # by kind of declaration, the first place from which none of them ends
        tagged = html.rfind(">") + 1  # no tag ends behind it
        self.feed(html[:tagged])
        self.endless.clear()  # places are counted anew
        self.close()
        self.handle_data(unescape(html[tagged:]))

    def parse_comment(self, i, report=1):
        return self._declaration("comment", super().parse_comment, i, report)

    def parse_marked_section(self, i, report=1):
        return self._declaration("section", super().parse_marked_section, i, report)

    def _declaration(self, kind, parse, i, report):
        """Looks for the end only where it has not been missed before, which would take time for each that is open."""
        if i >= self.endless.get(kind, i + 1):
            return -1
        end = parse(i, report)
        if end < 0:
            self.endless[kind] = i
        return end

    def _push(self, tag: str, block: int):
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _SHIELDS_HEAD and tag != "title":
            self.shields.append(len(self.open))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"
        self.open.append((tag, block))

    def _pop(self, place: int):
        for tag, _ in self.open[place:]:
            self.places[tag].pop()
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
            self.fresh |= tag in BLOCKS
        while self.shields and self.shields[-1] >= place:
            self.shields.pop()
        del self.open[place:]

    def _last(self, tags) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((places[-1] for tag in tags if (places := self.places.get(tag))), default=0)

    def _end_hidden(self, tag):
        """Close a head or a drawing whose end tag is left out, where ``tag`` or text (None) cannot be in it."""
        place = self.shields[-1] if self.shields else 0
        if not place or tag not in BLOCKS and self._last(("title",)) > place:
            return
        name = self.open[place][0]
        if name == "head" and tag not in IN_HEAD or name == "svg" and (tag in BLOCKS or tag in AFTER_SVG):
            self._pop(place)

    def _end_all_hidden(self):
        if self.hidden:
            self._pop(min(places[0] for tag in HIDDEN if (places := self.places.get(tag))))

    def handle_starttag(self, tag, attrs):
        if tag == "body" and not self.body:
            self.body = True
            self._end_all_hidden()
        if tag in ("html", "body"):
            return
        if self.hidden:
            self._end_hidden(tag)
        if tag in BLOCKS and not self.hidden:
            if tag in _CLOSES:
                self._close_open(*_CLOSES[tag])
            self._close_open({"p"}, {"table", "button", "td", "th"})
        if tag in VOID:
            if tag in ("br", "hr", "img") and self.runs and not self.hidden and not self.fresh:
                self.runs[-1][1].append(" ")
            self.fresh |= tag == "hr"
            return
        block = self.open[-1][1]
        if tag in BLOCKS and not self.hidden:
            words = [w for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for w in re.split(r"[^A-Za-z]+", v)]
            tokens = {p.lower() for w in words for p in [w, *_SPLIT.findall(w)]}
            hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in (v or "").replace(" ", "") for k, v in attrs)
            self.parent.append(block)
            self.tag.append(tag)
            self.tokens.append((tokens, hidden))
            block, self.fresh = len(self.tag) - 1, True
        self._push(tag, block)

    def _close_open(self, tags, shields):
        place = self._last(tags)
        if place > self._last(shields):
            self._pop(place)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return self._end_all_hidden()
        if place := self._last((tag,)):
            self._pop(place)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.open[-1][0] == tag:
            self._pop(len(self.open) - 1)

    def handle_data(self, data):
        if self.hidden and data.strip() and self.open[-1][0] == "head":
            self._end_hidden(None)
        if self.hidden or not data:
            return
        if self.fresh:
            self.runs.append([self.open[-1][1], [], 0])
            self.fresh = False
        self.runs[-1][1].append(data)
        self.runs[-1][2] += len(data.strip()) if self.links else 0

    def texts(self) -> list[tuple[int, str, int]]:
        """The runs that have text, with white space as one space."""
        cleaned = ((block, " ".join("".join(pieces).split()), linked) for block, pieces, linked in self.runs)
        return [run for run in cleaned if run[1]]


NAMES = (
    [f"tag_{i}" for i in range(len(KINDS))]
    + [f"inside_{i}" for i in range(len(KINDS))]
    + ["good", "hidden", *BAD_WORDS]
    + [f"within_{k}" for k in ("good", "hidden", *BAD_WORDS)]
    + ["own_chars", "chars", "link_share", "tag_density", "stops", "words", "depth", "place", "siblings"]
    + ["sibling_chars", "same_siblings", "page_share", "before", "parent_chars", "parent_links", "paragraphs"]
)


def features(page: Page, runs: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A row per block element in the order of ``NAMES``, and the characters of its own runs."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, links, stops, words, first = (np.zeros(n) for _ in range(5))
    first[:] = -1
    at = 0
    for block, text, linked in runs:
        own[block] += len(text)
        links[block] += min(linked, len(text))
        stops[block] += sum(map(text.count, ".,;:!?"))
        words[block] += text.count(" ") + 1
        first[block] = at if first[block] < 0 else first[block]
        at += len(text)
    tag = np.zeros((n, len(KINDS)))
    marks = np.zeros((n, 2 + len(BAD_WORDS)))
    for i, (name, given) in enumerate(zip(page.tag, page.tokens)):
        for k, kind in enumerate(KINDS):
            if name in kind:
                tag[i, k] = 1
        if given:
            marks[i, 0], marks[i, 1] = len(given[0] & GOOD), given[1]
            for word in given[0]:
                if word in BAD:
                    marks[i, 2 + BAD[word]] = 1
    chars, linked, sentences, inner = own.copy(), links.copy(), stops.copy(), words.copy()
    tags, paragraphs, start = np.ones(n), tag[:, 0].copy(), np.where(first < 0, at, first)
    for i in range(n - 1, 0, -1):  # children come after their parent
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        sentences[p] += sentences[i]
        inner[p] += inner[i]
        tags[p] += tags[i]
        paragraphs[p] += paragraphs[i]
        start[p] = min(start[p], start[i])
    depth, inside, within = np.zeros(n), tag.copy(), marks.copy()
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        inside[i] = np.maximum(inside[i], inside[p])
        within[i] = np.maximum(within[i], within[p])
    up = np.maximum(parent, 0)
    children = np.bincount(up[1:], minlength=n)
    total = np.bincount(up[1:], chars[1:], n)
    kinds = {}
    place, same = np.zeros(n), np.zeros(n)
    seen = np.zeros(n)
    for i in range(1, n):
        place[i] = seen[up[i]]
        seen[up[i]] += 1
        kinds[up[i], page.tag[i]] = kinds.get((up[i], page.tag[i]), 0) + 1
    for i in range(1, n):
        same[i] = kinds[up[i], page.tag[i]] / children[up[i]]
    siblings = np.maximum(children[up], 1)
    columns = [
        np.log1p(own), np.log1p(chars), linked / np.maximum(chars, 1), np.log1p(chars / tags), sentences / np.maximum(inner, 1), np.log1p(inner),
        depth, place / siblings, np.log1p(siblings), np.log1p((total[up] - chars) / np.maximum(siblings - 1, 1)).clip(0), same,
        chars / max(at, 1), start / max(at, 1), np.log1p(chars[up]), linked[up] / np.maximum(chars[up], 1), np.log1p(paragraphs),
    ]
    return np.column_stack([tag, inside, marks, within, *columns]).astype(np.float32), own
