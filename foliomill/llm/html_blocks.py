"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into text blocks at every block-level tag. A block is described by
its word count and link density, those of the blocks before and after it, the
density and share of what it stands in, and last by marks: tags and whole names of
elements that don't hold the article themselves. A small tree, trained on the labelled table below, says which blocks
are the article. Pages are rows of their own; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import slices

#: Elements that never hold article text, that don't break a block, and that have no end tag.
HIDDEN = "title script style noscript template svg math iframe textarea".split()
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and name parts that mark what is not the article, and what is.
OUTSIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset button select object canvas audio video".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar "
    "navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay comment "
    "comments reply replies respond disqus discussion share sharing social related recommended widget newsletter subscribe signup "
    "login search pagination pager toolbar copyright legal skip hidden".split()
)
INSIDE_TAGS = frozenset("article main".split())
INSIDE_NAMES = frozenset("article content post entry story body text main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<hidden>" + "|".join(HIDDEN) + r")(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: How a class begins or ends that tells a state or a topic of an element, not what it is.
_TOPIC = re.compile(r"(?:has|is|no|not|with|without|tag|category|cat|topic|type|format|status|js|wp)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled|on|off)")
#: Elements that hold the article whatever they are called.
HOLDERS = frozenset("html body main".split())
#: Fixed value: elements whose start ends an open paragraph.
BREAKS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup main menu nav ol pre "
    "section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

OWN = "words links heading item sentence around_links share inside_tag inside_name outside_tag outside_name".split()
#: Names that mark an article in the labelled table, and how many times their words pages stand in training.
MARKS = {"article", "main", "content", "post", "story"}
MARKED_SCALES = (0.05, 0.2, 3.0)
PLAIN_SCALES = (0.7, 1.4, 2.0)
FEATURES = "words links words_before links_before words_after links_after".split() + OWN[2:]


@lru_cache(20_000)
def _names(value: str) -> tuple[bool, bool]:
    """Whether the names of an element say inside, and outside. Each name counts as a whole; where
    one says inside, others don't say outside."""
    inside = outside = False
    for name in value.split():
        if not _TOPIC.fullmatch(name):
            parts = {p.lower() for p in _PART.findall(name)}
            if parts & OUTSIDE_NAMES:
                outside = True
            elif parts & INSIDE_NAMES:
                inside = True
    return inside, outside and not inside


@lru_cache(20_000)
def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """What an element's attributes say: inside, outside, not shown."""
    names, unseen = [], False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            names.append(value)
        elif name in ("hidden", "aria-hidden"):
            unseen = unseen or (value.lower() != "false" and (name == "hidden" or bool(value)))
        elif name == "aria-modal":
            unseen = unseen or value.lower() == "true"
        elif name == "style":
            unseen = unseen or "display:none" in "".join(value.lower().split())
    return (*_names(" ".join(names)), unseen)


class _Elements:
    """The elements of a page in order of their start; the page itself is the first."""

    def __init__(self) -> None:
        self.parents, self.tags, self.marks = [0], [""], [(False, False, False)]

    def add(self, parent: int, tag: str, marks: tuple[bool, bool, bool]) -> int:
        self.parents.append(parent)
        self.tags.append(tag)
        self.marks.append(marks)
        return len(self.tags) - 1

    def describe(self, at: list[int], words: list[int], links: list[int]) -> tuple[list[bool], np.ndarray]:
        """Per block whether it is shown, and the columns of OWN from around_links on."""
        n = len(self.tags)
        total, linked, count = [0] * n, [0] * n, [0] * n
        for e, w, k in zip(at, words, links, strict=True):
            total[e] += w
            linked[e] += k
            count[e] += 1
        for e in range(n - 1, 0, -1):
            up = self.parents[e]
            total[up] += total[e]
            linked[up] += linked[e]
            count[up] += count[e]
        articles = [e for e in range(n) if self.tags[e] == "article"]
        holders = {e for e in range(n) if self.tags[e] in HOLDERS}
        if articles:
            holders.add(max(articles, key=lambda e: (total[e], -e)))
        for e in sorted(holders, reverse=True):  # and all they stand in
            while e and self.parents[e] not in holders:
                e = self.parents[e]
                holders.add(e)
        around, region = [0] * n, [-1] * n
        in_tag, in_name, out_tag, unseen = ([False] * n for _ in range(4))
        for e in range(1, n):
            up, tag, (named_in, named_out, hidden) = self.parents[e], self.tags[e], self.marks[e]
            around[e] = e if count[e] > 1 else around[up]
            in_tag[e] = in_tag[up] or tag in INSIDE_TAGS
            in_name[e] = in_name[up] or (named_in and tag not in HOLDERS)
            region[e], out_tag[e], unseen[e] = region[up], out_tag[up], unseen[up]
            if e not in holders:
                unseen[e] = unseen[e] or hidden
                out_tag[e] = out_tag[e] or tag in OUTSIDE_TAGS or (tag == "header" and not (in_tag[up] or in_name[up]))
                if region[e] < 0 and (named_out or out_tag[e]):
                    region[e] = e
        rows = []
        none = 0.5 if not any(t in INSIDE_TAGS for t in self.tags) else 0.0
        for e in at:
            a = around[e]
            mass = total[region[e] if region[e] >= 0 else a]
            rows.append((linked[a] / total[a], mass / total[0], in_tag[e] or none, in_name[e], out_tag[e], region[e] >= 0 and not out_tag[e]))
        return [not unseen[e] for e in at], np.array(rows, np.float64).reshape(-1, 6)


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of the blocks shown, in page order, and their own features, the columns of OWN.

    ``around`` is the smallest element about a block that holds another block too, of which
    the link density counts. ``share`` is the part of the page's words in that element, or
    in the marked region. ``inside_tag`` is a half for all blocks of pages without article and main. The ``outside`` columns are marks by tag or name of an element about the block
    that doesn't hold the article itself: neither the page's body, main and longest article
    nor what they stand in can be marked. Elements may nest to any depth."""
    texts: list[str] = []
    own: list[tuple] = []
    words: list[int] = []
    links: list[int] = []
    at_element: list[int] = []
    elements = _Elements()
    stack = [0]
    opened: Counter = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link = False
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = len(text.split(" "))
            k = min(n, len(html.unescape("".join(linked)).split()))
            tags = [elements.tags[e] for e in stack[-3:]]
            texts.append(text)
            words.append(n)
            links.append(k)
            at_element.append(stack[-1])
            own.append((n, k / n, not HEADINGS.isdisjoint(tags[-2:]), "li" in tags, text[-1] in ".!?…:\"'»”"))
        parts.clear()
        linked.clear()

    def take(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)

    def pop() -> None:
        opened[elements.tags[stack.pop()]] -= 1

    for token in _TOKEN.finditer(page):
        take(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if token["hidden"] or tag is None:
            continue
        tag = tag.lower()
        closing = bool(token["close"])
        if tag in INLINE:
            if tag == "br":
                take(" ")
            elif tag == "a":
                in_link = not closing
                linked.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                while elements.tags[stack[-1]] != tag:
                    pop()
                pop()
                in_link = False
            continue
        top = elements.tags[stack[-1]]
        if (tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and top == tag) or (tag in BREAKS_PARAGRAPH and top == "p"):
            pop()
        attributes = token["attributes"]
        stack.append(elements.add(stack[-1], tag, _marks(attributes) if attributes else (False, False, False)))
        opened[tag] += 1
    take(page[at:])
    flush()
    shown, about = elements.describe(at_element, words, links)
    rows = np.hstack([np.array(own, np.float64).reshape(-1, 5), about])
    return [t for t, s in zip(texts, shown, strict=True) if s], rows[np.array(shown, bool)]


def with_neighbours(own: np.ndarray, names: bool = True) -> np.ndarray:
    """The columns of FEATURES; beyond the ends of a page there are no words. Without ``names``
    nothing is marked inside or outside."""
    around = np.vstack([np.zeros((1, 2)), own[:, :2], np.zeros((1, 2))])
    rows = np.hstack([own[:, :2], around[:-2], around[2:], own[:, 2:]])
    if not names:
        rows[:, -4:] = 0
    return rows


#: The labelled table: pages as blocks of (label, path of the block, words, of them linked). A path
#: is elements from the outside in, names after dots are its classes. Some pages have no names, or
#: names that mislead.
LABELLED = [
    [
        (0, "nav ul li", 1, 1), (0, "nav ul li", 1, 1), (0, "nav ul li", 2, 2), (0, "div.ad", 8, 0), (1, "article h1", 9, 0),
        (1, "article p", 60, 0), (1, "article p", 1, 0), (1, "article p", 140, 3), (1, "article p", 25, 0), (0, "footer", 11, 0),
    ],
    [
        (0, "header h1", 3, 1), (0, "header nav ul li", 1, 1), (0, "header nav ul li", 1, 1), (1, "main h1", 6, 0), (1, "main p", 45, 1),
        (1, "main ul li", 5, 0), (1, "main ul li", 4, 0), (1, "main p", 80, 0), (0, "aside h3", 2, 0), (0, "aside ul li", 6, 6),
        (0, "aside p", 20, 0), (0, "main section.comments p", 30, 0), (0, "main section.comments p", 12, 0), (0, "footer p", 7, 2),
    ],
    [
        (0, "div.cookie-notice p", 24, 1), (0, "div.menu ul li", 1, 1), (0, "div.menu ul li", 2, 2), (1, "div.content h2", 5, 0),
        (1, "div.content p", 50, 0), (0, "div.content div.advert p", 14, 0), (1, "div.content p", 3, 0), (1, "div.content blockquote p", 22, 0),
        (0, "div.content div.share ul li", 1, 1), (0, "div.sidebar p", 30, 2), (0, "div.sidebar li", 4, 4), (0, "div.footer p", 16, 3),
    ],
    [
        (0, "div", 3, 3), (0, "div", 2, 2), (0, "div", 4, 3), (1, "h1", 8, 0), (1, "p", 70, 0), (1, "p", 33, 1), (1, "p", 90, 2), (1, "p", 6, 0),
        (1, "p", 48, 0), (0, "div", 2, 2), (0, "div", 3, 3), (0, "div", 5, 1),
    ],
    [
        (0, "td", 1, 1), (0, "td", 1, 1), (0, "td", 2, 2), (1, "td h2", 4, 0), (1, "td p", 110, 1), (1, "td p", 55, 0), (0, "form p", 12, 0),
        (0, "form label", 2, 0), (0, "td", 4, 2), (0, "td", 2, 2),
    ],
    [
        (0, "header p", 5, 0), (0, "header p", 18, 0), (1, "article header h1", 7, 0), (1, "article p", 12, 0), (1, "article h2", 3, 0),
        (1, "article p", 4, 2), (1, "article table td", 2, 0), (1, "article table td", 1, 0), (1, "article ol li", 10, 10), (1, "article p", 200, 0),
        (0, "article aside p", 40, 0), (0, "article footer p", 9, 1), (0, "div.comment p", 50, 0), (0, "div.newsletter form p", 15, 0),
    ],
    [
        (0, "div", 1, 0), (0, "ul li", 1, 1), (0, "ul li", 1, 1), (1, "p", 40, 0), (1, "p", 65, 0), (1, "p", 15, 0), (1, "p", 52, 0),
        (0, "ul li", 6, 6), (0, "ul li", 7, 7), (0, "p", 4, 3), (0, "div", 3, 0),
    ],
    [(1, "article h1", 5, 0), (1, "article p", 30, 0), (1, "article p", 2, 0)],
    [(1, "main p", 1, 0)],
    [(0, "ul li", 2, 2), (1, "article p", 30, 0), (1, "article p", 14, 0), (1, "article p", 3, 3), (1, "article p", 13, 0), (1, "article ul li", 2, 2), (1, "article ul li", 1, 1)],
    [(1, "main p", 3, 3), (1, "main ul li", 2, 2), (1, "main p", 20, 0), (0, "div", 3, 3), (0, "div", 5, 4)],
    [
        (0, "nav ul li", 1, 1), (1, "article h1", 2, 0), (1, "article p", 2, 0), (1, "article p", 1, 0), (1, "article p", 2, 0),
        (1, "article p", 3, 0), (1, "article p", 1, 0), (1, "article p", 70, 0), (1, "article p", 2, 0), (1, "article p", 2, 0), (0, "div", 2, 0),
    ],
    [(0, "div", 2, 0), (1, "main h2", 2, 0), (1, "main p", 2, 0), (1, "main p", 1, 0), (0, "div", 3, 0), (0, "div", 1, 0)],
    [(1, "article p", 3, 1), (1, "article p", 12, 8)],
    [
        (0, "nav ul li", 1, 1), (0, "nav ul li", 1, 1), (0, "nav ul li", 2, 2), (0, "div.ad", 14, 0), (1, "article h1", 10, 0), (1, "article p", 30, 0), (1, "article p", 1, 0),
        (1, "article p", 2, 0), (1, "article p", 1, 0), (1, "article p", 3, 0), (1, "article p", 5, 0), (1, "article p", 18, 0), (1, "article p", 2, 0), (0, "footer", 18, 0),
    ],
    [
        (0, "header nav ul li", 2, 2), (0, "header nav ul li", 3, 3), (0, "div.banner p", 25, 1), (1, "main h1", 12, 0), (1, "main p", 150, 0), (1, "main p", 22, 0), (1, "main p", 60, 0),
        (1, "main p", 7, 0), (1, "main p", 26, 0), (0, "form p", 8, 0), (0, "footer p", 28, 1),
    ],
    [(1, "h1", 6, 0), (1, "p", 44, 0), (1, "p", 10, 0)],
    [(1, "p", 24, 0)],
    [
        (0, "header p", 40, 0), (0, "div.cookie p", 35, 0), (1, "article p", 90, 0), (1, "article p", 70, 0), (0, "footer", 40, 0),
        (0, "aside p", 60, 0), (0, "div.ad p", 30, 0), (0, "form p", 45, 0), (0, "footer p", 25, 0),
    ],
    [
        (0, "div.notice p", 50, 0), (1, "h1", 6, 0), (1, "p", 40, 8), (1, "p", 64, 11), (1, "p", 25, 9), (1, "p", 90, 0), (1, "p", 40, 0), (1, "p", 66, 0), (0, "div.comments p", 70, 0),
        (0, "div.comments p", 44, 0), (0, "div.related p", 33, 0), (0, "footer p", 60, 0), (0, "div", 14, 14), (0, "p", 22, 19), (0, "div", 30, 24),
    ],
    [(1, "p", 1, 0)],
    [(1, "p", 3, 0)],
    [(1, "p", 5, 0)],
    [(1, "p", 8, 0)],
    [
        (0, "div", 4, 0), (0, "div", 6, 2), (1, "h1", 7, 0), (1, "p", 60, 0), (1, "p", 35, 0), (1, "p", 14, 0), (1, "p", 80, 0),
        (0, "p", 8, 0), (0, "div", 5, 0), (0, "p", 6, 1), (0, "div", 9, 0),
    ],
    [
        (0, "div", 7, 0), (0, "div", 5, 0), (0, "div", 3, 2), (1, "div h2", 5, 0), (1, "div p", 44, 0), (1, "div p", 52, 1), (1, "div p", 20, 0),
        (0, "div", 6, 0), (0, "div", 8, 3), (0, "div", 7, 0),
    ],
    [(1, "div.post h2", 4, 0), (1, "div.post p", 18, 0), (0, "div.comments div p", 35, 0), (0, "div.comments div p", 80, 0)],
    [(0, "ul li", 1, 1), (0, "ul li", 2, 2), (1, "article h1", 4, 0), (1, "article p", 7, 0), (0, "p", 5, 4)],
    [
        (0, "div ul li", 1, 1), (0, "div ul li", 2, 2), (0, "div ul li", 1, 1), (1, "div.promo h1", 7, 0), (1, "div.promo p", 80, 0), (1, "div.promo p", 120, 2),
        (1, "div.promo p", 64, 0), (1, "div.promo p", 95, 1), (0, "div ul li", 6, 6), (0, "div ul li", 8, 8), (0, "div", 4, 2),
    ],
    [
        (0, "div.content ul li", 1, 1), (0, "div.content ul li", 2, 2), (0, "div.content ul li", 2, 2), (0, "div.text ul li", 3, 3), (1, "div h1", 6, 0),
        (1, "div p", 75, 0), (1, "div p", 48, 2), (1, "div p", 110, 0), (0, "div.text ul li", 7, 7), (0, "div.text ul li", 6, 6), (0, "div.text ul li", 9, 9),
    ],
    [
        (0, "section ul li", 2, 2), (0, "section ul li", 1, 1), (1, "div.notice.story h2", 5, 0), (1, "div.notice.story p", 70, 1), (1, "div.notice.story p", 4, 0),
        (1, "div.notice.story p", 88, 0), (0, "div.sidebar p", 18, 0), (0, "div.sidebar ul li", 5, 5), (0, "footer p", 8, 1),
    ],
    [
        (1, "article.post.comments-open h1", 6, 0), (1, "article.post.comments-open p", 40, 0), (1, "article.post.comments-open p", 5, 0),
        (0, "section.comments article p", 30, 0), (0, "section.comments article p", 12, 0), (0, "div.sidebar ul li", 3, 3),
    ],
    [
        (0, "div ul li", 2, 2), (0, "div ul li", 1, 1), (0, "div ul li", 3, 3), (1, "div div h2", 8, 0), (1, "div div p", 55, 0),
        (1, "div div p", 9, 0), (1, "div div p", 72, 1), (1, "div div p", 31, 0), (0, "div ul li", 9, 9), (0, "div ul li", 7, 7),
    ],
]


def _labelled_page(rows: list[tuple[int, str, int, int]]) -> str:
    """The page of a labelled list; neighbours with the same first steps stand in the same elements."""
    out, at = [], []
    for _, path, words, links in rows:
        steps = path.split()
        same = 0
        while same < min(len(at), len(steps) - 1) and at[same] == steps[same]:
            same += 1
        out += [f"</{s.partition('.')[0]}>" for s in reversed(at[same:])]
        for step in steps[same:]:
            tag, _, names = step.partition(".")
            out.append(f"<{tag} class='{names.replace('.', ' ')}'>" if names else f"<{tag}>")
        plain = " ".join(["word"] * (words - links))
        stop = "." if plain and words > 3 and not path.endswith(("h1", "h2", "h3", "li", "label")) else ""
        out.append((f"<a href='#'>{' '.join(['link'] * links)}</a> " if links else "") + plain + stop + f"</{steps[-1].partition('.')[0]}>")
        at = steps[:-1]
    return "<body>" + "".join(out) + "</body>"


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 3):
    """A tree of (feature, threshold, below, above) with leaves of True and False, by Gini impurity,
    of at least ``least`` rows a side. Equal splits fall to the first feature and the lowest threshold."""
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for threshold in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= threshold
            if min(low.sum(), (~low).sum()) < least:
                continue
            cost = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(threshold), low)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, threshold, low = best
    return f, threshold, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, threshold, below, above = tree
    out, low = np.empty(len(x), bool), x[:, f] <= threshold
    out[low], out[~low] = classify(below, x[low]), classify(above, x[~low])
    return out


def labelled() -> list[list[tuple[int, str, int, int]]]:
    """The labelled pages at several sizes. A marked article may be of any length: its words are multiplied
    by each of MARKED_SCALES, and once it loses two of three blocks. Pages without such marks are multiplied as a whole."""
    out = []
    for rows in LABELLED:
        out.append(rows)
        marked = any(y and MARKS & set(path.replace(".", " ").split()) for y, path, _, _ in rows)
        for scale in MARKED_SCALES if marked else PLAIN_SCALES:
            sized = []
            for y, path, words, links in rows:
                n = max(1, round(words * scale)) if y or not marked else words
                sized.append((y, path, n, min(n, max(1, round(links * n / words))) if links else 0))
            out.append(sized)
        if marked:
            out.append([r for k, r in enumerate(rows) if not r[0] or k % 3 == 0 or not any(q[0] for q in rows[:k])])
    return out


def table(pages: list[list[tuple[int, str, int, int]]], names: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    xs, ys = [], []
    for rows in pages:
        texts, own = blocks(_labelled_page(rows))
        if len(texts) != len(rows):
            raise ValueError("a labelled row is not one block")
        xs.append(with_neighbours(own, names))
        ys += [bool(r[0]) for r in rows]
    return np.vstack(xs), np.array(ys)


@lru_cache(1)
def train():
    return grow(*table(labelled()))


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    texts, own = blocks(page)
    if not texts:
        return ""
    keep = classify(tree, with_neighbours(own))
    return "\n".join(t for t, k in zip(texts, keep.tolist(), strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars. Null, empty and markup-only pages have an
    empty text; a page cut off in the middle gives what it holds. Very long and deeply nested pages
    take time in proportion to their length. Repeated rows and null ids come back each."""
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                texts = [main_text(p, tree) for p in rows["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows["page_id"], rows["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
