"""Main text of web pages by line-block distribution.

Markup is stripped into blocks, one line a block. A line weighs the characters of its text that are not links. The
sums of the weights over a sliding window of lines form the distribution: text starts where the sums surge to the threshold, ends where
they dive to nothing, and every line between surge and dive is kept, links too: a line of links among paragraphs is text, a run of
them as long as a window is a menu. What the markup itself names page furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) is no line of the distribution, so it neither starves a surge nor makes a dive; where a page marks its
article, only lines inside are, and any weight there is a surge. Elsewhere the threshold keeps stray short lines out.

Names of classes and ids make furniture of what they are on outside of an article; inside one only a name that is a furniture word
itself, or has one that names no part of an article (an advert's, a share bar's), so ``legal-notice`` or ``side-effects`` are text.

Edge cases: null and empty html give an empty text; broken or unclosed markup is read as browsers do
(an end tag closes up to its start tag, one without a start tag is ignored, an open element lasts to
the end); very long pages are read whole, in time proportional to their length, however deep they nest; repeated rows give equal rows; an
empty table gives an empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines in a window, and the sum at which text starts on a page without a marked article.
WINDOW, SURGE = 3, 80
#: Share of a line's characters that may lie outside of its links while it still weighs nothing (separators between them).
BETWEEN = 0.4

#: HTML element names.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav footer aside form head menu dialog button select option label fieldset noscript template iframe object svg canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|xmp|noembed|noframes|title|math"
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that name page furniture in class and id attributes.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner promo promoted promotion sponsor sponsored sponsors"
    " nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toc skip"
    " masthead topbar header footer foot colophon copyright legal"
    " sidebar side aside rail widget widgets related recommended recommendations popular trending teaser"
    " notice notices cookie cookies consent gdpr alert popup modal overlay paywall subscribe subscription newsletter signup login"
    " comment comments commentlist respond reply replies disqus discussion"
    " share sharing social form search searchbox".split()
)
#: Those of the words that name furniture inside an article too, whatever stands with them.
INSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner promo promoted sponsor sponsored sponsors"
    " cookie cookies consent gdpr popup modal overlay paywall subscribe subscription newsletter signup login related recommended recommendations trending teaser"
    " comment comments commentlist respond reply replies disqus share sharing social breadcrumb breadcrumbs pagination navbar".split()
)
ABOUT = frozenset("has have no non not with without hide show under above below".split())
#: Elements that the next of their kind closes, and those in which that search ends.
CLOSED_BY_NEXT = frozenset("p li td th tr dt dd option".split())
SCOPES = frozenset("div ul ol dl table article section main blockquote aside nav form".split())
#: Names in a class that weigh less: on an article they describe it and do not make it furniture.
ARTICLE = frozenset(("article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def named(word: str, inside_article: bool) -> bool:
    """Whether a class or id names furniture itself, and not that something has some, or has none."""
    parts = [p.lower() for p in PART.findall(word)]
    if inside_article and len(parts) > 1:
        return any(p in INSIDE and not (k and parts[k - 1] in ABOUT) for k, p in enumerate(parts))
    return any(p in NAMES and not (k and parts[k - 1] in ABOUT) for k, p in enumerate(parts))


def is_furniture(tag: str, rest: str, inside_article: bool, names: bool = True) -> bool:
    if tag in FURNITURE or tag == "header" and not inside_article:
        return True
    if "=" not in rest and "hidden" not in rest or tag in ("html", "body"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if tag in ARTICLE and not any(p.startswith("comment") for p in map(str.lower, PART.findall(value))):
                continue
            if names and any(named(word, inside_article) for word in value.split()):
                return True
        elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", ATTRIBUTE.sub(" ", rest)))


class Open:
    """The open elements: for each, whether it is in furniture, in a marked article, and in a line that is furniture as a whole."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def state(self) -> tuple[bool, bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False, False)

    def push(self, tag: str, furniture: bool, article: bool, block: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, furniture, article, furniture if block else self.state()[2]))

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def close(self, tag: str, in_scope: bool = False) -> bool | None:
        """Closes up to the last ``tag``, if there is one (after the last scope); whether that ended a block."""
        found = self.places.get(tag)
        if not found or in_scope and self.scopes and self.scopes[-1] > found[-1]:
            return None
        at, block = found[-1], False
        while len(self.stack) > at:
            own = self.stack.pop()[0]
            self.places[own].pop()
            if own in SCOPES:
                self.scopes.pop()
            block = block or own in BLOCK
        return block


def blocks(page: str, names: bool = True) -> list[tuple[str, bool, bool, int]]:
    """(text, in furniture, in a marked article, characters of links) of each block with text, in page order.

    Furniture that stands in a line is left out of it. Without ``names`` only elements and roles make furniture.
    """
    out: list[tuple[str, bool, bool, int]] = []
    open_ = Open()
    furniture = article = line = False
    in_link = False
    parts: list[str] = []
    linked: list[str] = []
    at = 0

    def text_of(pieces: list[str]) -> str:
        return " ".join(html.unescape("".join(pieces)).split())

    def flush() -> None:
        if parts:
            text = text_of(parts)
            if text:
                out.append((text, line, article, len(text_of(linked)) if linked else 0))
            parts.clear()
        linked.clear()

    def add(piece: str) -> None:
        if furniture == line:
            parts.append(piece)
            if in_link:
                linked.append(piece)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() == "title":
                flush()
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["end"]
            continue
        block = tag in BLOCK
        if m["end"]:
            if block and not open_.has(tag):
                flush()
            elif open_.has(tag):
                if any_block(open_, tag):
                    flush()
                open_.close(tag)
                furniture, article, line = open_.state()
            continue
        if not block and tag not in FURNITURE and "=" not in m["rest"] and "hidden" not in m["rest"] and not open_.has(tag):
            continue
        if block:
            flush()
        new = is_furniture(tag, m["rest"], article, names)
        if tag in VOID or m["rest"].endswith("/") and not block:
            continue
        if tag in CLOSED_BY_NEXT and open_.close(tag, in_scope=True) is not None:
            furniture, article, line = open_.state()
        if not block and not new and not open_.has(tag):
            continue
        open_.push(tag, furniture or new, (article or tag in ARTICLE) and not (tag in ARTICLE and new), block)
        furniture, article, line = open_.state()
    if at < len(page):
        add(page[at:])
    flush()
    return out


def any_block(open_: Open, tag: str) -> bool:
    """Whether the end of ``tag`` ends a block: it is one, or one is open inside of it."""
    at = open_.places[tag][-1]
    return tag in BLOCK or any(open_.places.get(b) and open_.places[b][-1] > at for b in BLOCK)


def main_text(page: str | None) -> str:
    """The page's main text, one line a block.

    Where the names of classes leave nothing (a wrapper that is named after what stands in it), they are not looked at.
    """
    return kept_text(blocks(page or "")) or kept_text(blocks(page or "", names=False))


def weight_of(text: str, linked: int) -> int:
    """Characters outside of links; none if little but separators is."""
    rest = len(text) - linked
    return rest if not linked or rest > BETWEEN * len(text) else 0


def between_surge_and_dive(weights: list[int], window: int, surge: int) -> list[int]:
    """Places from where a window's sum reaches ``surge`` to where one is nothing."""
    n, kept = len(weights), []
    total, sums = 0, [0] * n
    for i in range(n - 1, -1, -1):  # sums[i]: of the window that starts at i
        total += weights[i] - (weights[i + window] if i + window < n else 0)
        sums[i] = total
    k = 0
    while k < n:
        if sums[k] >= surge and weights[k]:
            end = k
            while end < n and sums[end]:
                end += 1
            kept += range(k, end)
            k = end
        k += 1
    return kept


def kept_text(lines: list[tuple[str, bool, bool, int]], window: int = WINDOW) -> str:
    marked = any(inside and not furniture for _, furniture, inside, _ in lines)
    own = [(text, weight_of(text, linked)) for text, furniture, inside, linked in lines if not furniture and (inside or not marked)]
    weights = [w for _, w in own]
    surge = 1 if marked else min(SURGE, max(weights, default=0))
    kept = between_surge_and_dive(weights, window, max(1, surge))
    return "\n".join(own[i][0] for i in kept)


@F.pandas_udf(T.StringType())
def main_text_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([main_text(x) for x in batch], dtype=object)


def extract_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars for each row of ``pages``; no shuffle."""
    out = pages.select(key, "url", main_text_udf(F.col("html")).alias("text"))
    return out.select(key, "url", "text", F.length("text").cast("long").alias("n_chars"))
