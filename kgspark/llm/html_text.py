"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags.  A block's features are its word count and link density, those of
the blocks before and after it, the longest text before and after it that no block of links parts from it, and what kind
of element it stands in; the tree is grown from the small labelled table below.  In pages with a main element what is
unmarked in it is text; in all others the words and links of a block and its neighbours decide.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

# Elements and words that mark what is not the main text (fixed values).
SKIPPED = frozenset("script style head title noscript template svg iframe object canvas math select option textarea button audio video".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of a class or id for what is never main text, however long it is.
FIRM_HINTS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|repl(?:y|ies)|respond|disqus\w*|cookie\w*|consent|newsletter|subscribe\w*|signup|login|share\w*|sharing|social\w*|popup|modal|breadcrumbs?|pager|pagination)(?:$|[_-])",
    re.I,
)
# Words that also name a layout: what holds most of the text is not what they say.
LAYOUT_HINTS = re.compile(
    r"(?:^|[_-])(?:banner|nav\w*|menu\w*|side(?:bar|nav)?|sidebar\w*|widget\w*|foot\w*|masthead|header|notice\w*|alert|related\w*|recommend\w*|legal|copyright|disclaimer|toolbar|search)(?:$|[_-])",
    re.I,
)
# Names that say what an element lacks, has or shows, not what it is.
_ABOUT = re.compile(r"(?:no|not|has|with|without|is|show|hide)[_-]|.*[_-](?:free|open|closed|enabled|disabled|on|off)$", re.I)
# Elements that are text themselves; of the layout words only one marks them.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th".split())
# Elements that hold running text.
RUNNING = frozenset(("p", "blockquote", "pre"))
# Roles of an element that is not main text (fixed values).
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?/][^>]*(?:>|$)|<[A-Za-z][^<>]*$|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|"[^"]*"|'[^']*'""")
_SPACES = re.compile(r"\s+")


@dataclass
class Block:
    """One flat text block: its text, words inside links, and the elements it stands in."""

    text: str
    words: int
    link_words: int
    boilerplate: int
    main: int
    heading: int
    paragraph: int
    hints: tuple[int, ...] = ()

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def _hint(tag: str, value: str) -> int:
    """What a class or id says of an element: 2 for no main text, 1 for a word that may name a layout, 0 for neither."""
    names = [x for x in value.split() if not _ABOUT.match(x)]
    if any(FIRM_HINTS.search(x) for x in names):
        return 2
    if tag in PARAGRAPHS or tag in ("article", "main"):
        return int(tag in PARAGRAPHS and any(x.lower() == "copyright" for x in names))
    return int(any(LAYOUT_HINTS.search(x) for x in names))


def _flags(tag: str, attributes: str, inside_main: bool) -> tuple[int, int, int]:
    """(boilerplate, main) of an element by its name and role, and what its class or id hints at."""
    boilerplate, main = int(tag in BOILERPLATE or (tag == "header" and not inside_main)), int(tag in ("article", "main"))
    hint = 0
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            boilerplate |= int(value.lower() in ROLES)
            main |= int(value.lower() in ("main", "article"))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            boilerplate |= 1
        elif name in ("class", "id") and tag not in ("body", "html"):
            hint = max(hint, _hint(tag, html.unescape(value)))
    return boilerplate, main, hint


def _weigh_hints(found: list[Block], firm: set[int]) -> None:
    """Blocks in a hinted element are boilerplate.  A layout word counts for nothing where its element holds most
    unlinked words of the main elements, or of the page if those have none; a firm one always counts."""
    for b in found:
        b.boilerplate |= int(any(h in firm for h in b.hints))
    open_to_all = [b for b in found if not b.boilerplate]
    inside = [b for b in open_to_all if b.main and b.words > b.link_words] or open_to_all
    held: dict[int, int] = {}
    for b in inside:
        for h in b.hints:
            held[h] = held.get(h, 0) + b.words - b.link_words
    half = sum(b.words - b.link_words for b in inside) / 2
    for b in open_to_all:
        b.boilerplate |= int(any(held.get(h, 0) <= half for h in b.hints))


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; character references decoded, white space inside a block made one space."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []
    hints: list[int] = []
    firm: set[int] = set()
    pieces: list[tuple[str, bool]] = []
    links = skipped = boilerplate = main = heading = hinted = 0
    within = ""

    def close() -> None:
        nonlocal pieces
        if pieces:
            text = _SPACES.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip()
            if text:
                linked = sum(len(html.unescape(p).split()) for p, is_link in pieces if is_link)
                out.append(Block(text, len(text.split()), linked, int(boilerplate > 0), int(main > 0), int(heading > 0), int(within in RUNNING), tuple(hints)))
            pieces = []

    def leave(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal boilerplate, main, links, skipped, heading
        for name, b, a, h in stack[k:]:
            boilerplate, main = boilerplate - b, main - a
            links -= name == "a"
            skipped -= name in SKIPPED
            heading -= name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if h:
                hints.remove(h)
        del stack[k:]

    for m in _TOKEN.finditer(page):
        whole, tag = m.group(0), m.group(3)
        if not tag:
            if whole[0] != "<" or whole == "<":
                if not skipped:
                    pieces.append((whole, links > 0))
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            close()
            within = tag if not m.group(2) else ""
        elif tag == "br":
            pieces.append((" ", False))
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
        elif tag not in VOID and not m.group(4).rstrip().endswith("/"):
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                leave(len(stack) - 1)
            # the end tag of head may be left out
            elif tag in BLOCKS and tag != "html" and skipped:
                heads = [k for k, x in enumerate(stack) if x[0] == "head"]
                if heads:
                    leave(heads[0])
            b, a, h = _flags(tag, m.group(4), main > 0)
            if a or tag == "h1":
                # what holds the main element or the headline is not what a word of its class says
                firm.difference_update(hints)
            if h:
                hinted += 1
                hints.append(hinted)
                if h == 2:
                    firm.add(hinted)
                    a = 0
                h = hinted
            stack.append((tag, b, a, h))
            boilerplate, main = boilerplate + b, main + a
            links += tag == "a"
            skipped += tag in SKIPPED
            heading += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    _weigh_hints(out, firm)
    return out


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "text_before", "text_after", "boilerplate", "main", "heading", "paragraph",
    "page_has_main",
)

# Labelled blocks of pages (fixed training values), in page order: (words, words in links, boilerplate, main, heading,
# paragraph, whether it is main text).  Few pages mark their main element, and not all that is no main text is marked.
PAGES = (
    # news, unmarked: menu, headline, byline, paragraphs, teasers, footer
    ((1, 1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (9, 0, 0, 0, 1, 0, 1), (4, 0, 0, 0, 0, 0, 0), (48, 0, 0, 0, 0, 1, 1), (71, 2, 0, 0, 0, 1, 1), (33, 0, 0, 0, 0, 1, 1), (7, 0, 0, 0, 1, 0, 1), (56, 1, 0, 0, 0, 1, 1), (14, 0, 0, 0, 0, 1, 1), (62, 3, 0, 0, 0, 1, 1), (2, 0, 0, 0, 1, 0, 0), (9, 9, 0, 0, 0, 0, 0), (11, 11, 0, 0, 0, 0, 0), (8, 8, 0, 0, 0, 0, 0), (6, 3, 0, 0, 0, 0, 0)),
    # weblog, unmarked, with a link list beside the text
    ((3, 3, 0, 0, 1, 0, 0), (6, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (6, 0, 0, 0, 1, 0, 1), (88, 4, 0, 0, 0, 1, 1), (120, 0, 0, 0, 0, 1, 1), (22, 6, 0, 0, 0, 1, 1), (95, 1, 0, 0, 0, 1, 1), (41, 0, 0, 0, 0, 1, 1), (5, 4, 0, 0, 0, 0, 0), (2, 0, 0, 0, 1, 0, 0), (3, 3, 0, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0), (18, 15, 0, 0, 0, 0, 0)),
    # recipe: ingredients are short and stand together between paragraphs
    ((1, 1, 1, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0, 0), (4, 0, 0, 1, 1, 0, 1), (36, 0, 0, 1, 0, 1, 1), (3, 0, 0, 1, 0, 0, 1), (3, 0, 0, 1, 0, 0, 1), (4, 0, 0, 1, 0, 0, 1), (2, 0, 0, 1, 0, 0, 1), (25, 0, 0, 1, 0, 1, 1), (30, 2, 0, 1, 0, 1, 1), (4, 0, 0, 0, 0, 0, 0), (38, 0, 1, 0, 0, 0, 0), (9, 2, 1, 0, 0, 0, 0)),
    # article element with a list of links at its end
    ((2, 2, 1, 0, 0, 0, 0), (8, 0, 0, 1, 1, 0, 1), (64, 0, 0, 1, 0, 1, 1), (5, 0, 0, 1, 0, 0, 1), (77, 5, 0, 1, 0, 1, 1), (19, 1, 0, 1, 0, 1, 1), (1, 0, 0, 1, 0, 0, 1), (44, 0, 0, 1, 0, 1, 1), (7, 7, 0, 1, 0, 0, 1), (8, 8, 0, 1, 0, 0, 1), (6, 6, 0, 1, 0, 0, 1), (5, 5, 0, 1, 0, 0, 1), (10, 1, 1, 0, 0, 0, 0)),
    # article element; notice, newsletter form and comments are marked, an advert is not
    ((16, 1, 1, 0, 0, 0, 0), (5, 0, 0, 1, 1, 0, 1), (52, 0, 0, 1, 0, 1, 1), (21, 0, 1, 1, 0, 0, 0), (8, 0, 0, 1, 0, 0, 1), (43, 0, 0, 1, 0, 1, 1), (80, 2, 0, 1, 0, 1, 1), (6, 0, 1, 1, 0, 0, 0), (12, 0, 0, 0, 0, 0, 0), (34, 0, 1, 0, 0, 0, 0), (52, 0, 1, 0, 0, 0, 0), (28, 0, 1, 1, 0, 0, 0), (7, 0, 1, 0, 0, 0, 0)),
    # encyclopedia, unmarked: long paragraphs with many links, a box of links
    ((1, 1, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0), (2, 0, 0, 0, 1, 0, 1), (110, 24, 0, 0, 0, 1, 1), (84, 21, 0, 0, 0, 1, 1), (3, 0, 0, 0, 1, 0, 1), (130, 30, 0, 0, 0, 1, 1), (59, 17, 0, 0, 0, 1, 1), (40, 37, 0, 0, 0, 0, 0), (26, 26, 0, 0, 0, 0, 0), (31, 28, 0, 0, 0, 0, 0), (20, 4, 0, 0, 0, 1, 0)),
    # shop, unmarked: short lines without links, one description
    ((2, 2, 0, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0, 0), (5, 0, 0, 0, 1, 0, 1), (46, 0, 0, 0, 0, 1, 1), (29, 0, 0, 0, 0, 1, 1), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0), (5, 5, 0, 0, 0, 0, 0)),
    # home page: teasers only
    ((1, 1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (7, 7, 0, 0, 1, 0, 0), (17, 2, 0, 0, 0, 1, 0), (8, 8, 0, 0, 1, 0, 0), (15, 2, 0, 0, 0, 1, 0), (6, 6, 0, 0, 1, 0, 0), (16, 2, 0, 0, 0, 1, 0), (9, 9, 0, 0, 1, 0, 0), (3, 0, 0, 0, 0, 0, 0), (5, 5, 0, 0, 0, 0, 0)),
    # manual, main element: short steps and headings
    ((1, 1, 1, 0, 0, 0, 0), (3, 3, 1, 0, 0, 0, 0), (3, 0, 0, 1, 1, 0, 1), (18, 0, 0, 1, 0, 1, 1), (6, 0, 0, 1, 0, 0, 1), (4, 0, 0, 1, 0, 0, 1), (2, 0, 0, 1, 1, 0, 1), (9, 0, 0, 1, 0, 1, 1), (3, 1, 0, 1, 0, 0, 1), (26, 3, 0, 1, 0, 1, 1), (2, 2, 0, 1, 0, 0, 1), (2, 2, 0, 1, 0, 0, 1), (11, 0, 0, 0, 0, 0, 0)),
    # forum and letter, unmarked: long first text, marked replies
    ((2, 2, 0, 0, 0, 0, 0), (7, 0, 0, 0, 1, 0, 1), (66, 0, 0, 0, 0, 1, 1), (24, 0, 0, 0, 0, 1, 1), (13, 0, 0, 0, 0, 1, 1), (39, 0, 0, 0, 0, 1, 1), (30, 0, 1, 0, 0, 0, 0), (61, 2, 1, 0, 0, 0, 0), (8, 0, 1, 0, 0, 0, 0), (4, 2, 0, 0, 0, 0, 0)),
    # article element without text but for its heading; long marked parts around it
    ((40, 3, 1, 0, 0, 0, 0), (6, 0, 0, 1, 1, 0, 1), (90, 0, 1, 0, 0, 0, 0), (55, 30, 1, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0)),
    # page of one text
    ((75, 0, 0, 0, 0, 1, 1), (102, 3, 0, 0, 0, 1, 1), (15, 0, 0, 0, 0, 1, 1), (54, 0, 0, 0, 0, 1, 1)),
    # news, main element: unmarked notice before it, pager inside it
    ((22, 2, 0, 0, 0, 1, 0), (1, 1, 0, 0, 0, 0, 0), (10, 0, 0, 1, 1, 0, 1), (3, 0, 0, 1, 0, 0, 1), (57, 0, 0, 1, 0, 1, 1), (68, 8, 0, 1, 0, 1, 1), (32, 0, 0, 1, 0, 1, 1), (1, 1, 0, 1, 0, 0, 1), (1, 1, 0, 1, 0, 0, 1), (1, 1, 0, 1, 0, 0, 1), (25, 0, 0, 0, 0, 1, 0), (14, 0, 0, 0, 0, 1, 0)),
    # unmarked: dialogue between long paragraphs, subheads, a short list and a short last paragraph
    ((2, 2, 0, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0, 0), (3, 0, 0, 0, 1, 0, 1), (2, 0, 0, 0, 0, 1, 1), (41, 0, 0, 0, 0, 1, 1), (3, 0, 0, 0, 0, 1, 1), (2, 0, 0, 0, 0, 1, 1), (6, 0, 0, 0, 0, 1, 1), (58, 1, 0, 0, 0, 1, 1), (4, 0, 0, 0, 1, 0, 1), (37, 0, 0, 0, 0, 1, 1), (2, 0, 0, 0, 0, 0, 1), (5, 0, 0, 0, 0, 0, 1), (27, 0, 0, 0, 0, 1, 1), (3, 0, 0, 0, 0, 1, 1), (2, 0, 0, 0, 1, 0, 0), (7, 7, 0, 0, 0, 0, 0), (9, 9, 0, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0, 0)),
    # letter of short paragraphs, unmarked
    ((5, 5, 0, 0, 0, 0, 0), (4, 0, 0, 0, 1, 0, 1), (11, 0, 0, 0, 0, 1, 1), (15, 0, 0, 0, 0, 1, 1), (9, 0, 0, 0, 0, 1, 1), (13, 0, 0, 0, 0, 1, 1), (2, 0, 0, 0, 0, 1, 1), (6, 3, 0, 0, 0, 0, 0)),
    # article element with a paragraph and list items that are links for the most part, and marked comments longer than it
    ((3, 3, 1, 0, 0, 0, 0), (4, 0, 0, 1, 1, 0, 1), (38, 0, 0, 1, 0, 1, 1), (16, 9, 0, 1, 0, 1, 1), (4, 4, 0, 1, 0, 0, 1), (6, 6, 0, 1, 0, 0, 1), (33, 1, 0, 1, 0, 1, 1), (70, 2, 1, 1, 0, 1, 0), (12, 12, 0, 0, 0, 0, 0), (25, 0, 0, 0, 0, 1, 0)),
    # short texts and short last paragraphs, unmarked, with a line of print below some
    ((2, 2, 0, 0, 0, 0, 0), (6, 0, 0, 0, 1, 0, 1), (30, 0, 0, 0, 0, 1, 1), (44, 1, 0, 0, 0, 1, 1), (7, 0, 0, 0, 0, 1, 1), (8, 0, 0, 0, 0, 0, 0)),
    ((3, 3, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (5, 0, 0, 0, 1, 0, 1), (52, 0, 0, 0, 0, 1, 1), (9, 0, 0, 0, 0, 1, 1), (4, 0, 0, 0, 0, 1, 1)),
    ((8, 0, 0, 0, 1, 0, 1), (21, 0, 0, 0, 0, 1, 1), (12, 0, 0, 0, 0, 1, 1), (2, 0, 0, 0, 0, 1, 1), (9, 0, 0, 0, 0, 0, 0)),
    ((2, 2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 1, 0, 1), (9, 0, 0, 0, 0, 1, 1)),
    ((1, 1, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0), (6, 0, 0, 0, 1, 0, 1), (14, 0, 0, 0, 0, 1, 1), (3, 0, 0, 0, 0, 1, 1), (5, 1, 0, 0, 0, 0, 0)),
    ((4, 4, 0, 0, 0, 0, 0), (7, 0, 0, 0, 1, 0, 1), (5, 0, 0, 0, 0, 1, 1), (63, 2, 0, 0, 0, 1, 1), (1, 0, 0, 0, 0, 1, 1), (6, 0, 0, 0, 0, 1, 1), (10, 2, 0, 0, 0, 0, 0)),
    # speech between paragraphs, unmarked, with menus right before and after the text
    ((1, 1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0), (3, 0, 0, 0, 1, 0, 1), (50, 0, 0, 0, 0, 1, 1), (3, 0, 0, 0, 0, 1, 1), (1, 0, 0, 0, 0, 1, 1), (48, 0, 0, 0, 0, 1, 1), (4, 4, 0, 0, 0, 0, 0)),
    ((2, 2, 0, 0, 0, 0, 0), (34, 0, 0, 0, 0, 1, 1), (4, 0, 0, 0, 0, 1, 1), (2, 0, 0, 0, 0, 1, 1), (3, 0, 0, 0, 0, 1, 1), (57, 0, 0, 0, 0, 1, 1), (16, 0, 0, 0, 0, 1, 1), (1, 1, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0, 0)),
    ((3, 3, 0, 0, 0, 0, 0), (6, 0, 0, 0, 1, 0, 1), (22, 0, 0, 0, 0, 1, 1), (61, 3, 0, 0, 0, 1, 1), (2, 0, 0, 0, 0, 1, 1), (85, 2, 0, 0, 0, 1, 1), (4, 0, 0, 0, 0, 1, 1), (6, 6, 0, 0, 0, 0, 0), (5, 5, 0, 0, 0, 0, 0), (7, 0, 0, 0, 0, 0, 0)),
    # weblog entries with links in the text, unmarked, right before link lists
    ((2, 2, 0, 0, 0, 0, 0), (5, 0, 0, 0, 1, 0, 1), (40, 1, 0, 0, 0, 1, 1), (62, 9, 0, 0, 0, 1, 1), (30, 0, 0, 0, 0, 1, 1), (5, 5, 0, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0, 0)),
    ((1, 1, 0, 0, 0, 0, 0), (4, 0, 0, 0, 1, 0, 1), (25, 6, 0, 0, 0, 1, 1), (12, 2, 0, 0, 0, 1, 1), (7, 1, 0, 0, 0, 1, 1), (3, 3, 0, 0, 0, 0, 0), (6, 6, 0, 0, 0, 0, 0)),
    ((3, 3, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0, 0), (9, 0, 0, 0, 1, 0, 1), (33, 5, 0, 0, 0, 1, 1), (5, 0, 0, 0, 0, 1, 1), (2, 2, 0, 0, 0, 0, 0), (8, 1, 0, 0, 0, 0, 0)),
)


def _texts(found) -> list[int]:
    """For each block the words of the longest one before it, back to the last one of links; marked ones count for nothing."""
    out, longest = [], 0
    for words, linked, boilerplate, *_ in found:
        out.append(longest)
        if 3 * linked > 2 * words:
            longest = 0
        elif not boilerplate:
            longest = max(longest, words)
    return out


def rows_of_page(found: list[tuple[int, ...]]) -> list[tuple[float, ...]]:
    """FEATURES of the blocks of a page: (words, words in links, boilerplate, main, heading, paragraph) in page order."""
    has_main = int(any(b[3] for b in found))
    ends = [(0, 0.0), *((w, linked / w if w else 0.0) for w, linked, *_ in found), (0, 0.0)]
    texts = zip(_texts(found), _texts(found[::-1])[::-1], strict=True)
    return [(*ends[k + 1], *ends[k], *ends[k + 2], *text, *b[2:6], has_main) for k, (b, text) in enumerate(zip(found, texts, strict=True))]


def _rows(pages) -> tuple:
    return tuple((*row, block[6]) for page in pages for row, block in zip(rows_of_page([b[:6] for b in page]), page, strict=True))


def _variants(pages) -> list:
    """The pages as they are, with their text in a main element, with all else in marked elements and with both; the
    latter two also with what is marked in paragraphs, and the first also with its text in plain elements if no short
    paragraphs end it."""
    plain = [page for page in pages if [b[0] for b in page if b[5] and b[6]][-1:] >= [12]]
    out = [*pages, *([(w, linked, b, m, h, p * (1 - y), y) for w, linked, b, m, h, p, y in page] for page in plain)]
    for marked_text, marked_rest, paragraphs in ((1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 1, 1), (1, 1, 1)):
        for page in pages:
            rows = [(w, linked, int(b or (marked_rest and not y)), int(m or (marked_text and y)), h, p, y) for w, linked, b, m, h, p, y in page]
            out.append([(w, linked, b, m, h, int(p or (paragraphs and not h and not y)), y) for w, linked, b, m, h, p, y in rows])
    return out


LABELLED = _rows(_variants(PAGES))


@dataclass
class Node:
    """A split at ``feature <= at``, or a leaf if feature is None."""

    main_text: bool
    feature: int | None = None
    at: float = 0.0
    below: Node | None = None
    above: Node | None = None


#: What the page's markup says; splits on it come first, so that words and links judge what is not marked.
MARKED = tuple(map(FEATURES.index, ("boilerplate", "main", "page_has_main")))


def grow(rows, depth: int = 12, least: int = 3) -> Node:
    """A decision tree by Gini impurity with ``least`` rows or more in each leaf; ties go to the feature named first, then the lower threshold.

    A split on a MARKED feature that lowers the impurity goes before all others.
    """
    table = np.array(rows, float)
    x, y = table[:, :-1], table[:, -1]
    node = Node(bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.sum() in (0, len(y)):
        return node
    impurity = lambda yes, n: 2 * yes * (n - yes) / n
    best = impurity(y.sum(), len(y)) - 1e-9
    for f in sorted(range(len(FEATURES)), key=lambda f: f not in MARKED):
        if f not in MARKED and node.feature in MARKED:
            break
        order = np.argsort(x[:, f], kind="stable")
        values, yes, n = x[order, f], np.cumsum(y[order])[:-1], np.arange(1, len(y))
        parted = impurity(yes, n) + impurity(y.sum() - yes, len(y) - n)
        parted[(values[1:] == values[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        k = int(parted.argmin())
        if parted[k] < best - 1e-9:
            best, node.feature, node.at = parted[k], f, float(values[k] + values[k + 1]) / 2
    if node.feature is not None:
        low = x[:, node.feature] <= node.at
        node.below, node.above = grow(table[low], depth - 1, least), grow(table[~low], depth - 1, least)
    return node


def classify(tree: Node, row) -> bool:
    while tree.feature is not None:
        tree = tree.below if row[tree.feature] <= tree.at else tree.above
    return tree.main_text


def main_blocks(page: str, tree: Node) -> list[str]:
    found = blocks(page)
    rows = rows_of_page([(b.words, b.link_words, b.boilerplate, b.main, b.heading, b.paragraph) for b in found])
    return [b.text for b, row in zip(found, rows, strict=True) if classify(tree, row)]


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text (main blocks joined by a line break, empty if none) and n_chars of every page.

    Null or empty html, and pages without main text, give an empty text.  Other columns are ignored; repeated rows
    are treated alike.
    """
    tree = tree or grow(LABELLED)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"

    def rows_of(batch):
        texts = ["\n".join(main_blocks(page, tree)) if page else "" for page in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts}

    return over_batches(pages.select("page_id", "url", "html"), rows_of, schema).withColumn("n_chars", F.length("text").cast("long"))
