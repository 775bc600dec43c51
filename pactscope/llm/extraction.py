"""Main text of web pages by two-pass block rules.

A page becomes a row of blocks. The first pass decides blocks by where they stand, by link density, stop-word density and
length; short and doubtful blocks stay open. In the second pass these take the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to a in is that for it was on are as with be by this from at or an not have but which you he his they
    der die das und ein eine zu den von mit ist im dem nicht des auf für sich als auch es an er sie aus bei nach wie
    le la les de des et un une que est en du dans pour qui sur pas au avec ce il elle sont par plus ne se
    el los las y del por con una su para al lo como más pero sus o este si porque esta son entre cuando muy sin
    """.split()
)

#: What ends a sentence or a part of it in scripts that may lack spaces.
SENTENCE_ENDS = frozenset("。！？、，；：．।॥။។")
#: Characters for each word from which on a text counts as unspaced, and characters of a sentence part at most.
UNSPACED, SENTENCE = 15, 60

#: Elements whose content is never text, elements that hold boilerplate, and elements that hold the main text.
DROPPED = frozenset("noscript template svg math iframe object select button canvas audio video".split())
#: Dropped elements that hold no tags: without their own end they go on to the end of the page.
RAW = "script|style|textarea|title"
BOILERPLATE = frozenset("nav footer aside form menu dialog header".split())
CONTENT = frozenset("article main".split())
BLOCKS = frozenset(
    """address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class names and ids that mark boilerplate, and that mark the main text.
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|foot|comments?|disqus|replies|"
    r"reply|respond|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|search|pagination|pager|"
    r"toolbar|skip|hidden|copyright)(?=$|[\s_-]|\d)",
    re.I,
)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:articlebody|article-body|post-content|entry-content|article|story|content-body)(?=$|[\s_-])", re.I)

_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<drop>{RAW})(?=[\s>/])[^>]*(?:(?<=/)>|>.*?(?:</(?P=drop)\s*>|\Z))|<!\[CDATA\[.*?\]\]>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAME = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

GOOD, BAD, OPEN, NEAR = 1, -1, 0, 2


@dataclass
class Block:
    """Text between block elements: where it stands (-1 boilerplate, 1 main text, 0 unknown) and its text inside links."""

    text: str
    place: int
    linked: int
    heading: bool


def blocks_of(page: str, trust: bool = True) -> list[Block]:
    """The blocks of a page, in order. Unclosed, stray and crossed tags are allowed.

    Without ``trust``, an article ends all boilerplate that is open: it may have never been closed.
    """
    found: list[Block] = []
    # open elements that say something: (tag, what they say)
    stack: list[tuple[str, int]] = []
    parts: list[tuple[str, bool]] = []
    links, heading = 0, False
    # how many of each tag are open, and the open tags from a dropped element on
    opened, dropped = Counter(), []

    def place() -> int:
        said = 0
        for _, what in stack:
            said = what or said
            if what == BAD:
                return BAD
        return said

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                inside = len(" ".join(html.unescape("".join(t for t, linked in parts if linked)).split()))
                found.append(Block(text, place(), inside, heading))
            parts.clear()

    at = 0
    for piece in _PIECE.finditer(page):
        if piece.start() > at and not dropped:
            parts.append((page[at : piece.start()], links > 0))
        at = piece.end()
        tag = piece["tag"]
        if tag is None:
            if piece["drop"] is None and piece[0].startswith("<![CDATA[") and not dropped:
                parts.append((piece[0][9:-3], links > 0))
            continue
        tag = tag.lower()
        alone = tag in VOID or piece["rest"].endswith("/")
        if dropped:
            if not piece["close"]:
                if not alone:
                    dropped.append(tag)
                continue
            if tag in dropped:
                while dropped.pop() != tag:
                    pass
                continue
            if not opened[tag]:
                continue
            dropped.clear()  # never closed: it ends with its parent
        if tag in DROPPED:
            if not piece["close"] and not alone:
                dropped.append(tag)
            continue
        if not alone:
            opened[tag] = max(0, opened[tag] + (-1 if piece["close"] else 1))
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag == "a":
            links = max(0, links + (-1 if piece["close"] else 1)) if not piece["rest"].endswith("/") else links
            continue
        if tag not in BLOCKS and tag not in CONTENT:
            # inline: only hidden ones matter
            if not piece["close"] and tag not in VOID and _HIDDEN.search(piece["rest"]) and not piece["rest"].endswith("/"):
                end_block()
                stack.append((tag, BAD))
            elif piece["close"] and stack and stack[-1][0] == tag:
                end_block()
                stack.pop()
            continue
        end_block()
        links = 0
        if tag in HEADINGS:
            heading = not piece["close"]
        else:
            heading = heading and tag not in ("p", "li", "td", "article", "section")
        if tag in VOID or tag == "p":
            if tag == "p" and not piece["close"] and stack and stack[-1][0] == "p":
                stack.pop()
        if piece["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID or piece["rest"].endswith("/"):
            continue
        names = " ".join(a or b or c for a, b, c in _NAME.findall(piece["rest"]))
        if _HIDDEN.search(f" {piece['rest']}"):
            said = BAD
        elif tag in BOILERPLATE:
            # the heading of an article often stands in a header of its own
            said = OPEN if tag == "header" and any(t in CONTENT for t, _ in stack) else BAD
        elif names and BAD_NAMES.search(names) and tag not in ("body", "html"):
            said = BAD
        elif tag in CONTENT or names and GOOD_NAMES.search(names):
            said = GOOD
        else:
            said = OPEN
        if said == GOOD and not trust:
            stack = [(t, OPEN if what == BAD else what) for t, what in stack]
        if tag != "p" or said != OPEN:
            stack.append((tag, said))
    if at < len(page) and not dropped:
        parts.append((page[at:], links > 0))
    end_block()
    return found


def _words(text: str) -> list[str]:
    return text.lower().split()


def _known_stops(text: str) -> float:
    words = _words(text)
    return sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)


def _any_stops(text: str) -> float:
    """What stands for the share of function words where they aren't known.

    Function words are short, so words of up to three letters count twice (they are about half as frequent as needed). In
    scripts without spaces there are no words to count; there it is the sentences that tell prose from lists.
    """
    words = _words(text)
    if len(text) > UNSPACED * len(words):
        ends = sum(c in SENTENCE_ENDS for c in text)
        return 1.0 if ends * SENTENCE >= len(text) else 0.2 if ends else 0.0
    stripped = (w.strip(".,;:!?\u060c\u061b\u061f") for w in words)
    return 2 * sum(len(w) <= 3 and w.isalpha() for w in stripped) / len(words)


def _measure_of(blocks: list[Block], short: int, sparse: float) -> Callable[[str], float]:
    """The measure of function words that fits the page: the known ones, unless its prose has next to none of them."""
    prose = [b.text for b in blocks if b.place != BAD and not b.heading and len(b.text) >= short and 3 * b.linked < len(b.text)]
    words = sum(len(_words(t)) for t in prose)
    known = sum(_known_stops(t) * len(_words(t)) for t in prose)
    return _any_stops if words and known < sparse / 2 * words else _known_stops


def classify(blocks: list[Block], short: int = 70, long: int = 120, dense: float = 0.3, sparse: float = 0.15) -> list[bool]:
    """For each block, whether it is main text. Blocks inside boilerplate elements are left out of both passes.

    Inside elements that are marked as main text more links and fewer stop words are allowed, and what stays open counts
    as near. Where the page's language is not one of those with known function words, short words stand for them, and
    sentences where words are not set apart.
    """
    stop_share = _measure_of(blocks, short, sparse)
    labels, free = [], [i for i, b in enumerate(blocks) if b.place != BAD]
    for b in (blocks[i] for i in free):
        density, marked = b.linked / len(b.text), b.place == GOOD
        if density > (0.5 if marked else 0.33) or b.text.startswith("©") and not marked:
            labels.append(BAD)
        elif b.heading or len(b.text) < short:
            labels.append(NEAR if marked else OPEN)
        else:
            stops = stop_share(b.text)
            if marked:
                labels.append(GOOD if stops >= sparse else NEAR)
            elif stops >= dense:
                labels.append(GOOD if len(b.text) >= long else NEAR)
            else:
                labels.append(NEAR if stops >= sparse else BAD)
    settled, start = _settle(labels), 0
    for marked, run in itertools.groupby(free, key=lambda i: blocks[i].place == GOOD):
        end = start + sum(1 for _ in run)
        if marked:  # what stands around a marked element decides nothing inside it
            settled[start:end] = _settle(labels[start:end])
        start = end
    good = set(itertools.compress(free, settled))
    return [i in good for i in range(len(blocks))]


def _settle(labels: list[int]) -> list[bool]:
    """Open and near blocks take the label of the nearest decided one; at equal distance, near ones count as main text
    if either side is, open ones only if both are. Without any decided block, near ones are main text."""
    n = len(labels)
    before, after = [(n + 1, BAD)] * n, [(n + 1, BAD)] * n
    last = None
    for i, x in enumerate(labels):
        if x in (GOOD, BAD):
            last = i
        elif last is not None:
            before[i] = (i - last, labels[last])
    last = None
    for i in range(n - 1, -1, -1):
        if labels[i] in (GOOD, BAD):
            last = i
        elif last is not None:
            after[i] = (last - i, labels[last])
    settled = []
    for i, x in enumerate(labels):
        if x in (GOOD, BAD):
            settled.append(x == GOOD)
            continue
        (d0, a), (d1, b) = before[i], after[i]
        if d0 > n and d1 > n:
            settled.append(x == NEAR)
        elif d0 == d1:
            settled.append(GOOD in (a, b) if x == NEAR else a == b == GOOD)
        else:
            settled.append((a if d0 < d1 else b) == GOOD)
    return settled


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks joined by a space, empty if there is none."""
    if not page:
        return ""
    for trust in (True, False):
        blocks = blocks_of(page, trust)
        text = " ".join(b.text for b, good in zip(blocks, classify(blocks), strict=True) if good)
        if text or not any(b.place == BAD for b in blocks):
            break
    return text


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """The pages with ``out``, their main text; a narrow map over whole pages.

    Null and empty pages have an empty text. Repeated rows and other columns come back as they are; a column that has
    the name of ``out`` already is replaced. Pages without any markup are one block.
    """

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pd.Series(np.array([main_text(p) for p in pages], dtype=object))

    return pages.withColumn(out, text_of(F.col(html_col)))
