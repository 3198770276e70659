"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside menus, headers,
footers, sidebars, forms, notices, adverts and comments, told by tag, role or
class, are out. The first pass decides the others by length, link density and
stop-word density. The second lets ambiguous blocks, short ones above all,
inherit the label of their nearest decided neighbours in the same region. A
page's ``article`` or ``main`` element is a region of its own: if there is one,
nothing outside it counts, and an ambiguous block without neighbours is kept.
A region is not furniture for lying in a form or in an element with a class or id
of page layout; an ``article`` among comments, adverts or related pages is. An
inline element of furniture interrupts its block, which goes on after it.

Edge cases: null or empty html gives empty text; unclosed elements end with
their container, an unfinished tag at the end is dropped; repeated rows are
extracted each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.words import slices

MOST_LINKED = 0.5
LONG_CHARS = 70
STOP_SHARE = 0.25

# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is it that for was on are as with be by this at from or an not have had "
    "they you which were but his her their has all we will can "
    "le la les de des du et est un une que qui dans pour pas sur au aux avec par plus se ce il "
    "elle ne en son sa ses nous vous mais ou "
    "der die das und ist von zu den mit sich ein eine einer nicht auf dem im für auch als an "
    "werden aus er sie wie bei oder nur so "
    "el los las y del al se con su una por para como más pero sus lo es o si sobre este ya "
    "entre cuando muy sin también hasta".split()
)
# Kinds of HTML elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu dialog head title".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu "
    "menubar toolbar".split()
)
REGIONS = frozenset(["article", "main"])
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
# Words in class and id names of page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo "
    "promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars "
    "widget widgets footer masthead topbar cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments disqus respond replies discussion share sharing social related recommended "
    "recommendations pagination pager copyright legal disclaimer toolbar skip".split()
)
# Those that hold articles of others.
OF_OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo "
    "promotion comment comments disqus respond replies discussion related recommended "
    "recommendations".split()
)
NOT_FURNITURE = frozenset(["has", "with", "no", "without"])
# Those that are also subjects, and words that make them furniture.
SUBJECTS = frozenset("social legal share sharing alert notice notices discussion skip".split())
PARTS = frozenset(
    "bar bars box btn button buttons block container content icon icons inner item items line "
    "link links list outer panel row section site text top bottom wrap wrapper page post area".split()
)

# A quoted value ends where its quote is followed by the end of an attribute; a
# tag whose quotes do not pair ends at the first ``>``. Nothing is read twice.
_VALUES = (
    r"(?:[^<>\"']++|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|select|button|textarea|title)"
    rf"(?=[\s/>]){_VALUES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({_VALUES}|[^<>]*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*+\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(
    r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)|\b(hidden)\b", re.I
)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


#: Kinds of furniture, by what else can be main text in it: what reads as text; a
#: region and, where there is no other text, all of it; a region; ``main`` alone;
#: nothing.
DOUBTFUL, FORM, LAYOUT, OTHERS, NEVER = 1, 2, 3, 4, 5


@dataclass
class Open:
    """An open element, and what holds in it."""

    tag: str
    furniture: int
    region: bool
    inline: bool = False
    #: Whether it is inline furniture, and the block that it interrupts.
    cuts: bool = False
    block: Block | None = None


@dataclass
class Block:
    region: bool
    out: int
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: bool | None = None

    @cached_property
    def words(self) -> tuple[int, int]:
        """How many stop words and words the text has."""
        words = _LETTERS.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words), len(words)


def _furniture(tag: str, attributes: str, in_region: bool) -> int:
    """The kind of furniture that an element is by itself, or 0."""
    if tag == "form":
        kind = FORM
    elif tag in OUTSIDE or (tag == "header" and not in_region):
        return NEVER
    else:
        kind = 0
    if not attributes or tag in REGIONS or tag in ("body", "html"):
        return kind
    for name, value, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if hidden or (name == "style" and _HIDDEN.search(value)):
            return NEVER
        if name == "role" and value.lower() in ROLES:
            return NEVER
        if name in ("class", "id"):
            for part in value.split():
                words = {w.lower() for w in _NAME_WORD.findall(part)}
                if words & FURNITURE and not words & NOT_FURNITURE:
                    kind = max(kind, _named(words))
                if "header" in words and not in_region:
                    kind = max(kind, LAYOUT)
    return kind


def _named(words: set[str]) -> int:
    """The kind that the words of a class or id tell."""
    if words & OF_OTHERS - SUBJECTS:
        return OTHERS
    # A subject with a word of its own, as in "share-price", proves little.
    if words & FURNITURE <= SUBJECTS and words - FURNITURE - PARTS:
        return DOUBTFUL
    return OTHERS if words & OF_OTHERS else LAYOUT


def blocks_of(html: str) -> list[Block]:
    """Cut a page into blocks with text, in page order."""
    out: list[Block] = []
    # Inline elements are counted only from an inline element of furniture on.
    stack: list[Open] = []
    # How many elements of a name are open: an end tag without one is not sought.
    opened: Counter[str] = Counter()
    links = 0
    block: Block | None = None

    def push(element: Open) -> None:
        stack.append(element)
        opened[element.tag] += 1

    def cut_off(at: int) -> None:
        for element in stack[at:]:
            opened[element.tag] -= 1
        del stack[at:]

    def close(tag: str) -> None:
        if opened[tag]:
            cut_off(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))

    def close_inline(tag: str) -> None:
        nonlocal block
        if not opened[tag]:
            return
        at = len(stack) - 1
        while at >= 0 and stack[at].inline and stack[at].tag != tag:
            at -= 1
        if at < 0 or not stack[at].inline:
            return
        cut = next((e for e in stack[at:] if e.cuts), None)
        cut_off(at)
        if cut:
            block = cut.block

    def add(text: str) -> None:
        nonlocal block
        if not text or (block is None and text.isspace()):
            return
        if block is None:
            top = stack[-1] if stack else Open("", 0, False)
            block = Block(top.region, top.furniture, top.tag in CLOSED_BY_BLOCK and top.tag != "p")
            out.append(block)
        block.parts.append(text)
        if links:
            block.linked += len(text)

    at = 0
    for token in _TOKEN.finditer(html):
        add(html[at : token.start()])
        at = token.end()
        if token[3] is None:
            continue
        tag, ending = token[3].lower(), bool(token[2])
        if tag == "a":
            links = 0 if ending else 1
        if tag == "br":
            add(" ")
        if tag in INLINE:
            if ending or tag in VOID or tag == "a":
                if ending:
                    close_inline(tag)
                continue
            top = stack[-1] if stack else Open("", 0, False)
            kind = _furniture(tag, token[4], top.region)
            if token[4].endswith("/"):
                continue
            if kind:
                push(Open(tag, max(top.furniture, kind), top.region, True, True, block))
                block = None
            elif top.inline:
                push(Open(tag, top.furniture, top.region, True))
            continue
        block = None
        links = 0
        if ending:
            close(tag)
            continue
        inner = len(stack) - 1
        while inner >= 0 and stack[inner].inline:
            inner -= 1
        if inner >= 0 and stack[inner].tag in CLOSED_BY_BLOCK:
            cut_off(inner)
        if tag == "li" and opened["li"]:
            for name in (e.tag for e in reversed(stack)):
                if name in ("ul", "ol", "menu"):
                    break
                if name == "li":
                    close("li")
                    break
        elif tag == "body":
            close("head")
        if tag not in VOID and not token[4].endswith("/"):
            top = stack[-1] if stack else Open("", 0, False)
            furniture = top.furniture
            if furniture <= (OTHERS if tag == "main" else LAYOUT) and tag in REGIONS:
                furniture = 0
            furniture = max(furniture, _furniture(tag, token[4], top.region))
            push(Open(tag, furniture, top.region or tag in REGIONS))
    add(html[at:])
    for each in out:
        raw = "".join(each.parts)
        each.text = " ".join(unescape(raw).split())
        each.linked = min(each.linked, len(raw))
        each.linked = round(each.linked / max(len(raw), 1) * len(each.text))
    return [b for b in out if b.text]


def stop_share(blocks: list[Block]) -> float:
    """Share of the blocks' words that are stop words."""
    words = sum(b.words[1] for b in blocks)
    return sum(b.words[0] for b in blocks) / words if words else 0.0


_SENTENCE = re.compile(r"[.!?…]+[\"'»”’)]*(?=\s|\Z)|[。！？।؟]")
#: Letters, at most, of one sentence on average in running text.
SENTENCE_LETTERS = 400


def sentences_in(text: str) -> bool:
    """Whether sentence marks are as dense as in running text of any language."""
    marks = len(_SENTENCE.findall(text))
    return marks > 0 and len(text) <= SENTENCE_LETTERS * marks


def known_language(blocks: list[Block]) -> bool:
    """Whether the long blocks hold some of the stop words at all."""
    longest = [b for b in blocks if b.out < OTHERS and len(b.text) >= LONG_CHARS]
    return not longest or stop_share(longest) >= STOP_SHARE / 3


def reads_as_text(b: Block, known: bool = True) -> bool:
    return (
        len(b.text) >= LONG_CHARS
        and not b.heading
        and b.linked <= MOST_LINKED * len(b.text)
        and (stop_share([b]) >= STOP_SHARE if known else sentences_in(b.text))
    )


def classify(blocks: list[Block]) -> None:
    """Label each block: True for main text.

    Where a page's language is not one of the stop words', sentence marks tell
    running text. A region rules out the rest unless far more text is outside.
    """
    known = known_language(blocks)
    doubtful = [b for b in blocks if b.out == DOUBTFUL]
    if any(reads_as_text(b, known) and 10 * b.linked <= len(b.text) for b in doubtful):
        for b in doubtful:
            b.out = 0
    forms = [b for b in blocks if b.out == FORM]
    # The form of such a page holds the page.
    if any(reads_as_text(b, known) for b in forms) and not any(
        reads_as_text(b, known) for b in blocks if not b.out
    ):
        for b in forms:
            b.out = 0
    region = any(b.region and not b.out for b in blocks)
    if region:
        readable = [(b.region, len(b.text)) for b in blocks if not b.out and reads_as_text(b, known)]
        inside = sum(size for within, size in readable if within)
        region = sum(size for within, size in readable if not within) <= 2 * inside or not readable
    for b in blocks:
        if b.out or b.region != region or b.linked > MOST_LINKED * len(b.text):
            b.label = False
        elif len(b.text) >= LONG_CHARS and not b.heading:
            if reads_as_text(b, known):
                b.label = True
            elif not region and b.linked:
                b.label = False
    inner = [b for b in blocks if not b.out and b.region == region]
    following: list[bool | None] = []
    after: bool | None = None
    for b in reversed(inner):
        following.append(after)
        after = after if b.label is None else b.label
    before: bool | None = None
    for b, after in zip(inner, reversed(following)):
        if b.label is not None:
            before = b.label
            continue
        # A heading belongs to what follows it.
        near = {after} if b.heading and after is not None else {before, after}
        b.label = True in near or near == {None}


def main_text(html: str) -> str:
    """The main text, a line for each block."""
    blocks = blocks_of(html)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page, from its whole html."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 1 << 21):
            texts = [main_text(h) if h else "" for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    ).mapInArrow(extract, "page_id long, url string, text string")
