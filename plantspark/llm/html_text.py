"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags; scripts, styles and the like are skipped as
raw text, other elements without text of the page (buttons, selections, drawings ...) up to
their closing tags, or where there is none up to the next block. Only anchors with ``href``
are links; one without a closing tag ends with its block. The first pass scores a block alone: length, density of function words and links,
and whether an article or main element holds it, which counts as much as length or density
where such elements hold the text of the page (not beside a teaser). Where most of the long text of a page has hardly any of the known
function words, the language is unknown and they decide nothing. Menus, notices, adverts,
forms, comments ... are out, by element or by the words of class, id and role; not so what
an article or main element within them holds, and not a part without which little is left:
a form or a part named by layout words that holds most of the long text, or any other part
beside which the page has next to no text (a wrapper, or an unclosed element). Short blocks stay open, medium ones are only near good. The
second pass settles near-good blocks (in beside a good one, or if the page has none), then
gives open blocks the label of their nearest decided neighbours: where the two sides differ,
a heading goes with what follows it and any other block with the nearer side, the earlier if
equal. Within an article its edges and the parts that are out are no neighbours, and an
undecided block is out only where all those it has are bad (an open one: on both sides).
A page of short lines only, most of them without links, keeps them all. Within an article a
name of several words that may as well be its subject (``legal-history``) needs a part
without prose to be out. Text for readers without scripts counts where there is no other.

Edge cases: a null or empty page has an empty text; broken markup (unclosed tags, comments
or quotes) is read as far as it goes, in linear time; character references without a
semicolon are decoded as browsers do; repeated pages give repeated texts; input columns
named like an output are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, with_fields
from .quality import STOP_WORDS

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.08, 0.14
LINKS = 0.5

# Names of elements.
_RAW = frozenset("script style title textarea iframe".split())  # nothing but the closing tag, or the end of the page, ends them
_SKIPPED = frozenset("noscript template object svg math canvas audio video select button".split())
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^<>]*>", re.IGNORECASE) for name in _RAW}
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_PARTS = frozenset("article aside body details dialog div dl fieldset figure footer form head header html main menu nav ol section table ul".split())
_OUT_TAGS = frozenset("nav aside footer form head menu dialog fieldset".split())
# Words in class and id attributes, and roles, of parts that are not the article.
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead footer cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login register search form "
    "comment comments commentlist respond replies reply disqus related recommended recommendations share sharing social widget toolbar pagination pager "
    "legal copyright disclaimer complementary contentinfo alert".split()
)
_OUTSIDE_ONLY = frozenset(["header"])  # a header within the article belongs to it
# What may wrap the text of a page, so that most of the long text is enough to keep it.
_WRAPPERS = frozenset("form fieldset banner sidebar navigation search register login signup social share sharing widget toolbar legal masthead overlay modal".split())
# Discussions; an article element within them is one of their entries.
_TALK = frozenset("comment comments commentlist respond replies reply disqus".split())
# Words that also name what an article is about; in a longer name within an article they are not enough.
_SUBJECTS = frozenset(
    "banner navigation menu masthead search form login register related recommended recommendations share sharing social widget toolbar legal copyright "
    "disclaimer overlay alert footer aside popup modal".split()
)
# Beside these such a word does name a part of the page.
_LISTS = frozenset("post posts articles stories links news items list box bar button buttons icons form menu".split())
# Words that make a name one of the layout or the subject, not of the part itself.
_LAYOUT = frozenset("no not non without has have with category tag".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*)"  # a comment (an empty one ends at once), or an unclosed one up to the end
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/<>]*+)(?P<rest>(?>[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/<>]*+)(?P<rest2>[^<>]*+)>"  # an unclosed quote
    r"|<[!?/][^<>]*+>",
    re.DOTALL,
)
_HREF = re.compile(r"(?i)(?:^|[\s\"'/])href\s*=")
_NAMED = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Wide characters, which say as much as two letters or more.
_WIDE = re.compile("[\u1100-\u11ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")
_WORD_EDGES = re.compile(r"[\s_:./-]+|(?<=[a-z])(?=[A-Z])")
_EDGES = ".,;:!?\"'()[]«»¿¡#*$%&|<>-"


@dataclass(eq=False)
class Part:
    """A part of the page; ``mark`` tells why it would be out: empty, ``WRAPPER``, ``SUBJECT`` or ``PLACE``."""

    name: str = ""
    above: Part | None = None
    mark: str = ""
    article: int = 0  # number of the outermost article or main element around it, 0 if none
    opens: bool = False  # an article or main element that ends the marks around it
    talk: bool = False
    out: bool = False
    prose: bool = False  # it holds a block that is prose by itself
    long: int = 0  # characters of the long blocks, and of all blocks in articles, without most of them links
    all: int = 0  # characters of all blocks without most of them links


WRAPPER, SUBJECT, PLACE = "wrapper", "subject", "place"


@dataclass
class Block:
    part: Part
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def out(self) -> bool:
        return self.part.out

    @property
    def article(self) -> int:
        return self.part.article

    def close(self) -> str:
        return " ".join("".join(self.parts).split())


@dataclass
class Tag:
    start: int
    end: int  # of a raw-text element: behind its closing tag
    name: str
    closing: bool
    rest: str
    close: int = -1  # place of the closing tag of a skipped element or a link in the list of tags


def tags_of(page: str, skipped: frozenset[str] = _SKIPPED) -> list[Tag]:
    """The tags outside raw text; skipped elements and links know the tags that close them."""
    tags: list[Tag] = []
    at, end_at = 0, len(page)
    while at < end_at and (m := _TOKEN.search(page, at)):
        at = m.end()
        if not (name := m["name"] or m["name2"]):
            tags.append(Tag(m.start(), at, "", False, ""))
            continue
        name, closing, rest = name.lower(), bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        if name in _RAW and not closing and not rest.endswith("/"):
            stop = _RAW_ENDS[name].search(page, at)
            at = stop.end() if stop else end_at
        tags.append(Tag(m.start(), at, name, closing, rest))
    link: Tag | None = None
    still: list[Tag] = []  # parts and skipped elements
    number: Counter[str] = Counter()
    for i, tag in enumerate(tags):
        if tag.name == "a":
            if tag.closing and link:
                link.close = i
            link = None if tag.closing else tag
        elif tag.name in skipped or tag.name in _PARTS:
            if not tag.closing:
                if tag.name in _PARTS or not tag.rest.endswith("/"):
                    still.append(tag)
                    number[tag.name] += 1
            elif number[tag.name]:
                while (last := still.pop()).name != tag.name:
                    number[last.name] -= 1
                number[tag.name] -= 1
                last.close = i
    return tags


def blocks_of(page: str, skipped: frozenset[str] = _SKIPPED) -> list[tuple[str, Block]]:
    """(text, block) in page order; blocks without text are left out."""
    done: list[tuple[str, Block]] = []
    top = Part()
    parts, stack, articles = [top], [top], 0
    number: Counter[str] = Counter()
    block = Block(top, False)
    link: Tag | None = None
    link_depth = 0

    def finish(heading: bool = False) -> Block:
        if block.parts and (text := block.close()):
            done.append((text, block))
        return Block(stack[-1], heading)

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            block.parts.append(text)
            if link:
                block.linked += len(text)

    tags = tags_of(page, skipped)
    i, at = 0, 0
    while i < len(tags):
        tag = tags[i]
        i += 1
        add(page[at : tag.start])
        at = tag.end
        name, closing, rest = tag.name, tag.closing, tag.rest
        if name in _RAW:
            block.parts.append(" ")
        elif name in skipped:
            block.parts.append(" ")
            if not closing and not rest.endswith("/"):
                if tag.close >= 0:
                    i = tag.close + 1
                    at = tags[tag.close].end
                else:
                    while i < len(tags) and tags[i].name not in _BLOCKS:
                        i += 1
                    at = tags[i].start if i < len(tags) else len(page)
        elif name == "a":
            link = None if closing or not _HREF.search(rest) else tag
            link_depth = len(stack)
        elif name in ("br", "td", "th", "wbr", "img", "input"):
            block.parts.append("" if name == "wbr" else " ")
        elif name in _BLOCKS:
            if not closing and stack[-1].name == "head" and name != "html":
                number[stack.pop().name] -= 1
            if name in _PARTS:
                if closing:
                    while number[name]:
                        number[last := stack.pop().name] -= 1
                        if last == name:
                            break
                else:
                    stack.append(part := part_of(name, rest, stack[-1]))
                    number[name] += 1
                    parts.append(part)
                    if part.opens and not part.article:
                        articles += 1
                        part.article = articles
                block = finish()
            else:
                block = finish(name in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing)
                if not closing and rest and (part := part_of(name, rest, stack[-1])).mark:
                    block.part = part
                    parts.append(part)
            if link and (link.close < 0 or len(stack) < link_depth):
                link = None
    add(page[at:])
    finish()
    _settle(parts, done)
    return done


def part_of(name: str, rest: str, above: Part) -> Part:
    """A new part within ``above``."""
    holder = name in ("article", "main")
    words = set() if name in ("html", "body") else _named(rest, whole=holder)
    talk = above.talk or bool(words & _TALK)
    why = words & (_OUT_WORDS if above.article else _OUT_WORDS | _OUTSIDE_ONLY)
    if name in _OUT_TAGS or (name == "header" and not above.article):
        why = why | {name}
    mark = "" if not why else WRAPPER if why <= _WRAPPERS else PLACE
    if mark and above.article and why <= _SUBJECTS and not (words & _LISTS) - why and name not in _OUT_TAGS and not why & _named(rest, whole=True):
        mark = SUBJECT
    return Part(name, above, mark, above.article, holder and not mark and not talk, talk)


def _settle(parts: list[Part], done: list[tuple[str, Block]]) -> None:
    """Decide which parts are out. Two parts beside each other cannot both hold most of the page."""
    for text, block in done:
        if not linked_mostly(text, block):
            size = size_of(text)
            block.part.all += size
            block.part.long += size if size >= SHORT or block.article else 0
            block.part.prose |= size >= SHORT and stops_of(text) >= STOP_LOW
    for part in reversed(parts):
        if part.above:
            part.above.long += part.long
            part.above.all += part.all
            part.above.prose |= part.prose
    top = parts[0]
    for part in parts:
        if part.mark == WRAPPER:
            needed = part.long >= SHORT and 2 * part.long > top.long
        else:
            needed = part.long >= LONG and 11 * part.all > 10 * top.all
        needed = needed or (part.mark == SUBJECT and part.prose)
        around = part.above is not None and part.above.out and not part.opens
        part.out = around or bool(part.mark and not needed)


def _named(rest: str, whole: bool = False) -> set[str]:
    """Words of class, id and role, without names of the layout; with ``whole`` only names of one word."""
    if "=" not in rest:
        return set()
    out: set[str] = set()
    for m in _NAMED.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORD_EDGES.split(name)}
            if not words & _LAYOUT and (not whole or len(words) == 1):
                out |= words
    return out


GOOD, NEAR, OPEN, BAD = "good", "near", "open", "bad"


def size_of(text: str) -> int:
    """Code points; wide characters count twice."""
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


def stops_of(text: str) -> float:
    """Share of known function words."""
    words = text.split()
    return sum(w.strip(_EDGES).lower() in STOP_WORDS for w in words) / len(words)


def linked_mostly(text: str, block: Block) -> bool:
    return block.linked > LINKS * len(text)


def articles_hold_text(found: list[tuple[str, Block]]) -> bool:
    """Whether article and main elements hold as much text as the long blocks beside them."""
    free = [(text, block) for text, block in found if not block.out and not linked_mostly(text, block)]
    inside = sum(size_of(text) for text, block in free if block.article)
    return 0 < inside >= sum(size for text, block in free if not block.article and (size := size_of(text)) >= SHORT)


def language_known(found: list[tuple[str, Block]]) -> bool:
    """Whether at least half of the long text has known function words."""
    sizes = {True: 0, False: 0}
    for text, block in found:
        if not block.out and not linked_mostly(text, block) and (size := size_of(text)) >= SHORT:
            sizes[stops_of(text) >= STOP_LOW] += size
    return sizes[True] >= sizes[False]


def first_pass(text: str, block: Block, within: bool, known: bool = True) -> str:
    """``within``: an article that holds the text of the page is around the block; ``known``: its language has known function words."""
    if block.out or linked_mostly(text, block):
        return BAD
    size = size_of(text)
    if size < SHORT:
        return BAD if not within and (block.linked or text.startswith("©")) else OPEN
    stops = stops_of(text)
    dense = 2 if stops >= STOP_HIGH or not known else 1 if stops >= STOP_LOW else -1
    score = (2 if size >= LONG else 1) + dense + 2 * within
    return GOOD if score >= 4 else NEAR if score >= 2 else BAD


def _nearest(labels: list[str], order: range, free: list[int] | None = None) -> list[tuple[str, int]]:
    """Label and place of the last decided block before each one in ``order``; the page's edge is bad and far.

    With ``free``, the article of every block: only blocks of the same one count (0: none), and its edge is open.
    """
    edge = (BAD if free is None else OPEN, -len(labels) if order.step > 0 else 2 * len(labels))
    out, last, here = [edge] * len(labels), edge, 0
    for i in order:
        if free is not None:
            if not free[i]:
                continue
            if free[i] != here:
                last, here = edge, free[i]
        out[i] = last
        if labels[i] in (GOOD, BAD):
            last = (labels[i], i)
    return out


def second_pass(labels: list[str], headings: list[bool], articles: list[int] | None = None) -> list[bool]:
    """Whether each block is main text. Near-good blocks are settled first, then open ones.

    ``articles``: the article that holds a block and counts, 0 if none or if the block is out.
    """
    n = len(labels)
    sides = (range(n), range(n - 1, -1, -1))
    articles = articles or [0] * n
    rich = {a for a, x in zip(articles, labels, strict=True) if x == GOOD}
    settled = list(labels)
    around = [_nearest(labels, side, articles) for side in sides]
    for i, x in enumerate(labels):
        if articles[i] and x in (NEAR, OPEN):
            beside = [near[i][0] for near in around if near[i][0] != OPEN]
            wedged = len(beside) == 2 or (x == NEAR and len(beside) == 1)
            settled[i] = BAD if articles[i] in rich and wedged and GOOD not in beside else GOOD
    before, after = (_nearest(settled, side) for side in sides)
    lone = GOOD not in settled  # a page of medium blocks only
    settled = [(GOOD if lone or GOOD in (before[i][0], after[i][0]) else BAD) if x == NEAR else x for i, x in enumerate(settled)]
    before, after = (_nearest(settled, side) for side in sides)
    keep = []
    for i, label in enumerate(settled):
        if label == OPEN:
            (left, at), (right, to) = before[i], after[i]
            label = left if left == right else right if headings[i] or to - i < i - at else left
        keep.append(label == GOOD)
    return keep


def only_short(found: list[tuple[str, Block]], labels: list[str]) -> bool:
    """Whether a page without any longer text is one of short lines (a poem, a dialogue, a list), most of it without links."""
    if GOOD in labels or NEAR in labels:
        return False
    open_ = sum(size_of(text) for (text, _), label in zip(found, labels, strict=True) if label == OPEN)
    rest = sum(size_of(text) for (text, block), label in zip(found, labels, strict=True) if label != OPEN and not block.out)
    return open_ >= SHORT and open_ > rest


def main_text(page: str) -> str:
    text = _main_text(page, _SKIPPED)
    if not text and "<noscript" in page.lower():  # a page that shows its text to readers without scripts alone
        return _main_text(page, _SKIPPED - {"noscript"})
    return text


def _main_text(page: str, skipped: frozenset[str]) -> str:
    found = blocks_of(page, skipped)
    counts = articles_hold_text(found)
    articles = [b.article if counts and not b.out else 0 for _, b in found]
    known = language_known(found)
    labels = [first_pass(t, b, a > 0, known) for (t, b), a in zip(found, articles, strict=True)]
    if only_short(found, labels):
        return "\n".join(t for (t, _), label in zip(found, labels, strict=True) if label == OPEN)
    keep = second_pass(labels, [b.heading for _, b in found], articles)
    return "\n".join(t for (t, _), k in zip(found, keep, strict=True) if k)


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` (empty if there is none) and ``n_chars`` (code points)."""
    made = F.pandas_udf(lambda raw: pd.DataFrame({"text": [main_text(p) for p in raw]}), "text string")
    out = with_fields(pages, made(text_or_empty(html_col)), ["text"], drop=("n_chars",))
    return out.withColumn("n_chars", F.length("text").cast("long"))
