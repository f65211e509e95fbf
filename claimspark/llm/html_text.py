"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by their place
(menus, footers, forms and the like are never main text), by link density, stop-word density
and length; the second lets blocks that are left open inherit the label of their nearest decided
neighbour: of the nearer one of the two, of the good one where both are as near.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its my not of on or our
    she so that the their them they this to was we were which will with you your
    als am auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im ist
    mit nach nicht sich sie sind über um und von war wie zu zum zur
    au aux avec ce cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas pour
    qu que qui sa se ses son sur un une vous
    al como con del el ella ellos era esta este la las lo los más muy no nos o para pero por sin su sus
    te una uno y ya""".split()
)

#: Elements skipped with what they hold. What is left of a head then has no text, so a missing </head> loses nothing.
_SKIPPED = frozenset("script style title noscript template iframe svg canvas object select textarea math audio video datalist".split())
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SKIPPED}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOPS = re.compile("[>\"']")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul label button".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav footer aside menu dialog button label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar tablist".split())
#: Parts of class names and ids that tell what is not main text wherever they stand ...
_NAMED = re.compile(r"cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|comments?|commentlist|disqus|replies|respond|pagination|pager|copyright|disclaimer")
#: ... those that do unless the element holds nearly all good text of its page, as a wrapper named after its parts does ...
_LAYOUT = re.compile(r"nav|navbar|navigation|menus?|breadcrumbs?|masthead|footer|sidebar|widgets?|ads?|adbox|advert\w*|sponsor\w*|promo\w*|signup|login|related|recommend\w*|toolbar")
#: ... those that turn a name into a page's state, and those that only count where all other parts are about the frame of a page.
_STATES = frozenset("has no with without free open opened closed enabled disabled allowed".split())
#: An element is its page's wrapper if it holds most of all text that is not bad, and this share of what is in it and in no other such element.
WRAPPED = 0.8
_WEAK = frozenset("header banner notice notices alert alerts search share sharing social side legal skip".split())
_FRAME = frozenset(
    "site top bottom main global bar box wrap wrapper container link links button buttons btn icon icons list area block inner outer left right "
    "col column form widget fixed sticky fluid primary secondary media follow to content js id is no the".split()
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


@dataclass
class Block:
    """One block of a page: its pieces of text and where it stands."""

    article: int
    refused: bool
    listed: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    within: tuple[int, ...] = ()  # open elements that are refused unless they wrap the page's text
    text: str = ""
    good: bool | None = None


def _named(value: str, in_article: bool) -> str:
    """Whether a class or id names something that is not main text: "never", "layout" or "". An article's own header is main text."""
    found = ""
    for name in value.lower().split():
        parts = set(re.split(r"[_-]+", name)) - {""}
        if parts & _STATES:
            continue
        weak = parts & _WEAK
        if any(_NAMED.fullmatch(x) for x in parts) or weak and not (in_article and parts == {"header"}) and parts <= _WEAK | _FRAME:
            return "never"
        if any(_LAYOUT.fullmatch(x) for x in parts):
            found = "layout"
    return found


def _refused(tag: str, attrs: str, in_article: bool) -> str:
    """Whether an element holds no main text: "never", "layout" if it may be a wrapper of the page after all, or ""."""
    if tag in _NEVER or tag == "header" and not in_article:
        return "never"
    found = "layout" if tag == "form" else ""
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs.lower():
        return found
    for name, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "never"
        if name == "role" and value.lower() in _ROLES:
            return "never"
        if name == "role" and value.lower() == "form":
            found = "layout"
        if name in ("class", "id") and (kind := _named(value, in_article)):
            if kind == "never":
                return kind
            found = kind
    return found


def _tag_end(page: str, at: int, absent: set[str]) -> int:
    """Where a tag ends whose name ends at `at`: after the first > outside quotes, or -1.

    A quote sign that does not occur again in the page is a plain character; absent remembers it.
    """
    while m := _STOPS.search(page, at):
        sign = m[0]
        if sign == ">":
            return m.end()
        closing = -1 if sign in absent else page.find(sign, m.end())
        if closing < 0:
            absent.add(sign)
        at = closing + 1 if closing >= 0 else m.end()
    return -1


def _tags(page: str) -> Generator[tuple[int, int, str, bool, str], int | None, None]:
    """(start, end, name, whether it ends an element, attributes) of each tag; the name is empty for comments and the like.

    The caller may send a later position to go on from. No part of the page is looked at more
    than a bounded number of times: beyond the last > nothing is a tag, a quote without an end is
    searched for once, and after a tag that only ends inside quotes quotes are plain characters.
    """
    at, final = 0, page.rfind(">")
    absent: set[str] = set()
    while True:
        at = page.find("<", at)
        if at < 0 or at > final:
            return
        start, following = at, page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            name, ends, attrs = "", False, ""
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            at = end + 3 if end >= 0 else len(page)
            name, ends, attrs = "", False, ""
        else:
            ends = following == "/"
            m = _NAME.match(page, at + 1 + ends)
            if not m and following not in ("!", "?", "/"):
                at += 1
                continue
            if m:
                at = _tag_end(page, m.end(), absent)
                if at < 0:
                    absent |= {'"', "'"}
                    at = page.find(">", m.end()) + 1
                name, attrs = m[0].lower(), page[m.end() : at - 1]
            else:
                at = page.find(">", at) + 1
                name, attrs = "", ""
        moved = yield start, at, name, ends, attrs
        if moved is not None:
            at = moved
            yield start, at, "", False, ""


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with decoded text and white space turned into one space."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []  # open block-level or refused elements, and how they are refused
    wrappers: list[int] = []  # numbers of the open ones that may wrap the page's text
    opened: Counter[str] = Counter()  # how many of the stack's elements have a name
    refused = articles = article = numbered = 0
    linked = False
    current: Block | None = None
    at = 0
    endless: set[str] = set()  # skipped elements without an end tag in the rest of the page

    def skipped_until(tag: str, start: int) -> int:
        """Where a skipped element ends; one without an end tag ends at once, but for scripts and styles."""
        m = None if tag in endless else _END[tag].search(page, start)
        if m:
            return m.end()
        endless.add(tag)
        return len(page) if tag in ("script", "style") else start

    def left(kind: str) -> None:
        nonlocal refused
        refused -= kind == "never"
        if kind == "layout":
            wrappers.pop()

    def text_until(end: int) -> None:
        nonlocal current
        if end > at:
            if current is None:
                near = [t for t, _ in stack[-3:]]
                current = Block(article if articles else 0, refused > 0, "li" in near, heading=any(len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in near), within=tuple(wrappers))
            piece = html.unescape(page[at:end])
            current.pieces.append(piece)
            if linked:
                current.linked += len(piece.strip())

    def flush() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.pieces).split())
            if current.text:
                blocks.append(current)
        current = None

    tags = _tags(page)
    for start, end, tag, ends, attrs in tags:
        text_until(start)
        at = end
        if not tag:
            continue
        if tag in _SKIPPED:
            if not ends and not (tag in ("svg", "math") and attrs.endswith("/")):
                at = skipped_until(tag, at)
                tags.send(at)
            continue
        block = tag in _BLOCKS
        if block:
            flush()
        if tag == "a":
            linked = not ends
        elif block and (ends or tag in ("p", "li")):
            linked = False
        if tag == "br":
            if current is not None:
                current.pieces.append(" ")
        elif ends:
            if opened[tag]:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                for t, r in stack[depth:]:
                    left(r)
                    opened[t] -= 1
                    articles -= t in ("article", "main")
                if any(r for _, r in stack[depth:]):
                    flush()
                del stack[depth:]
        elif tag not in _VOID and not attrs.endswith("/"):
            if tag in ("article", "main"):  # menus and footers that were never closed end here
                while stack and stack[-1][0] in ("nav", "footer", "header", "ul", "li", "ol") and opened["nav"] + opened["footer"] + opened["header"]:
                    opened[stack[-1][0]] -= 1
                    left(stack.pop()[1])
                articles += 1
                article += 1
            elif tag in ("p", "li") and stack and stack[-1][0] == tag:
                opened[tag] -= 1
                left(stack.pop()[1])
            r = _refused(tag, attrs, articles > 0)
            if r and not block:
                flush()
            if block or r:
                stack.append((tag, r))
                opened[tag] += 1
                refused += r == "never"
                if r == "layout":
                    numbered += 1
                    wrappers.append(numbered)
    text_until(len(page))
    flush()
    return blocks


def decide(block: Block, long: int, medium: int, link_max: float, stops_low: float, stops_high: float) -> bool | None:
    """The first pass; None leaves the block open."""
    size = len(block.text)
    links = block.linked / size
    if block.refused:
        return False
    if links > link_max and (not block.article or block.listed and links > 0.9):
        return False
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if size < medium:
        return None
    if stops >= stops_high or block.article and (stops >= stops_low or size >= long):
        return True
    return None


def _nearest(blocks: list[Block]) -> list[tuple[bool, int] | None]:
    """For each block the label of the last decided one before it, and how many blocks away that is.

    Blocks of an article look within it, past what is refused by its place; others look at all.
    """
    last: dict[int, tuple[bool, int]] = {}
    out: list[tuple[bool, int] | None] = []
    for at, b in enumerate(blocks):
        found = last.get(b.article)
        out.append((found[0], at - found[1]) if found else None)
        if b.good is not None:
            last[0] = (b.good, at)
            if b.article and not b.refused:
                last[b.article] = (b.good, at)
    return out


def inherited(before: tuple[bool, int] | None, after: tuple[bool, int] | None, heading: bool) -> bool:
    """The second pass: the nearer label; the good one where both are as near; kept where nothing is decided.

    A heading belongs to what follows it.
    """
    if before is None or after is None or heading:
        return (after or before or (True, 0))[0]
    return before[0] or after[0] if before[1] == after[1] else min(before, after, key=lambda x: x[1])[0]


def main_text(
    page: str | None, long: int = 200, medium: int = 70, link_max: float = 0.33, stops_low: float = 0.2, stops_high: float = 0.3
) -> str:
    """The main text of a page: its good blocks joined by line feeds."""
    blocks = blocks_of(page or "")

    def labels() -> list[bool | None]:
        found = [decide(b, long, medium, link_max, stops_low, stops_high) for b in blocks]
        if any(found):
            return found
        # a language without known stop words: length and links decide
        return [True if good is None and len(b.text) >= medium else good for b, good in zip(blocks, found, strict=True)]

    if any(b.within for b in blocks):
        held: Counter[int] = Counter()
        whole = outside = 0
        for b, good in zip(blocks, labels(), strict=True):
            if good is not False:
                whole += len(b.text)
                outside += 0 if b.within else len(b.text)
                held.update(dict.fromkeys(b.within, len(b.text)))
        wraps = {w for w, n in held.items() if n > whole / 2 and n >= WRAPPED * (outside + n)}
        for b in blocks:
            b.refused = b.refused or not wraps.issuperset(b.within)
    first = labels()
    # articles hold the main text unless more of it is outside, as beside teasers
    inside, outside = (sum(len(b.text) for b, good in zip(blocks, first, strict=True) if good and bool(b.article) == x) for x in (True, False))
    has_article = inside >= outside and any(b.article and not b.refused for b in blocks)
    for b, good in zip(blocks, first, strict=True):
        b.good = False if has_article and not b.article else good
    before, after = _nearest(blocks), _nearest(blocks[::-1])[::-1]
    for b, x, y in zip(blocks, before, after, strict=True):
        if b.good is None:
            b.good = inherited(x, y, b.heading)
    return "\n".join(b.text for b in blocks if b.good)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page.

    Null and empty html give empty text; an empty table gives an empty result. Every row is
    treated alone: nulls in other columns, ties, repeated rows and extra columns have no effect.
    A very long page is one row of one task, whose time and memory grow in proportion to it
    whatever its markup. Work: one narrow pass, no shuffle.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    schema = f"{id_col} {types[id_col]}, {url_col} {types[url_col]}, text string, n_chars long"
    return common.map_batches(pages.select(id_col, url_col, F.col(html_col)), run, schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.read_table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLES: dict[str, str] = {}
