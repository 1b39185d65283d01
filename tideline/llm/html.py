"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block
by its length, the share of its text inside links and the density of stop words,
inside an article and outside. Where it stands is evidence beside these figures:
menus, headers, footers, sidebars, notices, adverts, forms and comments are bad; a
name that only mentions one of them (``has-sidebar``, ``article-header``) lowers
the share of links that is borne; text outside an article is bad if the article
holds more text. Short blocks without evidence stay open. The second pass gives an
open block the label of its nearest decided neighbour; of two at the same distance
that differ, good unless it holds a link. Inside an article it is good unless its
neighbours there are bad.

A page is read once from front to back: a tag that nothing closes is not looked
for again, and a stray closing tag costs no search.

Defined results
* null or empty html: empty text
* unclosed and stray tags are closed by the next tag that must end them
* repeated rows and ids are each extracted; an empty table gives no rows; more
  columns in the input are ignored
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.ship import ship
from .rules import STOP_WORDS

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names by their part in a page.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas noframes xmp".split())
DROPPED = frozenset("nav header footer aside form button select option label fieldset menu dialog head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role names.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side widget nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer foot comment comments discussion disqus replies reply respond cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations "
    "toolbar pagination pager search tags hidden complementary contentinfo".split()
)

# Fixed value: words that say nothing about a part's content beside one of the names above.
NEUTRAL = frozenset(
    "area bar block body bottom box col column container content fixed global group holder inner item items left link links list main mobile outer "
    "panel primary right row secondary section site sticky top unit user wrap wrapper zone".split()
)

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r"""=\s*["']|>""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOPS = frozenset(STOP_WORDS)


WEAK, STRONG = 1, 2


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    bad: int = 0
    content: bool = False
    heading: bool = False

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def _mark(attrs: str) -> int:
    """What an element's attributes say against its text: nothing, a mention of a bad part, or that it is one."""
    if ("hidden" in attrs or "none" in attrs) and _HIDDEN.search(attrs):
        return STRONG
    worst = 0
    for a, b, c in _NAMES.findall(attrs):
        for name in (a or b or c).split():
            words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
            if any(w in BAD_NAMES for w in words):
                whole = all(w in BAD_NAMES or w in NEUTRAL or w[0].isdigit() for w in words)
                worst = max(worst, STRONG if whole else WEAK)
    return worst


@dataclass
class Tag:
    start: int
    end: int
    name: str  # empty for comments and declarations
    closes: bool = False
    attrs: str = ""


def tags(page: str) -> Iterator[Tag]:
    """Tags in page order. ``send`` a position to go on from there."""
    at, last, quotes = 0, page.rfind(">"), True
    while m := _OPEN.search(page, at):
        tag = None
        if m[2] is None:
            comment = page.startswith("<!--", m.start())
            end = page.find("-->" if comment else ">", m.end())
            tag = Tag(m.start(), len(page) if end < 0 else end + (3 if comment else 1), "")
        elif last >= m.end():
            end, pos = -1, m.end()
            while quotes and end < 0 and (stop := _STOP.search(page, pos)):
                if stop[0] == ">":
                    end = stop.start()
                else:
                    pos = page.find(stop[0][-1], stop.end()) + 1
                    quotes = pos > 0  # a quote that nothing closes: from here on quotes are plain characters
            if end < 0:
                quotes = False
                end = page.find(">", m.end())
            tag = Tag(m.start(), end + 1, m[2].lower(), bool(m[1]), page[m.end() : end])
        if tag is None:  # no tag is closed any more
            return
        at = (yield tag) or tag.end


def blocks(page: str) -> list[Block]:
    """Blocks in page order, with the zone each stands in."""
    done: list[Block] = []
    now = Block()
    stack: list[tuple[str, int, bool]] = []  # open element, mark and content outside it
    opened: dict[str, int] = {}
    unclosed: set[str] = set()  # raw elements that no tag closes in the rest of the page
    bad, line = 0, 0  # of the open elements, of the paragraph
    content = heading = False
    links = at = 0

    def end() -> None:
        nonlocal now, line
        if now.parts:
            done.append(now)
        now, line = Block(), 0

    def add(s: str) -> None:
        if not s:
            return
        if not now.parts:
            now.bad, now.content, now.heading = max(bad, line), content, heading
        now.parts.append(s)
        if links:
            now.linked += len(s.strip())

    walk = tags(page)
    tag = next(walk, None)
    while tag:
        add(page[at : tag.start])
        at, name, jump = tag.end, tag.name, None
        if not name:
            pass
        elif tag.closes:
            if name == "a":
                links = max(0, links - 1)
            else:
                if name in BLOCK:
                    end()
                if name in HEADINGS:
                    heading = False
                while opened.get(name):
                    top, bad, content = stack.pop()
                    opened[top] -= 1
                    if top == name:
                        break
        elif name in RAW:
            if not tag.attrs.endswith("/"):
                stop = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if stop:
                    at = jump = stop.end()
                else:
                    unclosed.add(name)
                    if name in ("script", "style"):
                        at = len(page)
                        break
        elif name == "a":
            links += 1
        else:
            if name in BLOCK:
                end()
                links = 0
            heading = name in HEADINGS or heading and (name not in BLOCK or name == "br")
            if name == "p":
                line = _mark(tag.attrs)
            elif name not in VOID and not tag.attrs.endswith("/") and (name in BLOCK or _NAMES.search(tag.attrs)):
                stack.append((name, bad, content))
                opened[name] = opened.get(name, 0) + 1
                if name in CONTENT:
                    content, bad = True, bad if bad == STRONG else 0
                # a page's own header inside an article belongs to the article
                mark = STRONG if name in DROPPED and not (name == "header" and content) else 0 if name in ("html", "body") else _mark(tag.attrs)
                bad = max(bad, mark)
        try:
            tag = walk.send(jump)
        except StopIteration:
            tag = None
    add(page[at:])
    if now.parts:
        done.append(now)
    return done


def _first_pass(b: Block, t: str, low: float, high: float, short: int, long: int, links: float) -> bool | None:
    words = t.split()
    density = sum(w.strip(".,;:!?").lower() in _STOPS for w in words) / len(words)
    share = b.linked / max(1, len(t))
    if b.bad == STRONG:
        return False
    if share > (links / 2 if b.bad else links) and not (b.content and b.heading):
        if not b.content:
            return False
        return None if len(t) < short else density >= high
    if len(t) < short:
        return None
    if b.content and not b.bad:
        return True
    if density >= high or len(t) >= long and density >= low:
        return True
    return False if len(t) >= long else None


def _nearest(label: list[bool | None], zone: list[int | None]) -> list[list[tuple[int, bool]]]:
    """Distance and label of the decided blocks before and behind each block; blocks are neighbours in one zone."""
    sides: list[list[tuple[int, bool]]] = [[] for _ in label]
    for order in (range(len(label)), range(len(label) - 1, -1, -1)):
        last: dict[int | None, tuple[int, bool]] = {}
        for n, i in enumerate(order):
            if zone[i] in last:
                at, x = last[zone[i]]
                sides[i].append((n - at, x))
            if label[i] is not None and zone[i] is not None:
                last[zone[i]] = n, bool(label[i])
    return sides


def main_text(page: str | None, low: float = 0.05, high: float = 0.12, short: int = 60, long: int = 180, links: float = 0.5) -> str:
    """The page's good blocks, joined by line breaks."""
    found = [(b, t) for b in blocks(page or "") if (t := b.text())]
    label = [_first_pass(b, t, low, high, short, long, links) for b, t in found]
    size = lambda inside: sum(len(t) for (b, t), x in zip(found, label, strict=True) if b.content == inside and x is not False and (x or inside))
    if size(True) and size(True) >= size(False):  # the article is the main text
        label = [x if b.content else False for (b, _), x in zip(found, label, strict=True)]
    # what stands in a bad part of an article says nothing about the rest of it
    zone = [(None if b.bad == STRONG else 1) if b.content else 0 for b, _ in found]
    keep = []
    for (b, t), x, sides in zip(found, label, _nearest(label, zone), strict=True):
        if x is None:
            if b.content and not b.bad:
                x = any(y for _, y in sides) or not sides
            elif b.heading and sides:  # a heading goes with what follows
                x = sides[-1][1]
            else:
                near = [y for d, y in sides if d == min(d for d, _ in sides)]
                x = bool(near) and (all(near) or any(near) and not b.linked)
        if x:
            keep.append(t)
    return "\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, SCHEMA)
