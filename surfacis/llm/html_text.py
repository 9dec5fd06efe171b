"""Main text of HTML pages: blocks classified by stop words, length and links, ambiguous short ones by their neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Frequent words of the languages known; other pages are judged by length and links alone.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on as with his he be at by this had not are but from or have an they which you were her she there been one so if no what "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou ils cette aux mais comme on nous elle "
    "el que y los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split()
)
#: Share of linked characters over which a block is boilerplate, with less and with more trust in where it stands.
LINKS, LINKS_INSIDE = 0.33, 0.6
#: Characters up to which a block is short, from which it can be text by its stop words alone, and shares of stop words that tell text, or text by its neighbours.
SHORT, LONG, STOPS, SOME_STOPS = 70, 200, 0.30, 0.15
#: Share of stop words in all unlinked words from which a page counts as one of a known language, and share of text that an article has to hold of what is around it.
KNOWN, SHARE = 0.05, 0.34

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold others, and those whose content isn't text of the page: the first are parsed, the second passed over whole.
_HOLDERS = frozenset("article aside body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
_PASSED = "script|style|title|noscript|textarea|template|iframe|object|svg|math|select|button|canvas|audio|video|xmp|noembed|noframes|datalist"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<passed>{_PASSED})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=passed)\b[^>]*+>|.*)|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*+>",
    re.S | re.I,
)
#: A tag or comment that the page's end cuts off.
_CUT_OFF = re.compile(r"<[a-z/!?]", re.I)
#: A comment or a passed-over element without its end, to which all that follows belongs.
_UNENDED = re.compile(rf"<!--(?!.*-->)|<({_PASSED})\b(?!.*</\1\b[^>]*+>\Z)", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Names of classes, ids and roles: parts of those that no article stands in, parts of those of the page's frame, and whole ones that hold the main text.
_NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr newsletter subscribe "
    "subscription signup login popup modal overlay share sharing social related recommended recommendations notice notices alert paywall survey poll search searchbox copyright".split()
)
_FRAME = frozenset("nav navbar navigation menu menubar sidebar side rail header masthead footer foot breadcrumb breadcrumbs pagination pager toolbar topbar widget widgets complementary contentinfo".split())
_MAIN = frozenset("main content article post entry story articlebody article-body article-content article-text post-content post-body entry-content story-body main-content maincontent page-content".split())
_FREE, _FRAMED, _NEVER_TEXT = 0, 1, 2


@dataclass(slots=True)
class Block:
    """A block's text, what of it is linked (characters), how the place where it stands counts, and the rank of the text's holder around it: 0 none, 1 main part, 2 article."""

    text: str
    linked: int
    zone: int
    rank: int
    heading: bool

    def link_density(self) -> float:
        return self.linked / len(self.text)

    def stops(self) -> tuple[int, int]:
        words = self.text.lower().split()
        return sum(w.strip(".,;:!?\"'()«»¿¡") in STOP_WORDS for w in words), len(words)


def _place(name: str, attributes: str, zone: int, rank: int) -> tuple[int, int]:
    """Zone and rank inside an element of these attributes that stands in zone and rank."""
    names = [x.lower() for m in _NAMED.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split()] if "=" in attributes else []
    parts = {p for x in names for p in re.split(r"[^a-z0-9]+", x)} if name not in ("html", "body") else set()
    if parts & _NEVER or name in ("nav", "aside", "menu", "dialog", "footer"):
        return _NEVER_TEXT, rank
    if name in ("article", "main"):
        return _FREE if zone == _FRAMED else zone, max(rank, 2 if name == "article" else 1)
    if name == "form" or rank == 0 and name == "header" or parts & _FRAME and not (rank or parts & _MAIN):
        return max(zone, _FRAMED), rank
    return zone, max(rank, 1) if parts and not _MAIN.isdisjoint(names) else rank


def blocks(page: str) -> Iterator[Block]:
    """The page's blocks that have text, in order. White space inside a block (br too) is one space; character references are decoded."""
    open_: list[tuple[str, int, int]] = []
    names: Counter[str] = Counter()
    end, zone, rank = page.rfind(">") + 1, _FREE, 0
    own, heading, in_link, linked, pieces, at, whole = None, False, False, 0, [], 0, ""

    def ended() -> Iterator[Block]:
        text = " ".join("".join(pieces).split())
        if text:
            yield Block(text, min(linked, len(text)), zone if own is None else own, rank, heading)

    for m in _TOKEN.finditer(page, 0, end):
        if m.start() > at:
            piece = html.unescape(page[at : m.start()])
            pieces.append(piece)
            linked += len(" ".join(piece.split())) if in_link else 0
        at, name, whole = m.end(), (m["name"] or "").lower(), m[0]
        if name == "a":
            in_link = not m["close"]
        elif name == "br":
            pieces.append(" ")
        elif name in _BLOCKS:
            yield from ended()
            pieces.clear()
            linked, own, in_link = 0, None, in_link and not m["close"]
            heading = not m["close"] and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if name not in _HOLDERS:
                if not m["close"] and "=" in m["attributes"]:
                    own = _place(name, m["attributes"], zone, rank)[0]
            elif not m["close"]:
                open_.append((name, zone, rank))
                names[name] += 1
                zone, rank = _place(name, m["attributes"], zone, rank)
            elif names[name]:
                last = ""
                while last != name:
                    last, zone, rank = open_.pop()
                    names[last] -= 1
    if not (at == end and _UNENDED.match(whole)):
        pieces.append(html.unescape(page[at:end] + _CUT_OFF.split(page[end:], 1)[0]))
    yield from ended()


def decide(b: Block, inside: bool, known: bool) -> bool | None:
    """First pass, a block for itself: text (True), boilerplate (False), or ambiguous (None). inside: it stands in what the page marks as its article."""
    if b.zone != _FREE:
        return False
    density = b.link_density()
    if inside:
        return False if density > LINKS_INSIDE else None if len(b.text) < SHORT else True
    if density > LINKS:
        return False
    if len(b.text) < SHORT:
        return False if b.linked else None
    if not known:
        return True if len(b.text) >= LONG else None
    hits, n = b.stops()
    if hits >= STOPS * n:
        return True if len(b.text) >= LONG else None
    return None if hits >= SOME_STOPS * n else False


def inherit(labels: list[bool | None], headings: list[bool], default: bool) -> list[bool]:
    """Second pass: an ambiguous block takes the label of the nearest decided one; at equal distance a heading that of the next, others that of the one before."""
    n, near = len(labels), [None] * len(labels)
    last = None
    for i in range(n):
        if labels[i] is not None:
            last = i
        near[i] = last
    out, after = [default] * n, None
    for i in range(n - 1, -1, -1):
        if labels[i] is not None:
            after = i
        before = near[i]
        if before is None or after is None:
            chosen = before if after is None else after
        else:
            chosen = after if (after - i, not headings[i]) < (i - before, headings[i]) else before
        if chosen is not None:
            out[i] = labels[chosen]
    return out


def main_text(page: str | None) -> str:
    """Blocks of the page's main text, joined by an empty line; empty if there are none.

    What the page marks as article (else as main part) is where text is looked for if it holds SHARE of the unlinked text outside the page's frame; there, blocks
    are text but for linked ones. Pages without such marks are judged block by block.
    """
    found = list(blocks(page or ""))
    free = [0, 0, 0]
    for b in found:
        if b.zone == _FREE:
            free[b.rank] += len(b.text) - b.linked
    rank = next((r for r in (2, 1) if sum(free[r:]) and sum(free[r:]) >= SHARE * sum(free[1:])), 0)
    if rank:
        found = [b for b in found if b.rank >= rank]
    counted = [b.stops() for b in found if b.zone == _FREE and not b.linked] if not rank else []
    known = sum(c[0] for c in counted) >= KNOWN * max(1, sum(c[1] for c in counted))
    labels = inherit([decide(b, rank > 0, known) for b in found], [b.heading for b in found], True)
    return "\n\n".join(b.text for b, keep in zip(found, labels) if keep and b.zone == _FREE)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with html_col replaced by out, the page's main text.

    Null and empty pages, and pages without text, give an empty one. Each page is worked out for itself, so repeated rows and ids stay; other
    columns stay as they are, but out replaces a column of its name. Any markup gives a result: a tag that isn't closed ends with
    what holds it, and a < that begins no tag is text. An empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c not in (html_col, out)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*[f"`{c}`" for c in kept]).schema]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch.column(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], texts], names=[*kept, out])

    return pages.select(*[f"`{c}`" for c in [*kept, html_col]]).mapInArrow(work, ", ".join([*fields, f"`{out}` string"]))
