"""Main text of raw HTML pages by two passes of block rules.

A page is cut into blocks at the tags that start a new line. The first pass decides a block by its
place, its share of stop words, its length and its share of linked text; the second one lets what
stays open, mostly short blocks, inherit the label of the nearest decided blocks before and behind it.
Tasks read pages in parts of bounded size; a page is never cut.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, slices

# Frequent function words, in natural order.
STOP_WORDS = frozenset((
    # English
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were "
    "all their has would what will there if can "
    # French
    "le la les un une des du de et en est que qui dans pour par sur pas au aux ce se ne plus avec il elle son sa ses ou où mais "
    # German
    "der die das den dem des ein eine einen einer und zu von mit sich auf für ist im nicht auch es an als am aus bei nach wie oder aber "
    # Spanish
    "el los las del una y que por con para se no su al lo como más pero sus "
    # Dutch
    "het een van op te voor niet aan ook er maar om bij dan zijn naar uit"
).split())

#: Elements whose content is never shown as text.
HIDDEN = ("script", "style", "noscript", "template", "title", "textarea", "select", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head")
#: Elements around the article.
AROUND = frozenset(("nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label", "datalist"))
MAIN = frozenset(("article", "main"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset((
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input",
))
#: Elements that end an open one of the same name.
REPLACED = frozenset(("li", "tr", "td", "th", "dt", "dd", "option", "h1", "h2", "h3", "h4", "h5", "h6"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Parts of class, id and role names of boxes around an article.
BOXES = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "complementary", "footer", "contentinfo",
    "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "share", "sharing", "social",
    "related", "recommended", "pagination", "pager", "toolbar", "search", "widget", "skip", "copyright", "hidden",
))
#: First parts of names that tell the state of a box, not what it is.
STATES = frozenset(("has", "no", "with", "without", "is", "not", "js"))
CONTENT = frozenset(("article", "articlebody", "main", "content", "post", "entry", "story"))

#: Shares of stop words that make a block low or high, share of linked text, and words of short and long blocks.
STOPS_LOW, STOPS_HIGH, LINKS, SHORT, LONG = 0.15, 0.30, 0.5, 10, 30

_HIDDEN_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in HIDDEN}
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*+)>|<[!?/][^>]*>", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=$|[\s/"'])""", re.I | re.S)
_WORD_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Names of posts whose comments are on or off.
_CLOSED = re.compile(r"comments?-(?:open|closed)|has-", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    tag: str
    #: Inside a box around the article, and the innermost article it lies in (0: none).
    boxed: bool
    home: int
    text: str = ""
    words: int = 0
    stops: float = 0.0
    links: float = 0.0
    label: str = ""


def _box(rest: str, outside: bool) -> tuple[bool, bool]:
    """Whether attributes name a box around the article (``outside`` one: headers too), or the article itself."""
    boxed = content = False
    for name, *values in _NAMES.findall(rest):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
            boxed = True
        elif name in ("class", "id", "role"):
            for token in value.split():
                parts = [p.lower() for p in _WORD_PARTS.findall(token)]
                if parts and parts[0] not in STATES:
                    boxed = boxed or not BOXES.isdisjoint(parts) or outside and "header" in parts
                    content = content or BOXES.isdisjoint(parts) and not CONTENT.isdisjoint(parts)
    return boxed, content


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in order, with the figures of the rules."""
    found: list[Block] = []
    # One entry an open element: name, inside a box, innermost article, inside a link.
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
    opened: Counter = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    place = {"tag": "", "boxed": False, "home": 0}
    homes = 0

    def take(text: str) -> None:
        if not text:
            return
        name, boxed, home, link = stack[-1]
        if (boxed, home) != (place["boxed"], place["home"]):
            close()
        place.update(boxed=boxed, home=home)
        text = html.unescape(text) if "&" in text else text
        pieces.append(text)
        if link:
            linked.append(text)

    def close() -> None:
        words = "".join(pieces).split()
        if words:
            stops = sum(1 for w in words if _is_stop(w))
            text = " ".join(words)
            shown = sum(len(piece.split()) for piece in linked)
            found.append(Block(place["tag"], place["boxed"], place["home"], text, len(words), stops / len(words), min(1.0, shown / len(words))))
        pieces.clear()
        linked.clear()

    def pop(name: str) -> None:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    def nearest(name: str) -> bool:
        """Whether ``name`` is open with only inline elements inside."""
        for held, *_ in reversed(stack):
            if held == name:
                return True
            if held not in INLINE:
                return False
        return False

    at = 0
    while True:
        mark = _MARKUP.search(page, at)
        if mark is None:
            take(page[at:])
            break
        take(page[at:mark.start()])
        at = mark.end()
        name = mark["name"]
        if name is None:
            if mark[0].startswith("<![CDATA["):
                take(html.escape(mark[0][9:-3]))
            continue
        name = name.lower()
        if name == "br":
            pieces.append(" ")
            continue
        if mark["end"]:
            if name in INLINE:
                if opened[name] and nearest(name):
                    pop(name)
                continue
            close()
            place["tag"] = ""
            if opened[name]:
                pop(name)
            continue
        if name in _HIDDEN_END:
            if not mark["rest"].endswith("/"):
                end = _HIDDEN_END[name].search(page, at)
                # A head that is left open ends where the body starts.
                at = end.end() if end else at if name == "head" else len(page)
            continue
        if name not in INLINE:
            close()
            place["tag"] = name
            for open_name in ("p", name) if name in REPLACED else ("p",):
                if opened[open_name] and nearest(open_name):
                    pop(open_name)
        elif name == "a" and opened["a"] and nearest("a"):
            pop("a")
        if name in VOID:
            continue
        _, boxed, home, link = stack[-1]
        rest = mark["rest"]
        named, content = _box(rest, not home) if "=" in rest or "hidden" in rest else (False, False)
        if name in MAIN or content and not named and not home and name not in INLINE:
            named = named and not content and name == "article" and not _CLOSED.search(rest)
            homes += 1
            home = homes
        around = name in AROUND or name == "header" and not home or named and name not in ("body", "html", "main")
        stack.append((name, boxed or around, home, link or name == "a"))
        opened[name] += 1
    close()
    return found


def _is_stop(word: str) -> bool:
    if word.isalpha():
        return word.lower() in STOP_WORDS
    found = _LETTERS.search(word)
    return found is not None and found[0].lower() in STOP_WORDS


def decide(found: list[Block]) -> list[Block]:
    """The blocks with the label ``good`` or ``bad``.

    First pass: boxed blocks are bad, and so are linked ones (share of linked words above 0.5), copyright
    marks outside an article, and long blocks outside an article with few stop words. Blocks of at least
    10 words with many stop words are good. Second pass: a block left open takes the label of the nearest
    decided blocks before and behind it in its article, or on the page where it lies in none; where
    they differ, a block of 10 words or more or a heading before a good block is good, another one bad.
    With none decided, a block in an article is good, another one is bad if the page has an article.
    """
    any_home = any(b.home and not b.boxed for b in found)
    for b in found:
        if b.boxed or b.links > LINKS and not (b.home and b.tag in HEADINGS) or not b.home and ("©" in b.text and b.words < LONG):
            b.label = "bad"
        elif b.words >= SHORT and b.stops >= STOPS_HIGH:
            b.label = "good" if b.home or not any_home else "bad"
        elif not b.home and (any_home or b.words >= LONG and b.stops < STOPS_LOW):
            b.label = "bad"
    before = _nearest(found, range(len(found)))
    behind = _nearest(found, range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        if b.label:
            continue
        sides = {before[i], behind[i]} - {""}
        if len(sides) == 1:
            b.label = sides.pop() + "?"
        elif sides:
            good = b.words >= SHORT or b.tag in HEADINGS and behind[i] == "good"
            b.label = "good?" if good else "bad?"
        else:
            b.label = "good?" if b.home or not any_home else "bad?"
    for b in found:
        b.label = b.label.rstrip("?")
    return found


def _nearest(found: list[Block], order: Iterable[int]) -> list[str]:
    """The label of the nearest block decided before each in ``order``, of the same article, boxes left out."""
    labels, last = [""] * len(found), {}
    for i in order:
        b = found[i]
        labels[i] = last.get(b.home, "")
        if b.label and not b.boxed and not (b.home and b.links > LINKS):
            last[b.home] = b.label
    return labels


def main_text(page: str | None) -> tuple[str, int, int]:
    """Main text of a page, its blocks and the kept ones."""
    found = decide(blocks(page)) if page else []
    kept = [b.text for b in found if b.label == "good"]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` with ``text``, ``n_blocks`` and ``n_kept``.

    A null or empty page, and one without an article, has an empty text and zero kept blocks. Columns of
    these names in ``pages`` are replaced. Repeated rows each give theirs.
    """
    rest = pages.drop(*[c for c in ("text", "n_blocks", "n_kept") if c != page])
    at = rest.columns.index(page)
    schema = extended(rest.schema, _text="string", _n_blocks="long", _n_kept="long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts, n, kept = zip(*[main_text(value) for value in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], names=schema.names)

    found = rest.mapInArrow(run, schema)
    return found.drop("text").withColumnsRenamed({"_text": "text", "_n_blocks": "n_blocks", "_n_kept": "n_kept"})


def page_blocks(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """One row per block: key, block (from 0), tag, words, stops, links, label, text."""
    narrow = pages.select(key, page)
    key_field = narrow.schema[0]
    schema = extended(narrow.schema, block="long", tag="string", words="long", stops="double", links="double", label="string", text="string")
    schema = type(schema)([key_field, *schema.fields[2:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(k, i, b.tag, b.words, b.stops, b.links, b.label, b.text)
                        for k, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                        for i, b in enumerate(decide(blocks(value)) if value else [])]
                columns = list(zip(*rows)) or [()] * 8
                kinds = [part.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

    return narrow.mapInArrow(run, schema)
