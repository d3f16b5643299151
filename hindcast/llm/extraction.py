"""Main text of web pages through wrappers inferred per host as union-free regular expressions.

A page is a stream of tags and text, nested as a browser would nest it. The wrapper of a host is a union-free expression
over such streams: inside each element, symbols (a tag with its class tokens, or `#` for a text slot) stand in order, each
once, with marks for optional and repeated ones, and repeated groups. A wrapper is inferred iteratively, page by page:
* texts that differ become a text slot (see below for those that do not);
* a run of equal symbols becomes a repeated symbol;
* where the streams mismatch, the symbols that only one side has become optional;
* a symbol that would be needed twice shows a repetition: all from its first to its last place becomes a repeated
  group, whose members are optional.
So a wrapper accepts every page it was inferred from. Wrappers align with each other just as pages do; each task infers
one per host from its pages, and these are merged in two levels, so a host with a third of all pages is not one task's
work and no page is left out.

The slots of a wrapper are judged once for the host: the region with the article (an `article` element, else `main`,
else the element that holds most text outside links), without navigation, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments, told by tag and by class tokens, each judged as a whole; a form or a class is not
believed of an element that holds the article. A page is matched with its host's wrapper, and the
texts in the slots of the first region that has any are its main text. A page that does not match (none of those the
wrapper was inferred from) is read by a wrapper of its own.

Texts are compared by block: a block's place is the path of its element, and a place keeps the blocks that all pages with
that place share (in table cells: equally often, as cells repeat few values). At the first mismatch a block becomes a
slot; blocks still constant after `several` pages that differ in their texts are template text and left out. Fewer pages
do not tell template from content, and where a page's region holds nothing but constants, they are its text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space; nothing
is cut. Null pages and pages without text are empty; a page without a readable host belongs to the host "". Repeated
rows are extracted alike, empty tables give an empty result, and only page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from hashlib import blake2b
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import through_storage
from .text import batch_of, chunks, grouped, ship

RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.large_string()), ("n_chars", pa.int64())])
WRAPPERS = pa.schema([("host", pa.string()), ("wrapper", pa.large_string())])
#: So many different pages tell what is constant from what is equal by chance.
SEVERAL = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: A start tag that ends open elements of the given names, up to the nearest of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPES = frozenset("html body table td th article section main aside nav div form blockquote button object".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CELLS = frozenset(("td", "th"))
UNWANTED = frozenset(
    "head nav header footer aside form button select option input label fieldset dialog menu object audio video canvas map".split()
) | RAW
UNWANTED_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer header legal login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup "
    "promo promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription teaser toolbar widget widgets alert".split()
)
NEVER_UNWANTED = frozenset(("html", "body", "main", "article"))
#: Parts of a class token that say what an element has or how it looks, not what it is: "no-sidebar", "is-sticky".
MODIFIERS = frozenset("no not non has have with without is are hide hidden show".split())
#: What a token that begins with an unwanted word may end in to name such an element: "ad-slot", "share-buttons".
PARTS = frozenset(
    "area bar block body box button buttons col column container content form group icon icons inner item items left link links "
    "list message nav panel post posts right row section slot text top bottom unit wrap wrapper".split()
)
#: An element that is kept for what it holds, though its name says otherwise.
KEPT = "!"
COMMENTS = frozenset("comment comments disqus replies reply respond related".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[A-Za-z][^\s/>]*)(?P<attributes>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")


def symbol(tag: str, attributes: str) -> str:
    """The tag and the tokens of its class, id, role and itemprop, without numbers; words of a token joined by "-"."""
    if "=" not in attributes:
        return tag
    tokens = set()
    for m in _ATTRIBUTE.finditer(attributes):
        tokens.update("-".join(_WORDS.findall(token)) for token in (m[2] or m[3] or m[4] or "").lower().split())
    tokens.discard("")
    return f"{tag}.{'.'.join(sorted(tokens))}" if tokens else tag


@lru_cache(1 << 14)
def unwanted_token(token: str) -> bool:
    """Whether a class token, judged as a whole, names something unwanted: it, or what it is a part of."""
    words = token.split("-")
    if not MODIFIERS.isdisjoint(words):
        return False
    return words[-1] in UNWANTED_WORDS or words[-1] in PARTS and not UNWANTED_WORDS.isdisjoint(words)


@lru_cache(1 << 14)
def unwanted(sym: str) -> bool:
    tag, *tokens = sym.split(".")
    if tag in NEVER_UNWANTED or KEPT in tokens:
        return False
    return tag in UNWANTED or any(map(unwanted_token, tokens))


@dataclass
class Element:
    tag: str
    symbol: str
    children: list = field(default_factory=list)  # elements and texts


def parse(html: str) -> Element:
    """The nested stream of a page, however deep."""
    root = Element("", "")
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where open elements of a tag stand in the stack
    at, n = 0, len(html)

    def last(names: Iterable[str]) -> int:
        return max((places[name][-1] for name in names if places.get(name)), default=0)

    def close(names: set[str], stops: Iterable[str]) -> None:
        i = last(names)
        if i and i >= last(stops):
            for element in stack[i:]:
                places[element.tag].pop()
            del stack[i:]

    while at < n:
        lower = html.find("<", at)
        m = _MARKUP.match(html, lower) if lower >= 0 else None
        while lower >= 0 and m is None:  # a "<" that opens nothing is text
            lower = html.find("<", lower + 1)
            m = _MARKUP.match(html, lower) if lower >= 0 else None
        stop = lower if lower >= 0 else n
        if stop > at:
            stack[-1].children.append(html[at:stop])
        if m is None:
            break
        at = m.end()
        if m["end"]:
            name = m["end"].lower()
            if name == "br":
                stack[-1].children.append(Element("br", "br"))
            else:
                close({name}, () if name in SCOPES or name in ("head", "body", "html") else ("td", "th", "table"))
        elif m["start"]:
            name = m["start"].lower()
            if name in ENDS:
                close(*ENDS[name])
            elif name in BLOCKS:
                close({"p"}, SCOPES)
            element = Element(name, symbol(name, m["attributes"]))
            stack[-1].children.append(element)
            if name == "svg" and m["attributes"].endswith("/"):
                pass  # in foreign content a slash closes the element
            elif name in RAW:
                raw = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                closing = html.find(">", raw.start()) if raw else -1
                at = closing + 1 if closing >= 0 else n
            elif name not in VOID and not m["attributes"].endswith("/"):
                places[name].append(len(stack))
                stack.append(element)
    _keep_holders(root)
    return root


def _keep_holders(root: Element) -> None:
    """Mark elements that are unwanted by name but hold the page's article.

    Those are forms and elements told by class words (not by other tags, nor comments and related articles) that hold a
    `main` element, or an article or first heading together with most of the page's text outside links.
    """
    order: list[tuple[Element, int, bool]] = [(root, -1, False)]
    for place, (element, _, linked) in enumerate(order):
        order += [(c, place, linked or c.tag == "a") for c in element.children if not isinstance(c, str)]
    size, main, article = [0] * len(order), [False] * len(order), [False] * len(order)
    for place in range(len(order) - 1, -1, -1):
        element, above, linked = order[place]
        if not linked:
            size[place] += sum(len(c.strip()) for c in element.children if isinstance(c, str))
        if above >= 0:
            size[above] += size[place]
            main[above] |= main[place] or element.tag == "main"
            article[above] |= article[place] or element.tag in ("article", "h1")
    for place, (element, _, _) in enumerate(order):
        holds = main[place] or article[place] and 2 * size[place] > size[0]
        if holds and (element.tag == "form" or element.tag not in UNWANTED) and unwanted(element.symbol):
            tokens = element.symbol.split(".")[1:]
            if not any(COMMENTS & set(token.split("-")) for token in tokens):
                element.symbol = ".".join([element.tag, KEPT, *tokens])


class Wrapper:
    """What stands inside one element.

    `items` are groups [members, repeated]; members are [symbol, optional, repeated]; a symbol stands once in all.
    `inner` holds the wrapper of each symbol; `text` and `linked` are the characters of text slots, and of those in links.
    """

    __slots__ = ("items", "inner", "text", "linked")

    def __init__(self, items: list, inner: dict[str, Wrapper], text: int, linked: int):
        self.items, self.inner, self.text, self.linked = items, inner, text, linked

    @classmethod
    def of(cls, element: Element, link: bool = False) -> Wrapper:
        """The wrapper of a single page."""
        # Pages nest deeper than Python calls may, so open elements are kept in a list here and below.
        opened: list[tuple] = [("", iter(element.children), [], {}, [0], link)]
        while True:
            name, children, row, inner, text, linked = opened[-1]
            for child in children:
                if isinstance(child, str):
                    size = len(child.strip())
                    if not size:
                        continue
                    text[0] += size
                    sym = "#"
                else:
                    sym = child.symbol
                if row and row[-1][0] == sym:
                    row[-1][2] = True
                else:
                    row.append([sym, False, True if sym == "#" else False])
                if sym != "#":
                    opened.append((sym, iter(child.children), [], {}, [0], linked or child.tag == "a"))
                    break
            else:
                own = cls(_folded(row, []), inner, text[0], text[0] if linked else 0)
                opened.pop()
                if not opened:
                    return own
                inner = opened[-1][3]
                inner[name] = inner[name].merged(own) if name in inner else own

    def merged(self, other: Wrapper) -> Wrapper:
        out = self._joined(other)
        todo = [(out, other)]
        while todo:
            both, more = todo.pop()
            for sym, own in more.inner.items():
                if sym in both.inner:
                    both.inner[sym] = both.inner[sym]._joined(own)
                    todo.append((both.inner[sym], own))
                else:
                    both.inner[sym] = own
        return out

    def _joined(self, other: Wrapper) -> Wrapper:
        """The two without what is inside the elements of the other."""
        return Wrapper(_aligned(self.items, other.items), dict(self.inner), self.text + other.text, self.linked + other.linked)

    def accepts(self, element: Element) -> bool:
        todo = [(self, element)]
        while todo:
            wrapper, element = todo.pop()
            if not wrapper._fits(element):
                return False
            todo += [(wrapper.inner[c.symbol], c) for c in element.children if not isinstance(c, str)]
        return True

    def _fits(self, element: Element) -> bool:
        """Whether the children stand as they may, whatever is inside them."""
        group, member = 0, -1
        places = {m[0]: (g, i) for g, (members, _) in enumerate(self.items) for i, m in enumerate(members)}
        seen = set()
        for child in element.children:
            if isinstance(child, str):
                if not child.strip():
                    continue
                sym = "#"
            else:
                sym = child.symbol
            if sym not in places:
                return False
            g, i = places[sym]
            members, repeated = self.items[g]
            if g < group or g == group and not repeated and (i < member or i == member and not members[i][2]):
                return False
            group, member = g, i
            seen.add(sym)
        return all(m[1] or m[0] in seen for members, _ in self.items for m in members)

    def dump(self) -> list:
        """All wrappers in a flat list, this one first; inner ones are given by their places."""
        nodes, out = [self], []
        for node in nodes:
            names = sorted(node.inner)
            out.append([node.items, {k: len(nodes) + i for i, k in enumerate(names)}, node.text, node.linked])
            nodes += [node.inner[k] for k in names]
        return out

    @classmethod
    def load(cls, data: list) -> Wrapper:
        nodes = [cls(items, {}, text, linked) for items, _, text, linked in data]
        for node, (_, inner, _, _) in zip(nodes, data, strict=True):
            node.inner.update((k, nodes[i]) for k, i in inner.items())
        return nodes[0]


def _folded(row: list[list], spans: list[tuple[int, int]]) -> list:
    """Groups from a row of members; `spans` (first, last) must become repeated groups, and so must what lies between
    two places of one symbol."""
    first: dict[str, int] = {}
    spans = list(spans)
    for i, (sym, _, _) in enumerate(row):
        if sym in first:
            spans.append((first[sym], i))
        else:
            first[sym] = i
    out, at = [], 0
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    items = []
    for low, high in [*out, [len(row), len(row)]]:
        items += [[[list(m)], False] for m in row[at:low]]
        if low < len(row):
            members: dict[str, list] = {}
            for sym, _, repeated in row[low : high + 1]:
                members[sym] = [sym, True, repeated or sym in members and members[sym][2]]
            items.append([list(members.values()), True])
        at = high + 1
    return items


def _aligned(a: list, b: list) -> list:
    """One expression for the streams of two."""
    if a == b:
        return a
    rows = [[m for members, _ in items for m in members] for items in (a, b)]
    names = [[m[0] for m in row] for row in rows]
    if names[0] == names[1]:
        pairs = [(i, i) for i in range(len(names[0]))]
    else:
        pairs = _common(*names)
    row: list[list] = []
    places: list[list[int]] = [[], []]
    i = j = 0
    for x, y in [*pairs, (len(rows[0]), len(rows[1]))]:
        for side, (low, high) in enumerate(((i, x), (j, y))):
            for m in rows[side][low:high]:
                places[side].append(len(row))
                row.append([m[0], True, m[2]])
        if x < len(rows[0]):
            for p in places:
                p.append(len(row))
            m, o = rows[0][x], rows[1][y]
            row.append([m[0], m[1] or o[1], m[2] or o[2]])
        i, j = x + 1, y + 1
    spans = []
    for side, items in enumerate((a, b)):
        at = 0
        for members, repeated in items:
            if repeated:
                spans.append((places[side][at], places[side][at + len(members) - 1]))
            at += len(members)
    return _folded(row, spans)


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two rows in which each symbol stands once: a longest rising one."""
    place = {sym: j for j, sym in enumerate(b)}
    lows: list[int] = []  # the smallest last place in b of a common subsequence of each length
    ends: list[tuple] = []
    for i, sym in enumerate(a):
        if sym in place:
            n = bisect_left(lows, place[sym])
            lows[n : n + 1] = [place[sym]]
            ends[n : n + 1] = [(i, place[sym], ends[n - 1] if n else None)]
    out, end = [], ends[-1] if ends else None
    while end:
        out.append(end[:2])
        end = end[2]
    return out[::-1]


def regions(wrapper: Wrapper) -> list[tuple[str, ...]]:
    """Paths of the elements that may hold the article, the likeliest first."""
    found: dict[str, list[tuple[int, tuple[str, ...]]]] = {"article": [], "main": []}
    order = [wrapper]
    for node in order:
        order += [v for k, v in node.inner.items() if not unwanted(k)]
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = node.text - 2 * node.linked + sum(size[id(v)] for k, v in node.inner.items() if not unwanted(k))

    def path_of(end: tuple | None) -> tuple[str, ...]:
        out = []
        while end:
            end, sym = end
            out.append(sym)
        return tuple(out[::-1])

    todo: list[tuple] = [(wrapper, None)]
    while todo:
        node, above = todo.pop()
        for sym, own in node.inner.items():
            if unwanted(sym):
                continue
            tag, *words = sym.split(".")
            here = (above, sym)
            words = {word for token in words for word in token.split("-")}
            if tag == "article" or "articlebody" in words:
                found["article"].append((size[id(own)], path_of(here)))
                continue
            if tag == "main" or "main" in words and tag in ("div", "section"):
                found["main"].append((size[id(own)], path_of(here)))
            todo.append((own, here))
    out = [path for kind in ("article", "main") for _, path in sorted(found[kind], key=lambda x: (-x[0], x[1]))]
    path, node = [], wrapper
    while True:  # down to the element in which most of the text still stands together
        whole = size[id(node)]
        steps = [(size[id(v)], k) for k, v in node.inner.items() if not unwanted(k) and k.split(".")[0] not in INLINE | {"p"}]
        most = max(steps, default=(0, ""))
        if not most[1] or most[0] * 10 < 8 * whole:
            break
        path.append(most[1])
        node = node.inner[most[1]]
    return [*dict.fromkeys([*out, tuple(path), ()])]


def _key(text: str, salt: int = 0) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, salt=salt.to_bytes(8)).digest())


@lru_cache(1 << 14)
def _below(place: int, sym: str) -> int:
    return _key(sym, place)


def blocks(element: Element, place: int = 0) -> list[tuple[int, str, str]]:
    """Blocks of text in an element without its unwanted parts: the place and the tag of the innermost block element
    that holds it, and the text. `place` is that of the element itself."""
    out: list[tuple[int, str, str]] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append((*holders[-1], text))

    holders = [(place, element.tag)]
    opened = [(iter(element.children), place, False)]
    while opened:
        children, here, inline = opened[-1]
        for child in children:
            if isinstance(child, str):
                run.append(references.unescape(child))
                continue
            if child.tag not in INLINE:
                end()
            if not unwanted(child.symbol):
                below = _below(here, child.symbol)
                opened.append((iter(child.children), below, child.tag in INLINE))
                if child.tag not in INLINE:
                    holders.append((below, child.tag))
                break
        else:
            opened.pop()
            if not inline:
                end()
                holders.pop()
    return out


class Constants:
    """The blocks of each place that all pages share, and the smallest `several` keys of pages with that place."""

    __slots__ = ("places",)

    def __init__(self, places: dict[int, tuple[list[int], frozenset[int]]]):
        self.places = places

    @classmethod
    def of(cls, page: Element) -> Constants:
        """The blocks of a single page."""
        found: dict[int, set[int]] = defaultdict(set)
        every = blocks(page)
        for place, block in _block_keys(every):
            found[place].add(block)
        page_key = _key("\n".join(text for _, _, text in every))
        return cls({place: ([page_key], frozenset(keys)) for place, keys in found.items()})

    def merged(self, other: Constants) -> Constants:
        places = dict(self.places)
        for place, (pages, keys) in other.places.items():
            if place in places:
                pages = sorted({*places[place][0], *pages})[:SEVERAL]
                keys = places[place][1] & keys
            places[place] = pages, keys
        return Constants(places)

    def template(self) -> set[tuple[int, int]]:
        """Place and key of the blocks that are template text."""
        return {(place, key) for place, (pages, keys) in self.places.items() if len(pages) >= SEVERAL for key in keys}

    def dump(self) -> list:
        return [[place, pages, sorted(keys)] for place, (pages, keys) in sorted(self.places.items())]

    @classmethod
    def load(cls, data: list) -> Constants:
        return cls({place: (pages, frozenset(keys)) for place, pages, keys in data})


def _block_keys(every: list[tuple[int, str, str]]) -> list[tuple[int, int]]:
    """Place and key of each block."""
    cells = Counter((place, text) for place, tag, text in every if tag in CELLS)
    return [(place, _key(text, cells.get((place, text), 0))) for place, _, text in every]


def _at(element: Element, path: tuple[str, ...]) -> Iterator[Element]:
    todo = [(element, 0)]
    while todo:
        here, n = todo.pop()
        if n == len(path):
            yield here
        else:
            todo += [(c, n + 1) for c in reversed(here.children) if not isinstance(c, str) and c.symbol == path[n]]


def main_text(page: Element, paths: list[tuple[str, ...]], template: Container[tuple[int, int]] = ()) -> str:
    for path in paths:
        place = 0
        for sym in path:
            place = _below(place, sym)
        every = [block for element in _at(page, path) for block in blocks(element, place)]
        if every:
            kept = [text for (_, _, text), key in zip(every, _block_keys(every), strict=True) if key not in template] if template else []
            return " ".join(kept or [text for _, _, text in every])
    return ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _both(a: tuple[Wrapper, Constants], b: tuple[Wrapper, Constants]) -> tuple[Wrapper, Constants]:
    return a[0].merged(b[0]), a[1].merged(b[1])


def _told(wrapper: Wrapper, constants: Constants) -> str:
    return json.dumps([wrapper.dump(), constants.dump()], separators=(",", ":"))


def _read(text: str) -> tuple[Wrapper, Constants]:
    wrapper, constants = json.loads(text)
    return Wrapper.load(wrapper), Constants.load(constants)


def _infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host from the pages of a partition."""
    found: dict[str, tuple[Wrapper, Constants]] = {}

    def told() -> pa.RecordBatch:
        return batch_of(WRAPPERS, [list(found), [_told(*x) for x in found.values()]])

    for batch in chunks(batches, "html"):
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host, page = host_of(url), parse(html)
            own = Wrapper.of(page), Constants.of(page)
            found[host] = _both(found[host], own) if host in found else own
        if len(found) > 5000:
            yield told()
            found.clear()
    yield told()


def _merge(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    for group in grouped(batches, keys):
        texts = sorted(group["wrapper"].to_pylist())
        out = texts[0]
        if len(texts) > 1:
            merged = _read(texts[0])
            for text in texts[1:]:
                merged = _both(merged, _read(text))
            out = _told(*merged)
        yield batch_of(WRAPPERS, [[group["host"][0].as_py()], [out]])


def wrappers(pages: DataFrame, parts: int = 16) -> DataFrame:
    """host and wrapper, one row per host, inferred from all its pages."""
    ship(pages.sparkSession)
    kind = "host string, wrapper string"
    found = pages.select("url", "html").mapInArrow(_infer, kind)
    found = found.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts)))
    for keys in (["host", "part"], ["host"]):
        found = found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_merge, keys=keys), kind)
    return found


_KNOWN: dict[str, tuple[Wrapper, list[tuple[str, ...]], set[tuple[int, int]]]] = {}


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html"):
        texts = []
        for html, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            page = parse(html)
            if data is not None and data not in _KNOWN:
                if len(_KNOWN) > 2000:
                    _KNOWN.clear()
                own, constants = _read(data)
                _KNOWN[data] = own, regions(own), constants.template()
            wrapper, paths, template = _KNOWN[data] if data is not None else (None, [], set())
            if wrapper is None or not wrapper.accepts(page):
                paths = regions(Wrapper.of(page))
            texts.append(main_text(page, paths, template))
        yield batch_of(RESULT, [batch.column(0), batch.column(1), texts, [len(t) for t in texts]])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of the main text, one row per page."""
    pages = pages.select("page_id", "url", "html")
    known = through_storage(wrappers(pages), "wrappers")
    # The host is derived as in the wrappers: in Python, once per page.
    hosted = pages.mapInArrow(_hosted, "page_id long, url string, html string, host string")
    joined = hosted.join(known, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def _hosted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], names=["page_id", "url", "html", "host"])
