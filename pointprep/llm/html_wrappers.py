"""Main text of web pages by wrappers: union-free regular expressions over page tokens.

A page is a stream of tags and text slots. Adjacent repeats fold into repeated groups, from
the inside out. All pages of a host are grouped by their folded stream, and the streams are then aligned one after another:
what only some of them have becomes optional, a group that one page has once and another
often becomes a repeated group, and text meets text in a slot. There is no alternation. The
result is the host's wrapper. Each of its parts is marked as content or not from where its
slots lie and whether their text is the same on all pages. Every page of the host is aligned with the wrapper and
gives the slots of content parts.
"""

from __future__ import annotations

import html
import json
import math
import pickle
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import xxhash
from pyspark.sql import DataFrame, functions as F

from pointprep.llm.common import arrow_map, materialize

#: Structures of a host that are aligned in one step.
PIECE = 24
#: Structures that a task adds up before it sends them on.
HELD = 500
#: Different texts of a slot that are told apart; a slot with more varies.
TEXTS = 16
#: Tokens in the longest unit that can fold.
UNIT = 12
#: Bytes of wrappers that are sent to every worker; more are joined by host.
BROADCAST_BYTES = 32 << 20

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S | re.I,
)
MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ASIDE = frozenset("nav footer aside form head select button menu dialog".split())
MAIN = frozenset(("article", "main"))
#: Words of class, id and role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner cookie cookies consent notice notices popup modal newsletter subscribe promo sponsor sponsored "
    "sidebar menu nav navigation navbar breadcrumb breadcrumbs footer masthead comment comments share social related login search complementary contentinfo".split()
)
_WORDS = re.compile(r"[A-Za-z]+")


def tokens(page: str) -> list[tuple]:
    """(symbol, tag, closes, text) of each tag and text; comments, scripts and blank text are left out.

    A text is decoded; its symbol is ``#``. A tag's symbol names its class, id and role.
    """
    out: list[tuple] = []
    for m in TOKEN.finditer(page):
        name = m[3]
        if name:
            name = name.lower()
            if m[2]:
                out.append((f"</{name}>", name, True, ""))
            else:
                marks = [(a or b or c).strip() for _, a, b, c in MARK.findall(m[4])] if "=" in m[4] else []
                out.append((f"<{' '.join([name, *marks])}>", name, False, ""))
        elif m[1] is None and m[0][0:2] not in ("<!", "<?"):
            text = html.unescape(m[0])
            if out and out[-1][0] == "#":
                out[-1] = ("#", "", False, out[-1][3] + text)
            elif text.strip() or out and out[-1][1] in INLINE:
                out.append(("#", "", False, text))
    return out


def places(stream: list[tuple]) -> list[int]:
    """For each token 3 within the article, 2 there in an element that only a word of its class marks, 1 outside, 0 where menus, adverts and the like are."""
    out, stack, main, hard = [], [], 0, []

    def here() -> int:
        return (2 if main and not any(hard) else 0) if stack else 3 if main else 1

    for symbol, tag, closes, _ in stream:
        if not tag:
            out.append(here())
            continue
        aside = firm = tag in ASIDE or tag == "header" and not main
        if not aside and not closes and " " in symbol:
            aside = tag not in ("html", "body") and tag not in MAIN and any(w.lower() in ASIDE_WORDS for w in _WORDS.findall(symbol[len(tag) + 1:]))
        if tag in MAIN and not stack:
            main = max(0, main - 1) if closes else main + 1
        if closes:
            if tag in stack:
                while stack.pop() != tag:
                    hard.pop()
                hard.pop()
                out.append(0)
                continue
        elif tag not in VOID and (stack and tag not in INLINE or aside):
            # Paragraphs and list items are closed by the next one, often without a mark.
            if not stack or tag not in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                stack.append(tag)
                hard.append(firm)
        out.append(here())
    return out


def fold(stream: list, units: set) -> list[tuple]:
    """(symbol, first, end) with adjacent repeats as groups; ``units`` gets the repeated units.

    Single occurrences of a unit that is known to repeat become groups too.
    """
    items = [(s, i, i + 1) for i, s in enumerate(stream)]
    for size in range(1, UNIT + 1):
        if len(items) < size:
            break
        symbols = [x[0] for x in items]
        out, i, n = [], 0, len(items)
        while i < n:
            unit = tuple(symbols[i: i + size])
            j = i + size
            if size > 1 or isinstance(unit[0], str) and unit[0] != "#":
                while j + size <= n and symbols[j] == unit[0] and tuple(symbols[j: j + size]) == unit:
                    j += size
            if j > i + size or len(unit) == size and unit in units:
                units.add(unit)
                out.append((("+", unit), items[i][1], items[j - 1][2]))
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(left: list, right: list) -> list[tuple[int | None, int | None]]:
    """Index pairs of two lists of symbols, in order; None where one side lacks the other's."""
    out: list[tuple[int | None, int | None]] = []
    number: dict = {}
    left, right = ([number.setdefault(s, len(number)) for s in x] for x in (left, right))
    for kind, a, b, c, d in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out += zip(range(a, b), range(c, d))
        else:
            out += [(i, None) for i in range(a, b)]
            out += [(None, j) for j in range(c, d)]
    return out


def regroup(parts: list[list], units: set) -> list[tuple]:
    """(symbol, first, end) of parts that are folded already, with the units of other pages as groups too."""
    return fold([p[0] for p in parts], units)


def outline(page: str) -> tuple[str, dict]:
    """A key of the page's structure, and its structure as a wrapper of one page.

    A part is its symbol, the pages that have it, and what is known of its text: pages by place where the page
    has an article, pages by place where it has none, up to three pages for each different text (None for
    more than TEXTS texts), and texts known to be fixed.
    """
    stream = tokens(page)
    place = places(stream)
    articled = max(place, default=0) >= 2
    units: set = set()
    items = fold([t[0] for t in stream], units)
    mark = xxhash.xxh3_64_intdigest("\0".join(t[3] for t in stream if not t[1]).encode("utf-8", "surrogatepass"))
    parts, shape = [], []
    for symbol, a, b in items:
        text = " ".join(t[3] for t in stream[a:b] if not t[1])
        known = None
        if text.strip():
            q = max((q for q, t in zip(place[a:b], stream[a:b]) if not t[1]), default=0)
            known = [[0] * 4, [0] * 4, {text_hash(text): [mark]}, set()]
            known[0 if articled else 1][q] = 1
            shape.append(q)
        else:
            shape.append(None)
        parts.append([symbol, 1, known])
    key = xxhash.xxh3_128_hexdigest(repr(([p[0] for p in parts], shape, articled)).encode("utf-8", "surrogatepass"))
    return key, {"parts": parts, "units": units, "articled": int(articled)}


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"))


def _texts(x: dict | None, y: dict | None) -> dict | None:
    if x is None or y is None:
        return None
    out = dict(x)
    for t, marks in y.items():
        out[t] = sorted({*out[t], *marks})[:3] if t in out else marks
    return out if len(out) <= TEXTS else None


def _both(x: list | None, y: list | None) -> list | None:
    if x is None or y is None:
        return x or y
    return [[a + b for a, b in zip(x[0], y[0])], [a + b for a, b in zip(x[1], y[1])], _texts(x[2], y[2]), x[3] | y[3]]


def absorb(held: dict, other: dict) -> None:
    """Add another page of the same structure."""
    for p, q in zip(held["parts"], other["parts"]):
        p[1] += q[1]
        p[2] = _both(p[2], q[2])
    held["articled"] += other["articled"]


def is_fixed(texts: dict | None) -> bool:
    """Whether each text is on three different pages; copies of a page are one."""
    return bool(texts) and all(len(marks) >= 3 for marks in texts.values())


def settle(wrapper: dict) -> dict:
    """Note the texts that are fixed in a structure, once all its pages are in, so that alignment with other structures does not hide them."""
    for p in wrapper["parts"]:
        if p[2] and is_fixed(p[2][2]):
            p[2][3] = set(p[2][2])
    return wrapper


def _grouped(wrapper: dict, units: set) -> list[list]:
    out = []
    for symbol, a, b in regroup(wrapper["parts"], units):
        inner = wrapper["parts"][a:b]
        known = None
        for p in inner:
            if p[2]:
                # A group counts once per page, at the place of its best text.
                known = p[2] if known is None else [
                    *max((known[:2], p[2][:2]), key=lambda v: [v[0][q] + v[1][q] for q in (3, 2, 1)]), _texts(known[2], p[2][2]), known[3] | p[2][3]
                ]
        out.append([symbol, max(p[1] for p in inner), known])
    return out


def merge(wrappers: list[dict]) -> dict:
    """One wrapper of several: what only some of them have becomes optional later on."""
    if len(wrappers) == 1:
        return wrappers[0]
    units = set().union(*(w["units"] for w in wrappers))
    # Grouping again lets units found on one page show on another.
    parts: list[list] = []
    for w in wrappers:
        merged, its = [], _grouped(w, units)
        for i, j in align([p[0] for p in parts], [p[0] for p in its]):
            if i is None or j is None:
                merged.append(parts[i] if j is None else its[j])
            else:
                merged.append([parts[i][0], parts[i][1] + its[j][1], _both(parts[i][2], its[j][2])])
        parts = merged
    return {"parts": parts, "units": units, "pages": sum(w["pages"] for w in wrappers), "articled": sum(w["articled"] for w in wrappers)}


def _varies(texts: dict | None) -> bool:
    return texts is None or not is_fixed(texts) and len(texts) > 1 and len(set().union(*texts.values())) >= 3


def _list_of_items(symbol) -> bool:
    """Whether a repeated unit holds links or marked elements, as comments and related pages do and paragraphs do not."""
    if isinstance(symbol, str):
        return symbol.startswith("<") and (" " in symbol or symbol == "<a>")
    return any(_list_of_items(s) for s in symbol[1])


def finish(wrapper: dict) -> dict:
    """What extraction needs of a wrapper: parts, which are optional, content or not on pages with and without an article.

    A fixed text is no content wherever it lies. A slot that lies in the article on most pages is content. One that a
    class word marks there is content if its text varies and most pages with an article have it; if it is a repeated
    group, only if it is one of paragraphs and the article has no other such group, so that it is the body.
    """
    def unmarked(art: list) -> bool:
        return art[3] * 2 > sum(art)

    body = any(not isinstance(s, str) and k and unmarked(k[0]) and _varies(k[2]) for s, _, k in wrapper["parts"])
    content, fixed = [], []
    for symbol, _, known in wrapper["parts"]:
        if known is None:
            content.append(None)
            fixed.append([])
            continue
        art, plain, texts, own = known
        same = is_fixed(texts)
        inside = open_ = None
        if any(art):
            inside = not same and unmarked(art)
            if not same and not inside and (art[2] + art[3]) * 2 > sum(art):
                inside = _varies(texts) and sum(art) * 2 > wrapper["articled"] and (isinstance(symbol, str) or not body and not _list_of_items(symbol))
        if any(plain):
            open_ = plain[1] * 2 > sum(plain) and not same
        content.append([inside, open_])
        fixed.append(sorted(own))
    return {
        "parts": [p[0] for p in wrapper["parts"]], "optional": [p[1] < wrapper["pages"] for p in wrapper["parts"]],
        "content": content, "fixed": fixed, "units": sorted(wrapper["units"], key=repr),
    }


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages of a host: parts in order, which of them are optional, and which hold content."""
    held: dict[str, dict] = {}
    for page in pages:
        if page:
            add_page(held, "", page)
    structures = [settle(w) for _, w in sorted(held.items())]
    return finish(merge(structures) if structures else {"parts": [], "units": set(), "pages": 0, "articled": 0})


def add_page(held: dict, host: str, page: str) -> None:
    key, own = outline(page)
    own["pages"] = 1
    at = (host, key)
    if at in held:
        absorb(held[at], own)
        held[at]["pages"] += 1
    else:
        held[at] = own


def _frozen(symbol):
    return symbol if isinstance(symbol, str) else tuple(_frozen(s) for s in symbol)


def expression(wrapper: dict) -> str:
    """The wrapper as a union-free regular expression, for people to read."""

    def shown(s) -> str:
        return s if isinstance(s, str) else "(" + "".join(shown(x) for x in s[1]) + ")+"

    return " ".join(shown(s) + "?" * bool(o) for s, o in zip(wrapper["parts"], wrapper["optional"]))


def _parts_of(symbols: list, wrapper: dict) -> list[int | None]:
    """For each folded symbol of a page the part of the wrapper that it meets; pages of one structure are aligned once."""
    known = wrapper.setdefault("aligned", {})
    at = tuple(symbols)
    if at not in known:
        if len(known) > 500:
            known.clear()
        items = fold(symbols, set(wrapper["units"]))
        out: list[int | None] = [None] * len(symbols)
        for i, j in align(wrapper["parts"], [x[0] for x in items]):
            if i is not None and j is not None:
                out[items[j][1]: items[j][2]] = [i] * (items[j][2] - items[j][1])
        known[at] = out
    return known[at]


def extract(page: str, wrapper: dict) -> str:
    """The blocks of a page's content slots, joined by two line feeds."""
    stream = tokens(page)
    place = places(stream)
    items = fold([t[0] for t in stream], set())
    own = [False] * len(stream)
    articled = max(place, default=0) >= 2
    for (_, a, b), part in zip(items, _parts_of([x[0] for x in items], wrapper)):
        known = wrapper["content"][part] if part is not None else None
        verdict = known[0 if articled else 1] if known else None
        if verdict and wrapper["fixed"][part]:
            verdict = text_hash(" ".join(t[3] for t in stream[a:b] if not t[1])) not in wrapper["fixed"][part]
        if verdict is None:
            top = 3 if articled else 1
        else:
            # The wrapper decides on a part; within it, the page's own containers tell its text from an aside.
            top = max((place[t] for t in range(a, b) if not stream[t][1]), default=0) if verdict else 0
        for t in range(a, b):
            own[t] = place[t] == top > 0
    blocks, current = [], []

    def close() -> None:
        block = " ".join("".join(current).split())
        if block:
            blocks.append(block)
        current.clear()

    for (_, tag, _, text), mine in zip(stream, own):
        if tag == "br":
            current.append(" ")
        elif tag and tag not in INLINE:
            close()
        elif not tag and mine:
            current.append(text)
    close()
    return "\n\n".join(blocks)


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _packed(wrapper: dict) -> bytes:
    return zlib.compress(pickle.dumps(wrapper), 1)


def _unpacked(data: bytes) -> dict:
    return pickle.loads(zlib.decompress(data))


def structures(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host``, ``shape`` and ``part``, the wrapper of all its pages, of every structure of every host.

    Each task adds up its pages by structure before the shuffle, so the rows of a host that holds many pages are few.
    """

    def count(batches: Iterator[dict]):
        held: dict = {}
        for batch in batches:
            for h, p in zip(batch["host"].to_pylist(), batch["html"]):
                if text := p.as_py():
                    add_page(held, h, text)
                    if len(held) >= HELD:
                        yield from ((*k, _packed(w)) for k, w in held.items())
                        held = {}
        yield from ((*k, _packed(w)) for k, w in held.items())

    def add(batches: Iterator[dict]):
        at, held = None, None
        for batch in batches:
            for h, k, data in zip(batch["host"].to_pylist(), batch["shape"].to_pylist(), batch["part"]):
                w = _unpacked(data.as_py())
                if at == (h, k):
                    absorb(held, w)
                    held["pages"] += w["pages"]
                else:
                    if held is not None:
                        yield *at, _packed(settle(held))
                    at, held = (h, k), w
        if held is not None:
            yield *at, _packed(settle(held))

    schema = "host string, shape string, part binary"
    counted = arrow_map(pages.select(host_of(url).alias("host"), F.col(page).alias("html")), count, schema, out_rows=500)
    return materialize(arrow_map(counted.repartition("host", "shape").sortWithinPartitions("host", "shape"), add, schema, out_rows=500), "structures")


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host`` and its ``wrapper`` as JSON, from all pages of the host.

    Structures are aligned about PIECE at a time and the wrappers of pieces again, until each host has one.
    """

    def join(batches: Iterator[dict]):
        at, held, shape = None, [], ""
        for batch in batches:
            for h, n, k, data in zip(*(batch[c].to_pylist() for c in ("host", "piece", "shape")), batch["part"]):
                if at != (h, n) and held:
                    yield at[0], shape, _packed(merge(held))
                    held = []
                if not held:
                    at, shape = (h, n), k
                held.append(_unpacked(data.as_py()))
        if held:
            yield at[0], shape, _packed(merge(held))

    def last(batches: Iterator[dict]):
        for batch in batches:
            for h, data in zip(batch["host"].to_pylist(), batch["part"]):
                yield h, json.dumps(finish(_unpacked(data.as_py())))

    level = structures(pages, url, page)
    most = level.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    while most > 1:
        most = math.ceil(most / PIECE)
        pieces = level.withColumn("piece", F.pmod(F.xxhash64("shape"), F.lit(most)))
        dealt = pieces.repartition("host", "piece").sortWithinPartitions("host", "piece", "shape")
        level = materialize(arrow_map(dealt, join, "host string, shape string, part binary", out_rows=100), "pieces")
    return arrow_map(level, last, "host string, wrapper string", out_rows=100)


_PARSED: dict[str, dict] = {}


def _parsed(text: str) -> dict:
    if text not in _PARSED:
        if len(_PARSED) > 2_000:
            _PARSED.clear()
        w = json.loads(text)
        _PARSED[text] = w | {"fixed": [frozenset(f) for f in w["fixed"]], "parts": [_frozen(s) for s in w["parts"]], "units": [_frozen(u) for u in w["units"]]}
    return _PARSED[text]


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    A null or empty page gives an empty text; pages with a null address form a host of
    their own. Each row gives one row, repeated rows too; other columns are dropped.
    """
    wrappers = materialize(infer_wrappers(pages, url, page), "wrappers")
    weight = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    known = F.broadcast(wrappers) if weight <= BROADCAST_BYTES else wrappers
    joined = pages.select(F.col(key), F.col(url), F.col(page).alias("html"), host_of(url).alias("host")).join(known, "host", "left")

    def rows(batches: Iterator[dict]):
        for batch in batches:
            for k, u, p, w in zip(batch[key].to_pylist(), batch[url].to_pylist(), batch["html"], batch["wrapper"].to_pylist()):
                text = extract(p.as_py(), _parsed(w)) if w and p.as_py() else ""
                yield k, u, text, len(text)

    kind = pages.schema[key].dataType.simpleString()
    return arrow_map(joined.select(key, url, "html", "wrapper"), rows, f"{key} {kind}, {url} string, text string, n_chars long")
