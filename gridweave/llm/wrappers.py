"""HTML extraction by union-free regular-expression wrappers.

A page is read into blocks of text inside nested block elements. Its expression is folded from that: an element is its tag with
class, id and role and the expression of its content; neighbours with one tag become a repeated element whose contents are
aligned, tandem repeats become repeated groups, and each place of text is a slot. The expressions of all pages of one host and
one kind of page are aligned, one after the other: what is in one only becomes optional. The result is the host's wrapper, a
regular expression without unions over tags and slots. For each slot it knows how many pages have it, whether its text is the same
on all of them (then it belongs to the template), and how much of it is links.

The wrapper decides which slots are main text: those of the article (else the main element, else the smallest element with most
of the text that varies), without boilerplate elements and without the template's own text. A page's blocks are kept as the slots
say that its expression is matched to. The kind of a page is the way to its article or main element, or, without one, the
elements of its body, so that templates of one host don't mix.

Scale: HTML is read once, in one narrow pass, and never shuffled. All pages count, but what is shuffled is one row for each distinct
expression of a host, and (expression, slot) sums, combined before the shuffle. A host's expressions are aligned ``GROUP`` at a time,
in rounds, so that no task holds a host with a third of all pages. Blocks and slots meet by the expression's hash.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import Any, NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.runs import release
from gridweave.llm.urls import host_of
from gridweave.session import staged

#: Longest group that folds when it repeats; items of one element beyond which their order is given up (a repeated group of optional
#: items); nested block elements that are told apart. None of these drops text.
PERIOD = 8
LONG = 64
DEPTH = 48
#: Expressions that one task aligns.
GROUP = 200
#: Share of the text that isn't boilerplate which the main element must hold.
MOST = 0.7
#: Pages on which a text must be the same to belong to the template, and the share of links from which a slot is a menu.
CONSTANT = 20
LINKS = 0.6

#: Elements whose content is raw text and not text of the page, and those that end with their start tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav noscript object ol option p pre section select summary svg table tbody td template tfoot th thead tr ul".split()
)
#: Elements, and head words of class, id and role, that mark what is not main text; and words that say nothing by themselves.
SKIP_TAGS = frozenset("nav aside footer form button select menu dialog label input head noscript template svg object".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus"
    " footer menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion related replies reply search share sharing sidebar"
    " signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
PLAIN_WORDS = frozenset("area bar block body bottom box buttons col column container content footer group header inner item left links list main outer panel right section slot text top unit wrap wrapper".split())
#: Elements that a new paragraph or list item closes.
INLINE = frozenset("p b i em strong a span u small font".split())
_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*))")
_PLAIN = re.compile(r"[^\"'>]*")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


# --- pages


def tag_end(page: str, at: int) -> tuple[int, int]:
    """Where the attributes that start at ``at`` end, and what follows their tag. A value without a closing quote ends at the next >."""
    start = at
    while True:
        at = _PLAIN.match(page, at).end()  # type: ignore[union-attr]
        if at >= len(page):
            return len(page), len(page)
        if page[at] == ">":
            return at, at + 1
        quoted = page[start:at].rstrip()[-1:] == "=" if at - start < 200 else page[at - 200 : at].rstrip()[-1:] == "="
        close = page.find(page[at], at + 1) if quoted else -1
        if quoted and close < 0:
            end = page.find(">", at)
            return (end, end + 1) if end >= 0 else (len(page), len(page))
        at = close + 1 if quoted else at + 1


def signature(name: str, attrs: str) -> str:
    """The tag with the words of its class, id and role, without digits; hidden elements are marked."""
    if not attrs.strip():
        return name
    words = {w.strip("-_") for a in _ATTR.findall(attrs) for w in re.sub(r"[\d!.]+", "", "".join(a[1:]).lower()).split()}
    return name + "".join(f".{w}" for w in sorted(words) if w) + ("!" if _HIDDEN.search(attrs) else "")


def skipped(sign: str, main: bool) -> bool:
    """Whether an element is boilerplate; a header inside the main element is part of it. Of a compound word its head counts."""
    name, *words = sign.rstrip("!").split(".")
    if name in ("html", "body", "main"):
        return False
    if sign.endswith("!") or name in SKIP_TAGS or (name == "header" and not main):
        return True
    return any(_head(w) in SKIP_WORDS for w in words)


def _head(word: str) -> str:
    parts = [p for p in re.split(r"[-_]+", word) if p]
    while len(parts) > 1 and parts[-1] in PLAIN_WORDS:
        parts.pop()
    return parts[-1] if parts else ""


class Page(NamedTuple):
    """Children as (key, children or block number); the blocks' texts and their characters inside links."""

    kids: list[Any]
    blocks: list[str]
    links: list[int]


def parse(page: str) -> Page:
    """Blocks in their block elements, in one pass over the page whose time is linear.

    End tags close what they can; paragraphs and list items close each other. Elements deeper than ``DEPTH`` count as their
    ancestor there. Text inside inline boilerplate is left out.
    """
    root: list[Any] = []
    blocks: list[str] = []
    links: list[int] = []
    # name, children, whether it is a level of its own, whether what is inside is left out
    stack: list[tuple[str, list[Any], bool, bool]] = [("", root, False, False)]
    opened: dict[str, int] = {}
    run: list[str] = []
    in_link, depth = [0], 0

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                stack[-1][1].append(("#", len(blocks)))
                blocks.append(text)
                links.append(min(in_link[0], len(text)))
            run.clear()
        in_link[0] = 0

    def say(text: str) -> None:
        if not stack[-1][3]:
            run.append(text)
            if opened.get("a"):
                in_link[0] += len(text.strip())

    def pop() -> str:
        nonlocal depth
        name, _, level, _ = stack.pop()
        opened[name] -= 1
        depth -= level
        return name

    at = 0
    while True:
        m = _OPEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        if m["comment"]:
            end = page.find("-->", m.start() + 2)
            at = len(page) if end < 0 else end + 3
            continue
        if m["other"]:
            end = page.find(">", m.end())
            at = len(page) if end < 0 else end + 1
            continue
        name = m["tag"].lower()
        stop, at = tag_end(page, m.end())
        if m["end"]:
            if name in BLOCK:
                flush()
            if opened.get(name):
                while True:
                    if stack[-1][2]:
                        flush()
                    if pop() == name:
                        break
            continue
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = len(page) if close is None else tag_end(page, close.end())[1]
            continue
        attrs = page[m.end() : stop]
        if name == "br":
            say(" ")
        if name in BLOCK:
            flush()
            if name == "p" or stack[-1][0] == "p" or opened.get("p") and stack[-1][0] in INLINE:
                while stack[-1][0] in INLINE:
                    pop()
            if name == "li":
                while stack[-1][0] in INLINE or stack[-1][0] == "li":
                    pop()
            if opened.get("head") and name != "head" and name not in SKIP_TAGS:
                while pop() != "head":
                    pass
        if name in VOID or attrs.endswith("/") and name in ("svg", "object", "template"):
            continue
        sign = signature(name, attrs)
        level = name in BLOCK and depth < DEPTH
        kids = stack[-1][1]
        if level:
            kids = []
            stack[-1][1].append(("<" + sign, kids))
        stack.append((name, kids, level, stack[-1][3] or (not level and skipped(sign, True))))
        opened[name] = opened.get(name, 0) + 1
        depth += level
    flush()
    return Page(root, blocks, links)


# --- expressions


class Item(NamedTuple):
    """A slot (key "#"), an element ("<" and its signature) or a group (""), with a flag: "", "?", "+" or "*" (both)."""

    key: str
    flag: str
    content: tuple[Any, ...]


Items = tuple[Item, ...]


def _flag(optional: bool, repeated: bool) -> str:
    return ("*" if repeated else "?") if optional else ("+" if repeated else "")


def name_of(x: Item) -> str:
    """What items are compared by."""
    return x.key or "(" + " ".join(name_of(y) for y in x.content) + ")"


def merge(a: Item, b: Item, neighbours: bool = False) -> Item:
    """The item that covers two of one name: in the same place of two pages, or neighbours on one."""
    optional = (a.flag in ("?", "*") and b.flag in ("?", "*")) if neighbours else (a.flag in ("?", "*") or b.flag in ("?", "*"))
    content = a.content if a.content == b.content else align(a.content, b.content)
    return Item(a.key, _flag(optional, neighbours or a.flag in ("+", "*") or b.flag in ("+", "*")), content)


def plain_key(key: str) -> str:
    """An element's key without class words; boilerplate stays marked."""
    return key if key == "#" else "<" + re.split(r"[.!]", key[1:])[0] + ("!" if skipped(key[1:], True) else "")


def collapse(items: list[Item]) -> Items:
    """Any order of the items: a repeated group of optional ones; without class words if they are many."""
    for keyed in (lambda k: k, plain_key):
        found: dict[str, Item] = {}

        def put(x: Item) -> None:
            if not x.key:
                for y in x.content:
                    put(y)
                return
            x = Item(keyed(x.key), _flag(True, x.flag in ("+", "*")), x.content)
            found[x.key] = merge(found[x.key], x) if x.key in found else x

        for x in items:
            put(x)
        if len(found) <= LONG:
            break
    return (Item("", "*", tuple(found.values())),)


def fold(items: list[Item]) -> Items:
    """Neighbours of one name become a repeated item, tandem repeats a repeated group."""
    out: list[Item] = []
    for x in items:
        if out and name_of(out[-1]) == name_of(x):
            out[-1] = merge(out[-1], x, True)
        else:
            out.append(x)
    names = [name_of(x) for x in out]
    for p in range(2, min(PERIOD, len(out) // 2) + 1):
        i, made, made_names = 0, [], []
        while i < len(out):
            if names[i : i + p] == names[i + p : i + 2 * p]:
                unit, j = out[i : i + p], i + p
                while names[j : j + p] == names[i : i + p] and j + p <= len(out):
                    unit = [merge(a, b) for a, b in zip(unit, out[j : j + p], strict=True)]
                    j += p
                made.append(Item("", "+", tuple(unit)))
                made_names.append(name_of(made[-1]))
                i = j
            else:
                made.append(out[i])
                made_names.append(names[i])
                i += 1
        out, names = made, made_names
    return collapse(out) if len(out) > LONG else tuple(out)


def align(a: Items, b: Items) -> Items:
    """The union-free expression that covers both."""
    names_a, names_b = [name_of(x) for x in a], [name_of(x) for x in b]
    if names_a == names_b:
        return tuple(merge(x, y) for x, y in zip(a, b, strict=True))
    if any(len(x) == 1 and not x[0].key and x[0].flag == "*" for x in (a, b)):
        return collapse([*a, *b])
    out: list[Item] = []
    for op, i, j, k, m in SequenceMatcher(None, names_a, names_b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
            continue
        for part, names in ((a[i:j], names_a[i:j]), (b[k:m], names_b[k:m])):
            # one occurrence of a group that the other side repeats
            whole = "(" + " ".join(names) + ")"
            other = [x for x in (*a[i:j], *b[k:m]) if not x.key and name_of(x) == whole]
            if other and len(part) > 1:
                part = (Item("", "", tuple(part)),)
            out += [Item(x.key, _flag(True, x.flag in ("+", "*")), x.content) for x in part]
    return fold(out)


def expression(page: Page) -> Items:
    """The page's own expression. Where the folded one is ambiguous, so that it doesn't match the page, the order is given up."""
    folded = folded_expression(page)
    return folded if Wrapper(folded).match(page.kids) is not None else loose(page.kids)


def folded_expression(page: Page) -> Items:

    def build(kids: list[Any]) -> Items:
        return fold([Item("#", "", ()) if key == "#" else Item(key, "", build(inner)) for key, inner in kids])

    return build(page.kids)


def show(items: Items) -> str:
    def one(x: Item) -> str:
        if x.key == "#":
            return "#" + x.flag
        inner = show(x.content)
        return f"{x.key}>{' ' + inner if inner else ''} </{x.flag}" if x.key else f"({inner}){x.flag}"

    return " ".join(one(x) for x in items)


def dump(items: Items) -> str:
    return json.dumps(items, ensure_ascii=False, separators=(",", ":"))


def load(text: str) -> Items:
    def one(x: list[Any]) -> Item:
        return Item(x[0], x[1], tuple(one(y) for y in x[2]))

    return tuple(one(x) for x in json.loads(text))


class Wrapper:
    """An expression whose slots have numbers, in order; matches children of pages or of other expressions."""

    def __init__(self, items: Items) -> None:
        self.slots = 0
        #: by slot, the keys of the elements around it
        self.around: list[tuple[str, ...]] = []
        self.nodes = self._compile(items, ())

    def _compile(self, items: Items, around: tuple[str, ...]) -> list[Any]:
        out = []
        for x in items:
            slot = -1
            if x.key == "#":
                slot, self.slots = self.slots, self.slots + 1
                self.around.append(around)
            inner = self._compile(x.content, (*around, x.key) if x.key else around)
            starts = {x.key} if x.key else set().union(*[n[1] for n in inner])
            out.append((x.key, starts, x.flag in ("+", "*"), slot, inner))
        return out

    def match(self, kids: list[Any]) -> dict[int, int] | None:
        """The slot of each text number among the children, or None if the expression has no place for one of them."""
        out: dict[int, int] = {}
        return out if self._all(self.nodes, kids, out) else None

    def _all(self, nodes: list[Any], kids: list[Any], out: dict[int, int]) -> bool:
        return self._run(nodes, kids, 0, out) == len(kids)

    def _place(self, nodes: list[Any], p: int, key: str) -> tuple[int, str]:
        """The first node from p on that may start with the key (else with its plain form), and the form."""
        for form in dict.fromkeys((key, plain_key(key))):
            for q in range(p, len(nodes)):
                if form in nodes[q][1]:
                    return q, form
        return len(nodes), key

    def _run(self, nodes: list[Any], kids: list[Any], k: int, out: dict[int, int]) -> int:
        """How far the children are matched from k on. Items that a page lacks are passed over."""
        p = 0
        while k < len(kids) and p < len(nodes):
            p, form = self._place(nodes, p, kids[k][0])
            if p == len(nodes):
                break
            node, exact = nodes[p], form == kids[k][0]
            while k < len(kids) and (kids[k][0] if exact else plain_key(kids[k][0])) in node[1]:
                if node[0]:
                    if node[0] == "#":
                        out[kids[k][1]] = node[3]
                    elif not self._all(node[4], kids[k][1], out):
                        return -1
                    k += 1
                else:
                    far = self._run(node[4], kids, k, out)
                    if far <= k:
                        return -1
                    k = far
                if not node[2]:
                    break
            p += 1
        return k


def loose(kids: list[Any]) -> Items:
    """An expression that gives up the order of every element's content; it matches whatever the order."""
    return collapse([Item("#", "", ()) if key == "#" else Item(key, "", loose(inner)) for key, inner in kids]) if kids else ()


def kids_of(items: Items) -> list[Any]:
    """The children that an expression stands for, each item once; texts have the numbers of its slots."""
    count = [0]

    def build(content: Items) -> list[Any]:
        out: list[Any] = []
        for x in content:
            if x.key == "#":
                out.append(("#", count[0]))
                count[0] += 1
            elif x.key:
                out.append((x.key, build(x.content)))
            else:
                out += build(x.content)
        return out

    return build(items)


#: By slot: pages, the least and the largest hash of its text on a page, characters, characters in links.
Slot = tuple[int, int, int, int, int]
FIELDS = ("n", "low", "high", "chars", "links")
_SLOTS = f"array<struct<{','.join(f'{f}:long' for f in FIELDS)}>>"
_SLOT_TYPE = pa.list_(pa.struct([(f, pa.int64()) for f in FIELDS]))


def combine(parts: list[tuple[Items, list[Slot | None]]]) -> tuple[Items, list[Slot | None]]:
    """The expression that covers all, and the sums of its slots."""
    parts = sorted(parts, key=lambda x: dump(x[0]))
    whole = parts[0][0]
    for items, _ in parts[1:]:
        if items != whole:
            whole = align(whole, items)
    wrapper = Wrapper(whole)
    sums: list[Slot | None] = [None] * wrapper.slots
    for items, slots in parts:
        for i, k in (wrapper.match(kids_of(items)) or {}).items():
            a, b = sums[k], slots[i]
            if a is not None and b is not None:
                b = (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], a[4] + b[4])
            sums[k] = b if b is not None else a
    return whole, sums


def choose(items: Items, sums: list[Slot | None], pages: int) -> list[bool]:
    """Which slots of a wrapper are main text."""
    w = Wrapper(items)
    chars = [s[3] if s else 0 for s in sums]
    same = [s is not None and pages >= CONSTANT and s[0] >= CONSTANT and s[1] == s[2] for s in sums]

    def inside(around: tuple[str, ...], main: str) -> bool:
        at = around.index(main)
        return not any(skipped(x[1:], i > at) for i, x in enumerate(around))

    keep = [False] * w.slots
    elements = list(dict.fromkeys(x for around in w.around for x in around))
    for tag in ("article", "main"):
        named = [x for x in elements if re.split(r"[.!]", x[1:])[0] == tag and any(x in a and inside(a, x) for a in w.around)]
        if named:
            keep = [named[0] in a and inside(a, named[0]) for a in w.around]
            break
    else:
        clear = [not any(skipped(x[1:], False) for x in a) and not (s is not None and s[3] and s[4] > LINKS * s[3]) for a, s in zip(w.around, sums, strict=True)]
        keep = clear if any(clear) else [not any(skipped(x[1:], False) for x in a) for a in w.around]
        varies = [k and not t for k, t in zip(keep, same, strict=True)]
        total = sum(c for c, v in zip(chars, varies, strict=True) if v)
        held = {x: sum(c for c, v, a in zip(chars, varies, w.around, strict=True) if v and x in a) for x in elements if plain_key(x)[1:] not in ("html", "body", "p", "ul", "ol", "li")}
        enough = sorted((n, -k, x) for k, (x, n) in enumerate(held.items()) if total and n >= MOST * total)
        if enough:
            keep = [k and enough[0][2] in a for k, a in zip(keep, w.around, strict=True)]
    # the template's own text, where other text shows that pages differ
    if any(k and not t for k, t in zip(keep, same, strict=True)):
        keep = [k and not t for k, t in zip(keep, same, strict=True)]
    return keep


def kind_of(items: Items) -> str:
    """The way to the first article or main element, or the elements of the body."""
    found: list[str] = []

    def seek(content: Items, way: str, tag: str) -> None:
        for x in content:
            if found:
                return
            if x.key.startswith("<") and skipped(x.key[1:], False):
                continue
            here = f"{way}/{x.key[1:]}" if x.key else way
            if x.key.startswith("<") and re.split(r"[.!]", x.key[1:])[0] == tag:
                found.append(here)
                return
            seek(x.content, here, tag)

    for tag in ("article", "main"):
        seek(items, "", tag)
        if found:
            return found[0]
    tops: set[str] = set()

    def top(content: Items) -> None:
        for x in content:
            if x.key in ("<html", "<body", "") or x.key.startswith(("<html.", "<body.")):
                top(x.content)
            elif x.key != "#" and not skipped(x.key[1:], False):
                tops.add(x.key)

    top(items)
    return " ".join(sorted(tops))


def apply(own: Items, sums: list[Slot | None], pages: int, wrapper: Items, keep: list[bool]) -> list[bool]:
    """Which slots of a page's expression the wrapper keeps; one that doesn't match is its own wrapper."""
    w = Wrapper(wrapper)
    matched = w.match(kids_of(own)) if w.slots == len(keep) else None
    if matched is None or len(matched) < len(sums):
        return choose(own, sums, pages)
    return [keep[matched[k]] for k in range(len(sums))]


def infer(pages: list[str]) -> tuple[Items, list[bool]]:
    """The wrapper of pages of one host and kind: its expression, and which slots are main text."""
    parts = []
    for page in map(parse, pages):
        own = expression(page)
        parts.append((own, page_slots(page, own)))
    whole, sums = combine(parts)
    return whole, choose(whole, sums, len(pages))


def page_slots(page: Page, own: Items) -> list[Slot | None]:
    """The sums of one page's slots; the text of a slot is that of all its blocks."""
    return _page_slots(page, Wrapper(own).match(page.kids) or {}, Wrapper(own).slots)


def _page_slots(page: Page, slots: dict[int, int], count: int) -> list[Slot | None]:
    texts: list[list[int]] = [[] for _ in range(count)]
    for k in range(len(page.blocks)):
        texts[slots[k]].append(k)
    out: list[Slot | None] = []
    for of in texts:
        h = xxhash.xxh64_intdigest("\n".join([page.blocks[k] for k in of]).encode("utf-8", "surrogatepass")) - (1 << 63)
        out.append((1, h, h, sum(len(page.blocks[k]) for k in of), sum(page.links[k] for k in of)) if of else None)
    return out


def read(page: str, wrapper: tuple[Items, list[bool]] | None) -> str:
    """The main text of a page: the blocks in the wrapper's slots of main text, one to a line."""
    parsed = parse(page)
    own = expression(parsed)
    slots = Wrapper(own).match(parsed.kids) or {}
    sums = page_slots(parsed, own)
    keep = choose(own, sums, 1) if wrapper is None else apply(own, sums, 1, *wrapper)
    return "\n".join(t for k, t in enumerate(parsed.blocks) if keep[slots[k]])


# --- tables


def read_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, host, kind, own, blocks, slots) for every row: own is the expression as JSON, blocks are (slot, text)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    block = pa.struct([("slot", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, Wrapper]] = {}
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                kinds, owns, blocks, sums = [], [], [], []
                for text in b.column("html").to_pylist():
                    page = parse(text or "")
                    items = folded_expression(page)
                    own = dump(items)
                    if own not in known:
                        if len(known) >= 1000:
                            known.clear()
                        known[own] = kind_of(items), Wrapper(items)
                    kind, wrapper = known[own]
                    slots = wrapper.match(page.kids)
                    if slots is None:
                        items = loose(page.kids)
                        own, kind, wrapper = dump(items), kind_of(items), Wrapper(items)
                        slots = wrapper.match(page.kids) or {}
                    kinds.append(kind)
                    owns.append(own)
                    blocks.append([{"slot": slots[k], "text": t} for k, t in enumerate(page.blocks)])
                    sums.append(_structs(_page_slots(page, slots, wrapper.slots)))
                made = [pa.array(kinds, pa.string()), pa.array(owns, pa.string()), pa.array(blocks, pa.list_(block)), pa.array(sums, _SLOT_TYPE)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host")), *made], ["page_id", "url", "host", "kind", "own", "blocks", "slots"])
        release()

    return rows.mapInArrow(run, "page_id long, url string, host string, kind string, own string, blocks array<struct<slot:int,text:string>>, slots " + _SLOTS)


def _structs(sums: list[Slot | None]) -> list[dict[str, int] | None]:
    return [None if s is None else dict(zip(FIELDS, s, strict=True)) for s in sums]


def _sums(column: Any) -> list[list[Slot | None]]:
    return [[None if s is None else tuple(s[f] for f in FIELDS) for s in row] for row in column.to_pylist()]


def infer_wrappers(skeletons: DataFrame, group: int = GROUP) -> DataFrame:
    """(host, kind, pages, wrapper, slots) from (host, kind, pages, own, slots): in rounds, ``group`` expressions in a task at most."""
    now = skeletons.select("host", "kind", "pages", F.col("own").alias("wrapper"), "slots")
    schema = f"host string, kind string, pages long, wrapper string, slots {_SLOTS}"
    def run(table: pa.Table) -> pa.Table:
        whole, sums = combine(list(zip(map(load, table["wrapper"].to_pylist()), _sums(table["slots"]), strict=True)))
        return pa.table({"host": table["host"][:1], "kind": table["kind"][:1], "pages": [sum(table["pages"].to_pylist())], "wrapper": [dump(whole)], "slots": pa.array([_structs(sums)], _SLOT_TYPE)})

    while True:
        sizes = now.groupBy("host", "kind").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
        dealt = now.join(sizes, ["host", "kind"]).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("parts")).cast("int"))
        most = sizes.agg(F.max("parts")).first()[0]
        now = staged(dealt.drop("parts").groupBy("host", "kind", "part").applyInArrow(run, schema), "wrappers")
        if not most or most == 1:
            return now


def extract(pages: DataFrame, id_col: str = "page_id", group: int = GROUP) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html); null HTML counts as empty.

    Null and odd URLs belong to the host of an empty name. Repeated rows stay repeated, each read like the others. Other columns are
    not looked at. Malformed markup is read as far as it goes, in linear time; an empty table gives an empty result.
    """
    rows = staged(read_pages(pages, id_col).withColumn("h", F.xxhash64("own")), "page-blocks")
    slots = rows.select("host", "h", F.posexplode("slots").alias("slot", "s")).groupBy("host", "h", "slot").agg(
        F.sum("s.n").alias("n"), F.min("s.low").alias("low"), F.max("s.high").alias("high"), F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"))
    slots = slots.groupBy("host", "h").agg(F.array_sort(F.collect_list(F.struct("slot", *FIELDS))).alias("s"))
    slots = slots.select("host", "h", F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in FIELDS])).alias("slots"))
    each = rows.groupBy("host", "h").agg(F.first("kind").alias("kind"), F.first("own").alias("own"), F.count(F.lit(1)).alias("pages"))
    each = staged(each.join(slots, ["host", "h"], "left").withColumn("slots", F.coalesce("slots", F.array().cast(_SLOTS))), "page-kinds")
    found = infer_wrappers(each, group).withColumnsRenamed({"pages": "all", "slots": "sums"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            columns = [b.column(c).to_pylist() for c in ("own", "pages", "wrapper", "all")]
            for own, n, wrapper, every, mine, sums in zip(*columns, _sums(b.column("slots")), _sums(b.column("sums")), strict=True):
                items = load(wrapper)
                kept.append(apply(load(own), mine, n, items, choose(items, sums, every)))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("h"), pa.array(kept, pa.list_(pa.bool_()))], ["host", "h", "keep"])

    keeps = each.join(found, ["host", "kind"]).select("host", "h", "own", "pages", "slots", "wrapper", "all", "sums")
    keeps = staged(keeps.mapInArrow(run, "host string, h long, keep array<boolean>"), "page-slots")
    joined = rows.select("page_id", "url", "host", "h", "blocks").join(keeps, ["host", "h"], "left")
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.get(F.col("keep"), b["slot"])), lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
