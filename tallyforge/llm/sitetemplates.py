"""Main text of HTML pages: removal of the subtrees that recur over a site.

Every element has two hashes: one of its whole subtree (tags, attributes, text), and one of its shape (tags, names of
attributes, classes and place in the page; text masked, runs of equal children folded), which also recognises menus,
adverts and footers whose words change from page to page. Spark counts both for each host, over pages of different
content; subtrees on a large share of a host's pages are its template and are deleted wherever they stand.

Two things are never template: paragraphs and headings of the main element (copies of an article on a host are still
its text), and, by shape, anything inside or around the main element. What repetition cannot show, on hosts with few
pages or for blocks that a site uses once, is left to what elements say about themselves (nav, footer, roles, classes).
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace
from .urlrules import host_and_path

#: A subtree is template on so many pages of different content and such a share of the host's, both at least.
MIN_PAGES = 5
MIN_SHARE = 0.25
#: The same for containers inside the main element, by their whole subtree.
INNER_PAGES = 10
INNER_SHARE = 0.8
#: A shape is template only if its subtrees hold at most this share of their pages' text, summed over the host.
MAX_TEXT_SHARE = 0.25
#: Templates of all hosts that are broadcast; beyond it they are joined by host.
BROADCAST_TEMPLATES = 200_000
#: Elements nested deeper are laid into the last one, as browsers do.
MAX_DEPTH = 512

# Fixed values of HTML: element names by their role.
_RAW = frozenset("script style".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
_DROP = frozenset("aside audio button canvas datalist dialog embed footer form frame frameset head header iframe input map menu meter nav noframes noscript object optgroup option output progress script select style svg template textarea title video".split())
_FLOW = frozenset("article blockquote caption code dd dl dt figcaption h1 h2 h3 h4 h5 h6 li main ol p pre table tbody td th thead tr ul".split())
_CLOSED_BY_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NEVER_MAIN = _INLINE | _DROP | _FLOW
_SCOPES = frozenset("article aside body div footer form header html main nav ol section table ul".split())
_DROP_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class names and ids that mark boilerplate, and words that may stand beside them in one name.
_DROP_WORDS = frozenset("ad ads adbox adsbygoogle advert advertisement advertising adverts banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related replies reply respond share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets".split())
_BESIDE = frozenset("and area articles bar block body bottom box button buttons container content form global group holder icons inner item items left links list lists main media message outer page panel post posts primary right row secondary section signup site slot sticky text the thread top unit wrap wrapper".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Up to the end of a tag: quoted values only behind an equals sign; possessive, so that nothing is tried again.
_REST = re.compile(r"((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
_NUMBER = re.compile(r"[0-9]+")
_NAME = re.compile(r"[a-z0-9_-]+")
_PART = re.compile(r"[a-z0-9]+")

#: What a page's stored form says of an element.
_IS_INLINE, _IS_BREAK, _IS_MARKED, _IS_SCOPE, _BY_TREE, _BY_SHAPE, _IS_INNER = (1 << k for k in range(7))


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html_lib.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _named(names: str) -> bool:
    """Whether a class or id marks boilerplate as a whole: all its parts are listed, one of them as a mark."""
    for name in _NAME.findall(names.lower()):
        parts = _PART.findall(name)
        if any(p in _DROP_WORDS for p in parts) and all(p in _DROP_WORDS or p in _BESIDE for p in parts):
            return True
    return False


def _marked(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element says itself that it isn't main text."""
    if tag in _DROP:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    if attributes.get("role", "").lower() in _DROP_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return _named(f"{attributes.get('class', '')} {attributes.get('id', '')}")


@dataclass(frozen=True)
class Kind:
    """What an element is by its tag and attributes alone: hashes of both, of their shape, of its part of a place."""

    tag: str
    exact: int
    shape: int
    place: int
    marked: bool
    semantic: bool


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _joined(h: int, x: int) -> int:
    """A 64-bit hash of a sequence, one more member at a time."""
    h = ((h ^ x) * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


#: Kinds seen so far, up to MOST_KINDS at a time. (A cached function would not be sent to executors by value.)
_KINDS: dict[tuple[str, str], Kind] = {}
MOST_KINDS = 1 << 14


def _kind(tag: str, attributes: str) -> Kind:
    if (known := _KINDS.get((tag, attributes))) is not None:
        return known
    if len(_KINDS) >= MOST_KINDS:
        _KINDS.clear()
    found = _attributes(attributes)
    name = _NUMBER.sub("#", found.get("class", ""))
    role = found.get("role", "").lower()
    exact = _hash("\0".join([tag, *sorted(f"{k}={v}" for k, v in found.items())]))
    shape = _hash("\0".join([tag, name, role, *sorted(found)]))
    made = Kind(tag, exact, shape, _hash(f"{tag}\0{name}"), _marked(tag, found), tag in ("article", "main") or role == "main")
    _KINDS[(tag, attributes)] = made
    return made


class Node:
    __slots__ = ("kind", "children", "digest", "shape", "size", "marked", "role")

    def __init__(self, kind: Kind):
        self.kind = kind
        self.children: list = []  # text or nodes
        self.digest = self.shape = self.size = 0
        self.marked = kind.marked
        self.role = 0  # 1: holds the main element, 2: is it, 3: stands inside it


def tree(page: str) -> Node:
    """The page as a tree; tolerant of missing end tags, stray ends and cut-off pages. Linear in the page's length."""
    root = Node(_kind("", ""))
    stack = [root]
    open_tags: dict[str, int] = {}

    def close(to: int) -> None:
        for node in stack[to:]:
            open_tags[node.kind.tag] -= 1
        del stack[to:]

    at, n, strict = 0, len(page), True
    last = page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:  # no tag can end any more
            stack[-1].children.append(page[at:])
            break
        if lt > at:
            stack[-1].children.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        rest = _REST.match(page, m.end()) if strict else None
        if rest is None:  # a quote that nothing closes: from here on tags end at the next >
            strict = False
            end = page.find(">", m.end())
            inside, at = page[m.end() : end], end + 1
        else:
            inside, at = rest.group(1), rest.end()
        tag = m.group(2).lower()
        if m.group(1):
            if not open_tags.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].kind.tag == tag:
                    close(k)
                    break
                if tag in _INLINE and stack[k].kind.tag not in _INLINE:
                    break
                if tag not in _SCOPES and stack[k].kind.tag in _SCOPES:
                    break
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in _CLOSED_BY_BLOCK or tag in _SIBLINGS:
            also = _SIBLINGS.get(tag, set()) | ({"p"} if tag in _CLOSED_BY_BLOCK else set())
            if any(open_tags.get(x) for x in also):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].kind.tag in also:
                        close(k)
                        break
                    if stack[k].kind.tag in _SCOPES:
                        break
        node = Node(_kind(tag, inside))
        stack[-1].children.append(node)
        if tag not in _VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def _preorder(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return order


def parse(page: str) -> Node:
    """The tree with hashes, text sizes, marks and the main element.

    The main element is article, main or role=main; on pages without one the deepest element with more than half of
    the text that stands outside of links."""
    root = tree(page)
    order = _preorder(root)
    for node in reversed(order):
        exact, shape, size, before = node.kind.exact, node.kind.shape, 0, 0
        for c in node.children:
            if isinstance(c, str):
                if not (text := _SPACE.sub(" ", c).strip()):
                    continue
                exact, form = _joined(exact, _hash(text)), 1
                size += len(text)
            else:
                exact, form = _joined(exact, c.digest), c.shape
                if c.kind.tag != "a" and c.kind.tag not in _DROP:
                    size += c.size
            if form != before:
                shape, before = _joined(shape, form), form
        node.digest, node.shape, node.size = exact, shape, size
    main = [x for x in order if x.kind.semantic]
    if not main:
        node = root
        while deeper := [c for c in node.children if isinstance(c, Node) and 2 * c.size > max(root.size, 1) and (c.kind.tag == "table" or c.kind.tag not in _NEVER_MAIN)]:
            node = deeper[0]
        main = [node]
    for node in main:
        node.role = 2
    todo = [(root, False, 0)]
    while todo:  # what stands inside, and places from above
        node, inside, place = todo.pop()
        if inside:
            node.role = 3
        node.shape = _joined(place, node.shape)
        place, inside = _joined(place, node.kind.place), node.role >= 2
        for c in node.children:
            if not isinstance(c, str):
                todo.append((c, inside, place))
    for node in reversed(order):  # what stands around
        if not node.role and any(not isinstance(c, str) and c.role in (1, 2) for c in node.children):
            node.role = 1
            if node.kind.tag not in _DROP:
                node.marked = False  # a class of something that holds the main element says nothing of the main text
    return root


def _flags(node: Node, semantic: bool) -> int:
    out = (_IS_INLINE if node.kind.tag in _INLINE else 0) | (_IS_BREAK if node.kind.tag == "br" else 0) | (_IS_MARKED if node.marked else 0)
    out |= _IS_SCOPE if node.role == 2 and semantic else 0
    if node.kind.tag and node.children and node.kind.tag not in ("html", "body") and node.role != 2:
        inner = node.role == 3
        if not (inner and (node.kind.tag in _FLOW or node.kind.tag in _INLINE)) and not (node.role == 1):
            out |= _BY_TREE | (_IS_INNER if inner else 0)
        if node.role == 0:
            out |= _BY_SHAPE
    return out


def stored(root: Node) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Events in page order (k: element k begins, -1: it ends, -2 - j: text j), and of each element its tree hash, shape
    hash, flags and text size; the texts."""
    order = _preorder(root)
    semantic = any(x.kind.semantic for x in order)
    number = {id(x): k for k, x in enumerate(order)}
    events, texts = [], []
    work: list = [root]
    while work:
        x = work.pop()
        if x is None:
            events.append(-1)
        elif isinstance(x, str):
            events.append(-2 - len(texts))
            texts.append(x)
        else:
            events.append(number[id(x)])
            work.append(None)
            work.extend(reversed(x.children))
    flags = np.array([_flags(x, semantic) for x in order], np.uint8)
    # hashes and sizes of elements that no template can hold are left out: zeros take no room once compressed
    by_tree, by_shape = flags & _BY_TREE != 0, flags & _BY_SHAPE != 0
    digests, shapes = (np.array([getattr(x, k) for x in order], np.uint64).view(np.int64) for k in ("digest", "shape"))
    sizes = np.array([x.size for x in order], np.int32) * (by_tree | by_shape)
    sizes[0] = root.size
    return np.array(events, np.int32), digests * by_tree, shapes * by_shape, flags, sizes.astype(np.int32), texts


def text_of(events, digests, shapes, flags, texts, by_tree, by_shape, lists: bool = True) -> str:
    """Blocks of the main content without template subtrees, then without marked ones and what is outside article and main.

    lists: False leaves out the second part."""
    scoped = lists and any(f & _IS_SCOPE for f in flags)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        block = _SPACE.sub(" ", html_lib.unescape("".join(held))).strip(" \t\n\x0b\x0c\r")
        if block:
            blocks.append(block)
        held.clear()

    # inside: depth of open scopes; skip: depth below a deleted element
    inside = skip = 0
    path: list[int] = []
    for e in events:
        if e == -1:
            f = flags[path.pop()]
            if skip:
                skip -= 1
                if not skip and not f & _IS_INLINE:
                    flush()
                continue
            if f & _IS_SCOPE:
                inside -= 1
            if f & _IS_BREAK:
                held.append(" ")
            elif not f & _IS_INLINE:
                flush()
        elif e >= 0:
            f = flags[e]
            path.append(e)
            if skip:
                skip += 1
            elif (f & _IS_MARKED and lists) or (f & _BY_TREE and digests[e] in by_tree) or (f & _BY_SHAPE and shapes[e] in by_shape):
                skip = 1
                if not f & _IS_INLINE:
                    flush()
            else:
                if f & _IS_SCOPE:
                    inside += 1
                if not f & (_IS_INLINE | _IS_BREAK):
                    flush()
        elif not skip and (inside or not scoped):
            held.append(texts[-2 - e])
    flush()
    return "\n".join(blocks)


def main_text(root: Node, template: frozenset[int] | set[int], shapes: frozenset[int] | set[int] = frozenset()) -> str:
    events, digests, forms, flags, _, texts = stored(root)
    return text_of(events.tolist(), digests.tolist(), forms.tolist(), flags.tolist(), texts, template, shapes)


STORED = "uid long, page_id {0}, url string, host string, content long, events binary, digests binary, shapes binary, flags binary, sizes binary, texts array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """Every page once in the form of stored(), with its host and a hash of its main text."""
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def scan(batches):
        for batch in batches:
            made = []
            for page in batch.column(4):
                root = parse(page.as_py())
                main = [x for x in _preorder(root) if x.role == 2]
                events, digests, shapes, flags, sizes, texts = stored(root)
                made.append((reduce(_joined, (x.digest for x in main), 0) - (1 << 63), events.tobytes(), digests.tobytes(), shapes.tobytes(), flags.tobytes(), sizes.tobytes(), texts))
            kinds = (pa.int64(), *[pa.binary()] * 5, pa.list_(pa.string()))
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["uid", "page_id", "url", "host", "content", "events", "digests", "shapes", "flags", "sizes", "texts"])

    return rows.mapInArrow(scan, STORED.format(pages.schema["page_id"].dataType.simpleString()))


def subtrees(table: DataFrame) -> DataFrame:
    """(host, content, kind, hash, size, page_size) of the subtrees that may be template, each once a page; kind 0: whole
    trees, 1: those inside the main element, 2: shapes; and one row of kind 3 for the page itself."""

    def scan(batches):
        for batch in batches:
            hosts, contents, columns = batch.column(0), batch.column(1), []
            for k in range(len(batch)):
                digests, shapes = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in (2, 3))
                flags, sizes = np.frombuffer(batch.column(4)[k].as_py(), np.uint8), np.frombuffer(batch.column(5)[k].as_py(), np.int32)
                tree, inner, shape = (flags & x != 0 for x in (_BY_TREE, _IS_INNER, _BY_SHAPE))
                kinds = np.concatenate([np.where(inner[tree], 1, 0), np.full(int(shape.sum()), 2), [3]])
                hashes = np.concatenate([digests[tree], shapes[shape], [0]])
                size = np.concatenate([sizes[tree], sizes[shape], [0]]).astype(np.int64)
                # a subtree that stands twice on a page counts once, with the sum of its sizes
                keys, back = np.unique(np.stack([kinds, hashes], axis=1), axis=0, return_inverse=True)
                columns.append((k, keys, np.bincount(back.reshape(-1), size, len(keys)).astype(np.int64), int(sizes[0])))
            if columns:
                at = np.repeat([c[0] for c in columns], [len(c[1]) for c in columns])
                keys = np.concatenate([c[1] for c in columns])
                total = np.repeat([c[3] for c in columns], [len(c[1]) for c in columns])
                yield pa.RecordBatch.from_arrays(
                    [hosts.take(pa.array(at)), contents.take(pa.array(at)), pa.array(keys[:, 0].astype(np.int32)), pa.array(keys[:, 1]), pa.array(np.concatenate([c[2] for c in columns])), pa.array(total.astype(np.int64))],
                    names=["host", "content", "kind", "hash", "size", "page_size"],
                )

    return table.select("host", "content", "digests", "shapes", "flags", "sizes").mapInArrow(scan, "host string, content long, kind int, hash long, size long, page_size long")


def templates(table: DataFrame) -> DataFrame:
    """(host, trees, shapes): the hashes of each host's template; at most about subtrees per page / MIN_SHARE of them.

    Pages of a host with the same main text count once: a group of copies makes nothing a template.
    """
    once = subtrees(table).groupBy("host", "content", "kind", "hash").agg(F.max("size").alias("size"), F.max("page_size").alias("page_size"))
    counts = once.groupBy("host", "kind", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("page_size").alias("page_size"))
    pages = counts.where("kind = 3").select("host", F.col("n").alias("pages"))
    inner = F.col("kind") == 1
    often = counts.where((F.col("kind") < 3) & (F.col("n") >= F.when(inner, INNER_PAGES).otherwise(MIN_PAGES))).join(pages, "host")
    often = often.where((F.col("n") >= F.when(inner, INNER_SHARE).otherwise(MIN_SHARE) * F.col("pages")) & ((F.col("kind") < 2) | (F.col("size") <= MAX_TEXT_SHARE * F.col("page_size"))))
    hashes = lambda shape: F.collect_set(F.when((F.col("kind") == 2) == shape, F.col("hash")))
    return often.groupBy("host").agg(hashes(False).alias("by_tree"), hashes(True).alias("by_shape"))


def extract(pages: DataFrame, parts: bool = False) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null html, and pages of boilerplate alone, have an empty text. Repeated rows are pages of their own. Pages without
    a host share the empty host. Only page_id, url and html are read; other columns don't matter.

    parts: adds without_template and without_lists, the texts that all else but the one of them would give.
    """
    ws = Workspace(pages.sparkSession, "templates")
    table = ws.write(parsed(pages), "parsed")
    found = ws.write(templates(table), "templates")
    size = found.agg(F.sum(F.size("by_tree") + F.size("by_shape"))).first()[0] or 0
    by_host = F.broadcast(found) if size <= BROADCAST_TEMPLATES else found

    def read(batches):
        for batch in batches:
            texts, extra = [], ([], [])
            sets: dict = {}
            for k in range(len(batch)):
                events, digests, shapes, flags = (np.frombuffer(batch.column(c)[k].as_py(), kind).tolist() for c, kind in ((2, np.int32), (3, np.int64), (4, np.int64), (5, np.uint8)))
                host = batch.column(7)[k].as_py()
                if host not in sets:
                    sets[host] = (frozenset(batch.column(8)[k].as_py() or ()), frozenset(batch.column(9)[k].as_py() or ()))
                page = (events, digests, shapes, flags, batch.column(6)[k].as_py())
                texts.append(text_of(*page, *sets[host]))
                if parts:
                    extra[0].append(text_of(*page, frozenset(), frozenset()))
                    extra[1].append(text_of(*page, *sets[host], lists=False))
            more = [pa.array(x, pa.string()) for x in extra] if parts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *more], names=["page_id", "url", "text", "n_chars", *(["without_template", "without_lists"] if parts else [])])

    rows = table.join(by_host, "host", "left").select("page_id", "url", "events", "digests", "shapes", "flags", "texts", "host", "by_tree", "by_shape")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long" + (", without_template string, without_lists string" if parts else ""))
