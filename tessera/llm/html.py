"""Main text of web pages by consensus paths of their hosts.

Each page scores its containers and votes for the tag-class path of the best;
digits in class names are generalised, so that pages of one template agree.
Spark adds the votes up per host, and every page is extracted from the
container at the path that its host agrees on. A page that lacks the path
falls back to its own best container.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, Scratch, slices

#: Elements by what HTML makes of them (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: A start tag of the key closes an open element of the values, up to a container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
          "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th", "p"}, "tfoot": {"tbody", "tr", "td", "th", "p"}}
P_ENDS = BLOCK - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd", "legend", "summary", "body", "html"}
HOLDERS = frozenset("ul ol dl table select div section article main aside nav header footer form body blockquote figure".split())
CONTAINERS = frozenset(["", *"article main section div body td blockquote".split()])  # "" is the page itself
INLINE_FORMAT = frozenset("a b big code em font i small strong tt u s span".split())
#: Elements and roles that are not part of the main text, and class names and ids of
#: such: all their words are of the first list or beside it of the second (fixed values).
APART = frozenset("nav header footer aside form button select script style noscript template dialog menu svg iframe object canvas head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adv banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header"
    " masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promos promoted promotion related replies responses share sharing sidebar"
    " signup skip social sponsor sponsored sponsors subscribe subscription syndication toolbar widget widgets".split()
)

BESIDE = frozenset(
    "area bar block body bottom box btn button buttons card cards col column container content count desktop entry field fixed form global group holder icon icons inner item items js left"
    " link links list local main mini mobile module outer page panel post posts primary right row secondary section site slot sub sticky tab text title top unit user utility wrap wrapper zone".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+")
#: Where elements end whose content is not markup.
ENDS = {t: re.compile(f"</{t}(?=[\\s/>])", re.I | re.A) for t in RAW}


def names_aside(name: str) -> bool:
    """Whether a class name or id says, as a whole, that what it holds is not main text."""
    words = [w.lower() for w in PARTS.findall(name)]
    return any(w in WORDS for w in words) and all(w in WORDS or w in BESIDE for w in words)


@lru_cache(maxsize=4096)
def _attributes(text: str) -> tuple[str, bool, bool]:
    """The generalised class of an element, and whether its attributes set it apart, and whether its names do."""
    found = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    named = any(map(names_aside, f"{found.get('class', '')} {found.get('id', '')}".split()))
    apart = found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    classes = sorted({re.sub(r"\d+", "0", c) for c in found.get("class", "").lower().split()})
    return ".".join(classes), apart, named


class Node:
    """An element; ``apart`` if it or one around it is no main text, ``named`` if only a name says so."""

    __slots__ = ("tag", "path", "apart", "named", "parent", "text", "links", "paragraphs")

    def __init__(self, tag, path, apart, named, parent):
        self.tag, self.path, self.apart, self.named, self.parent = tag, path, apart, named, parent
        self.text = self.links = self.paragraphs = 0


def step(path: str, tag: str, name: str) -> str:
    """The path of a block element below ``path``: its depth and a digest of all tags and classes down to it.

    A path is as long at any depth, and a shallower one sorts first.
    """
    depth = int(path[:8]) + 1 if path else 1
    return f"{depth:08d}{xxhash.xxh3_128_hexdigest(f'{path}/{tag}.{name}')}"


class Open:
    """The open elements of a page, counted by tag: all, those since the last block, and those since the last holder."""

    def __init__(self, root: Node):
        self.stack, self.links = [root], 0
        self.all: dict[str, int] = {}
        self.since_block: list[dict[str, int]] = [{}]
        self.since_holder: list[dict[str, int]] = [{}]

    def push(self, node: Node) -> None:
        tag = node.tag
        self.stack.append(node)
        self.links += tag == "a"
        for counts in (self.all, self.since_block[-1], self.since_holder[-1]):
            counts[tag] = counts.get(tag, 0) + 1
        if tag in BLOCK:
            self.since_block.append({})
        if tag in HOLDERS:
            self.since_holder.append({})

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.links -= tag == "a"
        if tag in BLOCK:
            self.since_block.pop()
        if tag in HOLDERS:
            self.since_holder.pop()
        for counts in (self.all, self.since_block[-1], self.since_holder[-1]):
            counts[tag] -= 1
        return tag

    def has(self, tag: str) -> bool:
        """Whether an end tag has an element to end; those that only format end none around their block."""
        return (self.since_block[-1] if tag in INLINE_FORMAT else self.all).get(tag, 0) > 0

    def end(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def make_room(self, tags: set[str]) -> None:
        """End what cannot be open around a new element, up to the holder."""
        while any(self.since_holder[-1].get(t) for t in tags):
            self.pop()


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """A page's elements, parents first, and its text blocks in order with the element that each is in.

    One pass over the page, in time that does not depend on how deep elements
    nest; an element left open ends with its parent, a page that breaks off
    ends there. Names set elements apart unless nothing would be left of the
    page.
    """
    root = Node("", "", False, False, None)
    nodes, blocks, buffer, opened = [root], [], [], Open(root)
    stack = opened.stack

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((stack[-1], text))

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            piece = page[at:lt]
            buffer.append(piece)
            if opened.links:
                stack[-1].links += len(piece)
            at = lt
            continue
        m = TOKEN.match(page, at)
        if m is None:  # a bare "<" is text
            buffer.append("<")
            at += 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            flush()
        if m[1]:
            if opened.has(tag):
                opened.end(tag)
            continue
        ends = CLOSES.get(tag) or ({"p"} if tag in P_ENDS else None)
        if ends:
            opened.make_room(ends)
        if tag in RAW:
            end = ENDS[tag].search(page, at)
            gt = page.find(">", end.start()) if end else -1
            at = size if gt < 0 else gt + 1
            continue
        if tag in VOID:
            continue
        name, apart, named = _attributes(m[3]) if m[3].strip(" /") else ("", False, False)
        parent = stack[-1]
        path = step(parent.path, tag, name) if tag in BLOCK else parent.path
        node = Node(tag, path, parent.apart or apart or tag in APART, parent.named or named, parent)
        opened.push(node)
        nodes.append(node)
    flush()
    if any(not (n.apart or n.named) for n, _ in blocks):
        for n in nodes:
            n.apart = n.apart or n.named
    return nodes, blocks


def scores(nodes: list[Node], blocks: list[tuple[Node, str]]) -> dict[str, float]:
    """For each container path of a page, how much it looks like the main text.

    A block gives its characters, less those in links, to its container and,
    fading, to the containers around it; what is set apart gives nothing.
    """
    links: dict[Node, int] = {}  # characters in links from an element up to its container
    for n in nodes:
        links[n] = 0 if n.tag in CONTAINERS else n.links + links[n.parent]
    value = dict.fromkeys(nodes, 0.0)
    reached = {n for n, _ in blocks if not n.apart}
    for node, text in blocks:
        if not node.apart:
            value[node] += max(0.0, len(text) + 25 * text.count(", ") + 50 * (node.tag == "p") - links[node])
    out: dict[str, float] = {}
    for n in reversed(nodes):  # children before parents
        if n not in reached:
            continue
        up = value[n]
        if n.tag in CONTAINERS:
            out[n.path] = out.get(n.path, 0.0) + up * (1.25 if n.tag in ("article", "main") else 1.0)
            up *= 0.8
        if n.parent is not None:
            value[n.parent] += up
            reached.add(n.parent)
    return out


def own_paths(blocks: list[tuple[Node, str]]) -> set[str]:
    """The paths of a page's containers that hold main text."""
    out, seen = set(), set()
    for n, _ in blocks:
        while n is not None and not n.apart and n not in seen:
            seen.add(n)
            if n.tag in CONTAINERS:
                out.add(n.path)
            n = n.parent
    return out


def extract(page: str, ranks: dict[str, tuple]) -> str:
    """The blocks at or below that path of the page with main text that comes first in ``ranks``, else below its own best container."""
    nodes, blocks = parse(page)
    path = min((p for p in own_paths(blocks) if p in ranks), key=ranks.__getitem__, default=None)
    if path is None:
        found = scores(nodes, blocks)
        if not found:
            return ""
        path = min(found, key=lambda p: (-found[p], p))
    below: set[Node] = set()
    for n in nodes:
        if n.path == path or n.parent in below:
            below.add(n)
    return " ".join(t for n, t in blocks if not n.apart and n in below)


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """``(host, path, votes)``: every page with a container votes for its best."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                hosts, paths = [], []
                for h, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = {p: v for p, v in scores(*parse(page or "")).items() if p and v > 0}
                    if found:
                        hosts.append(h), paths.append(min(found, key=lambda p: (-found[p], p)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"]
                )

    rows = pages.select(host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("votes"))


def _agreed(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``(host, page, path)``: of a page's containers, the one with the most votes of its host, ties by path; ``page`` is a digest."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                at, paths = [], []
                for k, page in enumerate(part.column(2).to_pylist()):
                    own = own_paths(parse(page or "")[1])
                    at += [k] * len(own)
                    paths += own
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(paths, pa.string())], names=["host", "page", "path"])

    own = rows.select("host", "page", "html").mapInArrow(run, "host string, page string, path string")
    best = own.join(counted, ["host", "path"]).groupBy("host", "page").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("best"))
    return best.select("host", "page", F.col("best.path").alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    A null html is empty and gives an empty text; a null url belongs to the
    host without a name; null ids stay; repeated rows repeat; pages are read
    whole; other columns are not read; no rows give none. All paths with votes
    count; they are sent to executors only if they are few, else the pages'
    containers are joined with them.
    """
    with Scratch(pages.sparkSession) as scratch:
        counted = scratch.result(votes(pages))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host(F.col("url").cast("string")).alias("host"),
    )
    ranks: dict[str, dict[str, tuple]] = {}
    if counted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        for r in counted.toLocalIterator():
            ranks.setdefault(r["host"], {})[r["path"]] = (-r["votes"], r["path"])
        rows = rows.withColumn("path", F.lit(None).cast("string"))
    else:
        rows = rows.withColumn("page", F.sha2(F.coalesce("html", F.lit("")), 256))
        rows = rows.join(_agreed(rows, counted), ["host", "page"], "left")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                texts = [extract(page or "", {p: ()} if p is not None else ranks.get(h, {})) for page, h, p in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.select("page_id", "url", "html", "host", "path").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
