"""HTML extraction with site style trees.

The DOMs of one host are merged into a tree whose nodes are paths of elements (tag, id and classes). A node has two
entropies over the pages that have it: of its contents (do pages say different things there?) and of its presentation
(do pages lay different children out there?). Their weighted sum, between 0 and 1, is the node's importance; a node that
says the same on every page is boilerplate and its branch goes. Branches that say themselves what they are (menus,
headers, footers, forms, hidden parts, by element, role or attribute) never enter the tree. Where a page marks its article (and not just teasers: a third of the text at least), a node outside is doubted:
its importance is worth ``PRIOR`` of one inside, and without evidence it goes. So is a branch whose id or class is a name
of noise (adverts, comments and the like; not headings, nor inline elements in an article), unless such branches hold most
of the text; a node doubted twice goes. Importance needs evidence: nodes that fewer than
``MIN_PAGES`` pages of the host have are kept. Copies are no evidence: of pages with the same content a host counts one.
A node that holds most of a page's text stays on that page.

Pages are parsed once, into blocks of text with their nodes, and written to the shared folder. The tree's counts are
plain partial aggregates, so a host with a third of all pages is never in one task; nodes to remove are joined back per
host.

Null and empty html give an empty text; pages without a host are extracted without a tree; pages of any length and depth,
with unclosed or unmatched tags, are parsed in time linear in their length; repeated rows are extracted each by itself and
count once in the tree; null ids and urls stay null; an empty table gives an empty result; columns other than page_id, url and
html, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, require

MIN_PAGES, LEAST_IMPORTANCE, CONTENT_WEIGHT = 8, 0.2, 0.9
#: What the importance of a doubted node is worth.
PRIOR = 0.4
#: The node of blocks that no tree removes.
KEPT = -1
#: Hosts with nodes to remove are broadcast up to so many; beyond, they are joined by shuffle.
BROADCAST_HOSTS = 20_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S | re.I)
#: Elements without markup inside: all up to their end tag, or to the end of the page, is theirs. Embedded ones have
#: markup; where no end tag follows, their start tag stands alone.
RAW, EMBEDDED = "script style textarea title iframe xmp noembed noframes".split(), "svg math object template noscript".split()
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW + EMBEDDED}
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center hr fieldset header footer nav aside form hgroup".split())
FOREIGN = frozenset(("svg", "math"))
NOISE_TAGS = frozenset("head nav footer aside form button select option input label dialog menu canvas audio video map frameset marquee svg math object template noscript".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist note".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu submenu sidebar sidebars "
    "breadcrumb breadcrumbs footer masthead topbar comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination pager login search skip".split()
)
#: Words that make no name of noise by themselves, nor keep one from being it.
PLACES = frozenset("site page global main top bottom left right box bar block container wrapper wrap list links link area section panel item items slot inner outer body form button buttons icon icons header".split())
_NEVER_NAMED = frozenset("html body main article h1 h2 h3 h4 h5 h6 hgroup".split())
#: An open element that a start tag of the key closes, up to an element of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Start tags that end an open drawing or formula, unless inside an element of the second set.
_ENDS_FOREIGN = (BLOCKS - {"caption", "form", "summary", "details", "tr", "td", "th", "thead", "tbody", "tfoot"}) | frozenset("b big br code em embed i img s small span strong sub sup u".split())
_HTML_IN_FOREIGN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
_ENDS_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}


@dataclass(slots=True)
class Element:
    tag: str
    node: int
    noise: bool
    region: bool
    named: bool
    block: bool
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    """Blocks (node, inside the marked article?, named as noise?, text) in page order, per node its children's tags, and
    whether an article is marked, if only an empty one."""

    marked: bool = False
    blocks: list[tuple[int, bool, bool, str]] = field(default_factory=list)
    styles: dict[int, list[str]] = field(default_factory=dict)


_NODES: dict[tuple[int, str], int] = {}


def _node(parent: int, signature: str) -> int:
    key = (parent, signature)
    found = _NODES.get(key)
    if found is None:
        if len(_NODES) > 100_000:
            _NODES.clear()
        found = _NODES[key] = xxhash.xxh3_64_intdigest(f"{parent}>{signature}") >> 1
    return found


def _named(names: str, in_article: bool) -> bool:
    """Is an id or class as a whole the name of noise, or made of such names and of words for places?"""
    for name in names.split():
        parts = {p for p in _NAME_PARTS.split(name) if p and not p.isdigit()}
        own = parts - PLACES
        if (own or (not in_article and "header" in parts)) and own <= NOISE_NAMES:
            return True
    return False


def _look(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """(signature, noise, named as noise) of a start tag."""
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return tag, True, False
    if not attributes or attributes.isspace():
        return tag, False, False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    noise = "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in NOISE_ROLES or bool(_HIDDEN.search(found.get("style", "")))
    names = f"{found.get('id', '')} {found.get('class', '')}"
    named = not noise and tag not in _NEVER_NAMED and (tag in BLOCKS or not in_article) and _named(names, in_article)
    return f"{tag}#{' '.join(sorted(names.split()))}", noise, named


def parse(text: str) -> Page:
    page = Page()
    stack = [Element("", 0, False, False, False, True)]
    parts: list[str] = []
    owner = stack[0]
    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
    open_blocks = [owner]

    def flush() -> None:
        if parts:
            own = " ".join("".join(parts).split())
            if own:
                page.blocks.append((owner.node, owner.region, owner.named, own))
            parts.clear()

    def close(count: int) -> None:
        nonlocal owner
        for _ in range(count):
            top = stack.pop()
            places[top.tag].pop()
            if top.block:
                open_blocks.pop()
                flush()
                if not top.noise:
                    page.styles.setdefault(top.node, []).extend(top.children)
        owner = open_blocks[-1]

    def open_depth(tags, limits=frozenset()) -> int | None:
        """How many elements to close, so that the innermost of ``tags`` closes."""
        innermost = lambda some: max((places[t][-1] for t in some if places[t]), default=0)
        found = innermost(tags)
        return len(stack) - found if found and found >= innermost(limits) else None

    ends: dict[str, tuple[int, int] | None] = {}

    def end_of(tag: str) -> tuple[int, int] | None:
        """Start and end of the next end tag; each is looked for once."""
        if tag not in ends or (ends[tag] and ends[tag][0] < at):
            found = _ENDS[tag].search(text, at)
            ends[tag] = found and found.span()
        return ends[tag]

    def foreign() -> bool:
        return stack[-1].noise and any(places[t] for t in FOREIGN)

    def write(segment: str) -> None:
        if segment and not stack[-1].noise:
            parts.append(entities.unescape(segment) if "&" in segment else segment)

    at = 0
    while m := _TOKEN.search(text, at):
        if m.start() > at:
            write(text[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:  # an end tag
            depth = open_depth({tag})
            if depth:
                close(depth)
            elif tag in BLOCKS:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if attributes.endswith("/") and (tag in FOREIGN or foreign()):
            continue
        if tag in _ENDS:
            end = end_of(tag)
            if tag in RAW:
                at = end[1] if end else len(text)
            if tag in RAW or not end:
                continue
        if tag in _ENDS_FOREIGN and stack[-1].noise:
            depth = open_depth(FOREIGN, _HTML_IN_FOREIGN)
            if depth:
                close(depth)
        if tag == "br":
            write(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if tag in _CLOSES:
            depth = open_depth(*_CLOSES[tag])
            if depth:
                close(depth)
        if tag in _ENDS_PARAGRAPH:
            depth = open_depth({"p"}, {"article", "section", "div", "td", "th", "li", "body", "blockquote", "table", "button", *EMBEDDED})
            if depth:
                close(depth)
        if tag in VOID:
            continue
        parent = stack[-1]
        if parent.noise:
            element = Element(tag, 0, True, False, False, block)
        else:
            signature, noise, named = _look(tag, attributes, parent.region)
            if named and not block:  # an inline element of its own importance
                block = True
                flush()
            if block:
                owner.children.append(tag)
            named = named or parent.named
            marks = tag in ("article", "main") and not named
            page.marked = page.marked or marks
            element = Element(tag, _node(parent.node, signature) if block else parent.node, noise, parent.region or marks, named, block)
        places[tag].append(len(stack))
        stack.append(element)
        if block:
            owner = element
            open_blocks.append(element)
    write(text[at:])
    flush()
    close(len(stack) - 1)
    return page


def weighed(page: Page) -> list[tuple[int, int, str]]:
    """Blocks (node, doubts, text). The mark of an article is believed if it holds a third of the text that isn't named
    as noise; names are believed if they leave half of the text; next to an empty article they decide alone."""
    inside = sum(len(t) for _, region, _, t in page.blocks if region)
    outside = sum(len(t) for _, region, named, t in page.blocks if not region and not named)
    article = inside > 0 and 2 * inside >= outside
    scope = [(named, len(t)) for _, region, named, t in page.blocks if region or not article]
    names = 2 * sum(n for named, n in scope if named) <= sum(n for _, n in scope)
    empty = page.marked and not inside
    return [(n, 2 if named and empty else (article and not region) + (named and (names or (article and not region))), t) for n, region, named, t in page.blocks]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, hash of the undoubted content, blocks, and the nodes' features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: xxhash.xxh3_64_intdigest(x) >> 1
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                wholes, blocks, features = [], [], []
                for text in batch.column(3).to_pylist():
                    page = parse(text) if text else Page()
                    chosen = weighed(page)
                    contents: dict[int, list[str]] = {}
                    for n, _, t in chosen:
                        contents.setdefault(n, []).append(t)
                    held: dict[int, int] = {}
                    for n, doubts, t in chosen:
                        held[n] = held.get(n, 0) + (len(t) if doubts < 2 else 0)
                    most = sum(held.values()) / 2
                    doubted = {n for n, doubts, _ in chosen if doubts == 1}
                    wholes.append(digest("\n".join([t for _, doubts, t in chosen if not doubts] or [t for *_, t in chosen])))
                    blocks.append([{"node": KEPT if held[n] > most else n, "doubted": doubts > 0, "text": t} for n, doubts, t in chosen if doubts < 2])
                    features.append([{"node": n, "content": digest("\n".join(ts)), "style": digest(" ".join(page.styles.get(n, ()))), "doubted": n in doubted} for n, ts in contents.items()])
                types = [pa.list_(pa.struct([("node", pa.int64()), ("doubted", pa.bool_()), ("text", pa.string())])), pa.list_(pa.struct([("node", pa.int64()), ("content", pa.int64()), ("style", pa.int64()), ("doubted", pa.bool_())]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(wholes, pa.int64()), pa.array(blocks, types[0]), pa.array(features, types[1])], ["page_id", "url", "host", "whole", "blocks", "features"])

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1))
    return pages.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), "html").mapInArrow(
        run, f"page_id {dict(pages.dtypes)['page_id']}, url string, host string, whole bigint, blocks array<struct<node: bigint, doubted: boolean, text: string>>, features array<struct<node: bigint, content: bigint, style: bigint, doubted: boolean>>"
    )


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance, doubted on some page?) of the merged trees, from :func:`parsed` pages."""
    found = pages.where("host <> ''").select("host", "whole", F.explode("features").alias("f")).select("host", "whole", "f.*")
    once = found.groupBy("host", "whole", "node", "content", "style").agg(F.max("doubted").alias("doubted"))
    features = once.select("host", "node", "doubted", F.explode(F.array(F.struct(F.lit("content").alias("kind"), F.col("content").alias("value")), F.struct(F.lit("style").alias("kind"), F.col("style").alias("value")))).alias("x"))
    counted = features.groupBy("host", "node", "x.kind", "x.value").agg(F.count("*").alias("n"), F.max("doubted").alias("doubted"))
    m, s = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    entropy = F.when(m > 1, (F.log(m) - s / m) / F.log(m)).otherwise(1.0)
    weight = F.when(F.col("kind") == "content", CONTENT_WEIGHT).otherwise(1 - CONTENT_WEIGHT)
    kinds = counted.groupBy("host", "node", "kind").agg(m.alias("pages"), entropy.alias("entropy"), F.max("doubted").alias("doubted"))
    return kinds.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.sum(weight * F.col("entropy")).alias("importance"), F.max("doubted").alias("doubted"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    require(pages, "page_id", "url", "html")
    trees = materialise(parsed(pages), "pages")
    low, high = F.col("importance") < LEAST_IMPORTANCE, F.col("doubted") & (PRIOR * F.col("importance") >= LEAST_IMPORTANCE)
    known = importance(trees).where((F.col("pages") >= MIN_PAGES) & (low | high))
    removed = materialise(known.groupBy("host").agg(F.collect_set(F.when(low, F.col("node"))).alias("removed"), F.collect_set(F.when(high, F.col("node"))).alias("trusted")), "site-trees")
    if removed.count() <= BROADCAST_HOSTS:
        removed = F.broadcast(removed)
    held_in = lambda column, b: F.coalesce(F.array_contains(F.col(column), b["node"]), F.lit(False))
    kept = F.filter("blocks", lambda b: F.when(b["doubted"], (b["node"] == KEPT) | held_in("trusted", b)).otherwise(~held_in("removed", b)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return trees.select("page_id", "url", "host", "blocks").join(removed, "host", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
