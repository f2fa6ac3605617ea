"""Main text of web pages by consensus of each host's pages.

Every page is read into blocks of text and the containers around them. Containers are scored by the
running text they hold; each page votes for its containers' generalised paths (tags with classes,
digits dropped, positions dropped), votes are summed per host in Spark, and each page is read again
with its host's winning path. A page without that path falls back to its own best container. Text is
taken from the whole article around the container, so titles, leads and sections beside it stay.

Votes are whole numbers, so sums do not depend on the order of rows. A host's votes are aggregated
on the map side first; pages meet the winners by a broadcast only while the hosts are few.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .url_filter import host_path

T = TypeVar("T")

#: Hosts up to which the table of winners (two longs and a name each) is broadcast.
FEW_HOSTS = 50_000

RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center fieldset header footer nav aside form head dialog menu option optgroup hgroup search legend".split())
SKIP = frozenset("nav footer aside head dialog menu option optgroup search".split())
#: Elements inside a line whose content is no text of the article; the line goes on after them.
INLINE_SKIP = frozenset("svg object audio video canvas button select".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id values that mark what is not part of an article, those of reader comments apart.
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: Of these only what stands outside of article and main: a paper may have a section so named.
TALK = frozenset("discussion discussions feedback reactions responses conversation".split())
MARKS = COMMENTS | TALK | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations widget pagination pager toolbar skip paywall".split()
)
#: Words that may stand beside one of MARKS in a class or id (site-footer, comment-list); beside any other word it marks nothing (no-sidebar).
BESIDE = frozenset("site page main global primary secondary top bottom left right header wrap wrapper container box block bar area section panel column col list item items body inner outer content contents unit slot zone links link buttons post posts article articles story stories user reader the and form in to js mobile desktop".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
}

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Searched in the page itself: lower-casing it may change its length.
_INNER = HEADING | frozenset("p li dt dd td th tr tbody thead tfoot caption blockquote pre figcaption summary ul ol dl table hgroup header".split())
_RAW_END = {tag: re.compile(f"</{tag}(?![\\w-])", re.I | re.A) for tag in RAW | INLINE_SKIP}
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")


class Node:
    """An open element. mark is the nearest element around it, or itself, that its class, id or tag rules out unless it holds the article."""

    __slots__ = ("tag", "path", "parent", "skip", "article", "score", "mark", "comments", "held", "whole", "box", "kind", "title")

    def __init__(self, tag: str, path: int, parent: Node | None, skip: bool, article: bool, marked: bool = False, comments: bool = False, title: bool | None = None) -> None:
        self.tag, self.path, self.parent, self.skip, self.score = tag, path, parent, skip, 0
        self.mark, self.comments, self.held, self.whole = self if marked else parent.mark if parent else None, comments, 0, False
        #: The outermost article or main around it, and the nearest container around its paragraph.
        self.article: Node | None = (parent.article if parent else None) or (self if article else None)
        inner = parent is not None and tag in _INNER
        self.box: Node = parent.box if inner else self
        #: Whether headings (1) or paragraphs (2) lie between the box and here.
        self.kind: int = parent.kind | (1 if tag in HEADING else 2 if tag == "p" else 0) if inner else 0
        #: In the header of an article: whether it is part of a heading. Elsewhere None.
        self.title = title


def marks_of(names: str) -> set[str]:
    """MARKS in class or id values. A name counts whole: all its words are of MARKS or BESIDE."""
    out: set[str] = set()
    for name in names.split():
        words = {w.lower() for w in _NAME_WORD.findall(name)}
        if words <= MARKS | BESIDE:
            out |= words & MARKS
    return out


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(raw)} if raw.strip(" /\n\t") else {}


def _path(parent: int, key: str) -> int:
    """The generalised path as one number, so that deep nesting costs no long strings."""
    return int.from_bytes(hashlib.blake2b(parent.to_bytes(8, "big", signed=True) + key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """(innermost container, text, characters inside links) of every block of text that is not ruled out, in page order."""
    root = Node("", 0, None, False, False)
    top, out, text = root, [], []
    link = linked = 0
    last_end: dict[str, int] = {}
    nodes: list[Node] = []
    still_open: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked, link
        if text:
            joined = " ".join("".join(text).split())
            if joined and not top.skip and top.title is not False:
                out.append((top, joined, min(linked, len(joined))))
            text.clear()
        linked = link = 0

    def ends_later(tag: str, at: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in _RAW_END[tag].finditer(page)), default=-1)
        return at <= last_end[tag]

    at = 0
    while True:
        m = _TAG.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            text.append(html.unescape(chunk))
            linked += len(chunk) if link else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, raw = bool(m[1] or m[4]), m[3] or m[6] or ""
        empty = not closing and bool(_SELF_CLOSED.search(raw))
        if tag in RAW:
            if not closing and not (empty and tag.startswith("annotation")):
                end = _RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
        elif tag in INLINE_SKIP:
            if not closing and not empty and ends_later(tag, at):
                at = _RAW_END[tag].search(page, at).start()
        elif tag == "br":
            text.append(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            link = 0 if closing else 1
        elif tag in VOID or tag not in BLOCK:
            continue
        elif closing:
            if still_open.get(tag, 0):
                flush()
                while True:
                    shut, top = top.tag, top.parent
                    still_open[shut] -= 1
                    if shut == tag:
                        break
        else:
            flush()
            while top is not root and (top.tag == "p" or top.tag in HEADING and tag in HEADING or tag in ENDS.get(top.tag, ())):
                still_open[top.tag] -= 1
                top = top.parent
            if empty:
                continue
            got = _attributes(raw)
            names = got.get("class", "")
            body = tag in ("article", "main")
            role = got.get("role", "").lower()
            marks = marks_of(names + " " + got.get("id", ""))
            if top.article:
                marks -= TALK
            comments = bool(marks & (COMMENTS | TALK))
            if body and not top.article and not comments:
                mark = top.mark
                while mark is not None and not mark.whole:
                    mark.whole = True
                    mark = mark.parent.mark
            if tag in ("html", "body") or body and not top.article:
                marks, comments = set(), False
            skip = tag in SKIP or tag == "header" and not top.article or role in ROLES
            skip = skip or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
            key = f"{tag}.{'.'.join(sorted(re.sub('[0-9]+', '', c) for c in names.lower().split()))}" if names else tag
            title = (tag in HEADING or top.title is True) if tag == "header" or top.title is not None else None
            top = Node(tag, _path(top.path, key), top, top.skip or skip, body, bool(marks) or tag == "form" or role == "form", comments, title)
            nodes.append(top)
            still_open[tag] = still_open.get(tag, 0) + 1
    flush()
    return _unmarked(out, nodes)


def _unmarked(found: list[tuple[Node, str, int]], nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """Blocks outside of marked elements; nodes are in page order.

    A mark is void where its element holds most of the running text of the article around it, whatever its name. Outside of
    articles it has to hold most of the page's, and article or main too if an article with text stands outside of marks.
    One that marks reader comments always has to hold article or main.
    """
    total = 0
    own: dict[Node, int] = {}
    for node, text, linked in found:
        total += len(text) - linked
        own[node] = own.get(node, 0) + len(text) - linked
    inside: dict[Node, int] = {}
    for node in reversed(nodes):
        running = own.get(node, 0)
        if node.mark is node:
            node.held += running
            if node.parent.mark is not None:
                node.parent.mark.held += node.held
        elif node.mark is not None:
            node.mark.held += running
        if node.article is not None:
            inside[node.article] = inside.get(node.article, 0) + running
    plain = any(n and a.mark is None for a, n in inside.items())
    kept: dict[Node | None, bool] = {None: True}
    for node in nodes:
        if node.mark is node:
            around = node.parent.article
            most = node.held * 2 > (inside.get(around, 0) if around is not None else total)
            void = most and (node.whole or not node.comments and (around is not None or not plain))
            kept[node] = void and kept[node.parent.mark]
    return [b for b in found if kept[b[0].mark]]


def scored(found: list[tuple[Node, str, int]]) -> dict[int, int]:
    """Score of the best container of each generalised path.

    A block counts by its characters outside links, fully if it reads like a sentence or heading and a quarter otherwise;
    it counts for the innermost container around its paragraph, half for the next and a quarter for the one after.
    """
    best: dict[int, int] = {}
    for node, text, linked in found:
        size = (len(text) - linked) * (4 if linked * 2 <= len(text) else 1)
        holder: Node | None = node.box
        for i in range(3):
            if holder is None:
                break
            holder.score += size >> i
            best[holder.path] = max(best.get(holder.path, 0), holder.score)
            holder = holder.parent
    return best


def _known(node: Node | None, known: dict[Node | None, T], tell: Callable[[Node, T], T]) -> T:
    """tell(node, what holds for its parent), from known, to which all that is told on the way is added; each node is told once."""
    way = []
    while node not in known:
        way.append(node)
        node = node.parent
    got = known[node]
    for node in reversed(way):
        got = known[node] = tell(node, got)
    return got


def _inside(found: list[tuple[Node, str, int]], path: int) -> list[str]:
    """Blocks of the articles that containers of the path are part of.

    That is the outermost article or main around a container; without such, the outermost ancestor with headings or paragraphs
    of its own or with the container's section in it, and body only if it has both headings and paragraphs.
    """
    held: dict[Node, int] = {}
    for node, _, _ in found:
        held[node.box] = held.get(node.box, 0) | node.kind

    def above(node: Node, higher: Node | None) -> Node | None:
        holder = node.parent
        if higher is not None or holder is None:
            return higher
        own = held.get(holder, 0)
        fits = own == 3 if holder.tag in ("", "html", "body") else own or node.tag == "section"
        return holder if fits else None

    heads: dict[Node | None, Node | None] = {None: None}
    seen: set[Node | None] = {None}
    chosen: set[Node] = set()
    for node, _, _ in found:
        while node not in seen:
            seen.add(node)
            if node.path == path:
                chosen.add(node.article or _known(node, heads, above) or node)
            node = node.parent
    within: dict[Node | None, bool] = {None: False}
    return [t for n, t, _ in found if _known(n, within, lambda node, up: up or node in chosen)] if chosen else []


def main_text(page: str, path: int | None) -> str:
    """Blocks of the articles around containers of the given path; around the page's own best path if there is none such."""
    found = blocks(page)
    inside = _inside(found, path) if path is not None else []
    if not inside and found:
        best = scored(found)
        inside = _inside(found, max(best, key=lambda p: (best[p], p)))
    return "\n\n".join(inside)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, int], int] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            best = scored(blocks(page or ""))
            most = max(best.values(), default=0)
            for path, score in best.items():
                if most:
                    total[host, path] = total.get((host, path), 0) + score * 1000 // most
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], ["host", "path", "votes"])


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path): the container path with most votes of each host's pages; ties go to the larger number."""
    seen = pages.select(host_path(url)[0].alias("host"), F.col(page).cast("string").alias("html"))
    votes = seen.mapInArrow(_votes, "host string, path long, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(p or "", k) for p, k in zip(batch.column("__tf_html").to_pylist(), batch.column("__tf_path").to_pylist())]
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("__tf_html", "__tf_path")]
        size = pa.array(map(len, text), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(text, pa.string()), size], [*(batch.schema.names[i] for i in keep), "text", "n_chars"])


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of the page column; columns of these names are replaced.

    Null or empty pages, and pages without text, have text "" and n_chars 0. Pages whose url is null
    or has no :// form one host. Rows repeat and stay. No text of a chosen container is dropped or cut
    but what MARKS, ROLES, SKIP, INLINE_SKIP and RAW name, and forms.
    """
    best = materialize(host_paths(pages, url, page), "host-paths")
    own = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in own], F.col(page).cast("string").alias("__tf_html"), host_path(url)[0].alias("__tf_host"))
    best = best.select(F.col("host").alias("__tf_host"), F.col("path").alias("__tf_path"))
    few = best.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS
    joined = rows.join(F.broadcast(best) if few else best, "__tf_host", "left").drop("__tf_host")
    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in own)
    return joined.mapInArrow(_extract, fields + "text string, n_chars long")
