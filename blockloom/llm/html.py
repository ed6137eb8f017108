"""HTML extraction with site template removal (operator 5).

Each page's elements are hashed as subtrees, in two ways: with their words
(name, text and what is inside), and by shape (names, classes and the shapes
inside, runs of equal ones as one; no words) together with the place in the
page. Spark counts in how many pages of a host, and of each directory of its
paths, each hash occurs. What occurs in MOST_SHARE of the pages of a host or
directory, and in LEAST_PAGES at least, is its template:

- subtrees with the same words are deleted wherever they stand;
- of shapes, the words may differ from page to page, as in menus and adverts.
  The container that has most of the running text (not of links), once a page,
  over all pages of the host, is its content; containers of recurring shape
  beside it are deleted. ``article`` and ``main`` elements, and what holds them,
  are never deleted by shape.

Hosts with few pages have no such template, and inside the content shapes say
nothing. There, elements and classes are named: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments go. Text
blocks (paragraphs, headings and the like) inside an ``article`` or ``main``
element are the page's own, whether or not they recur. A page with an article
gives the articles' text; one without, what is left of its body.

Defined cases: null or empty html gives an empty text; a null url belongs to
the host ''; a repeated row counts as another page; unclosed and stray tags
are read leniently, as browsers do, in time linear in the page, however deep
it is nested; empty tables give no rows; whole pages are read, whatever their
length. Other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import BROADCAST_ROWS, mapped, stage
from blockloom.llm.urls import host_of, path_of

LEAST_PAGES, MOST_SHARE = 5, 0.3
#: The content has this share of the running text, and occurs so often in a page at most, on average.
CONTENT_SHARE, ONCE = 0.5, 1.2
#: Counts that a task holds before it gives them on.
HELD = 50_000
#: Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg"}
GONE = {*RAW, "head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "object", "canvas", "audio", "video", "math", "input", "label", "fieldset"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
MAINS, PARAGRAPH = {"article", "main"}, {"p"}
AROUND_P = {"td", "th", "li", "div", "article", "section", "main", "body", "blockquote", "button", "object"}
#: Elements that hold the whole page or its article.
WHOLE = {"#root", "html", "body", "article", "main", "head"}
OWN = set("p h1 h2 h3 h4 h5 h6 pre blockquote li ul ol dl dt dd table thead tbody tr td th figure figcaption".split())
ENDS_P = BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "legend"}
#: An element of these names ends an open one of those names, up to the nearest of the third.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
CLASSES = set("ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies consent notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus share sharing social related newsletter subscribe subscription popup modal toolbar pagination masthead topbar skip".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=(?!\s*[\"']))*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[^A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element; ``hashed`` sets what is not set here."""

    __slots__ = ("gone", "hash", "holds", "inside", "kids", "label", "name", "order", "path", "shape", "size", "slot")

    def __init__(self, name: str, gone: bool, inside: bool, label: str):
        self.name, self.gone, self.inside, self.label, self.kids = name, gone, inside, label, []


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in GONE or (name == "header" and not inside):
        return True
    if attributes.strip(" /"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in ROLES) or (key == "style" and _HIDDEN.search(value)):
                return name not in ("html", "body", "article", "main")
            if key in ("class", "id") and name not in ("html", "body", "main") and not CLASSES.isdisjoint(w for part in value.split() for w in _PARTS.split(part.lower())):
                return True
    return False


def _label(name: str, attributes: str) -> str:
    """The name with its classes, id and role, numbers aside."""
    if not attributes or "=" not in attributes:
        return name
    return _labelled(name, attributes) if len(attributes) < 200 else _labelled.__wrapped__(name, attributes)


@lru_cache(8192)
def _labelled(name: str, attributes: str) -> str:
    words = sorted({w for key, *values in _ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id", "role") for v in values for w in _PARTS.split(v.lower()) if w})
    return " ".join((name, *words))


def parse(text: str, names: bool = True) -> Node:
    """A page as a tree; texts are kept as they stand. names: unwanted elements and classes are marked."""
    root = Node("#root", False, False, "#root")
    stack, at, n, opened = [root], 0, len(text), defaultdict(int)
    order, search = [root], _TAG.search
    root.order = order
    last = text.rfind(">")  # beyond it there are no tags

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x.name] -= 1
        del stack[k:]

    def close(names: set[str], until: set[str]) -> None:
        for x in names:
            if opened[x]:
                break
        else:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                cut(k)
                return
            if stack[k].name in until:
                return

    while at < n:
        m = search(text, at) if at <= last or "<!" in text[at:] else None
        if not m:
            stack[-1].kids.append(text[at:])
            break
        start, end = m.span()
        if start > at:
            stack[-1].kids.append(text[at:start])
        at = end
        slash, name, attributes = m.groups()
        if not name:
            continue
        name = name.lower()
        if slash:
            if opened[name]:
                close({name}, set() if name in BLOCKS else BLOCKS)
            continue
        if opened["p"] and name in ENDS_P:
            close(PARAGRAPH, AROUND_P)
        if name in SIBLINGS:
            close(*SIBLINGS[name])
        up = stack[-1]
        if not names:
            gone = name in RAW or name == "head"
        elif attributes:
            gone = _unwanted(name, attributes, up.inside)
        else:
            gone = name in GONE or (name == "header" and not up.inside)
        node = Node(name, gone, up.inside or name in MAINS, _label(name, attributes) if attributes else name)
        up.kids.append(node)
        order.append(node)
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
            node.kids.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[name] += 1
    return root


def plain(text: str) -> str:
    return " ".join(html.unescape(text).split()) if "&" in text else " ".join(text.split())


def _order(root: Node) -> list[Node]:
    """All elements under one, outer ones first."""
    out, todo = [], [root]
    while todo:
        out.append(x := todo.pop())
        todo.extend(k for k in reversed(x.kids) if not isinstance(k, str))
    return out


@lru_cache(65_536)
def _named(label: str) -> int:
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "replace"))


def hashed(root: Node) -> list[Node]:
    """All elements, outer ones first, with hashes of words, shape, path and slot (of tuples of numbers, which Python hashes alike everywhere), and the running text that each holds."""
    order = root.order
    root.path = 1
    for x in order:
        path = x.path
        for k in x.kids:
            if type(k) is not str:
                k.path = hash((path, _named(k.label)))
    for x in reversed(order):
        words, shapes, size, holds = [_named(x.name)], [_named(x.label)], 0, x.name in ("article", "main")
        for k in x.kids:
            if type(k) is str:
                if text := plain(k):
                    words.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")))
                    size += len(text)
            else:
                words.append(k.hash)
                size += k.size
                holds = holds or k.holds
                if k.shape != shapes[-1]:
                    shapes.append(k.shape)
        x.size, x.holds = 0 if x.gone or x.name == "a" else size, holds
        x.hash, x.shape = hash(tuple(words)), hash(tuple(shapes))
        x.slot = hash((x.path, x.shape))
    return order


def _container(x: Node) -> bool:
    return x.name in BLOCKS and x.name not in OWN


def _same_words(x: Node) -> bool:
    """Whether an element may be deleted for its words."""
    return x.name not in WHOLE and x.name in BLOCKS and bool(x.kids) and not (x.inside and x.name in OWN)


def _same_shape(x: Node) -> bool:
    """Whether an element may be deleted for its shape."""
    return x.name not in WHOLE and _container(x) and bool(x.kids) and not x.inside and not x.holds


def evidence(root: Node) -> list[tuple[int, int, float, int, int]]:
    """Per hash: kind (0 words, 1 slot, 2 path of a container), hash, share of the page's running text, how often, depth."""
    order = hashed(root)
    depth, total = {id(root): 0}, max(root.size, 1)
    out: dict[tuple[int, int], list] = {}
    for x in order:
        below = depth[id(x)] + 1
        for k in x.kids:
            if type(k) is not str:
                depth[id(k)] = below
        if x.name not in BLOCKS:
            continue
        kinds = [(0, x.hash)] if _same_words(x) else []
        if _same_shape(x):
            kinds.append((1, x.slot))
        if _container(x) and x.size:
            kinds.append((2, x.path))
        for key in kinds:
            row = out.setdefault(key, [0.0, 0, below - 1])
            row[0] += x.size / total
            row[1] += 1
    return [(kind, signed(h), share, times, at) for (kind, h), (share, times, at) in out.items()]


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _by_shape(order: list[Node], template: set[int]) -> None:
    """Deletes containers of a recurring shape beside the content, if the page has the host's content."""
    content = [x for x in order if _container(x) and signed(x.path) in template]
    if not content:
        return
    keep, above = {id(y) for x in content for y in _order(x)}, {id(x) for x in content}
    for x in reversed(order):  # what holds the content stays too
        if any(id(k) in above for k in x.kids):
            above.add(id(x))
            x.holds = True
    for x in order:
        if id(x) not in keep and not x.holds and _same_shape(x) and signed(x.slot) in template:
            x.gone = True


def extract(root: Node, template: set[int]) -> str:
    """The text of the blocks that are left."""
    if template:
        order = hashed(root)
        for x in order:
            x.gone |= _same_words(x) and signed(x.hash) in template
        _by_shape(order, template)
    mains: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        x = todo.pop()
        if x.name in MAINS:
            mains[x.name].append(x)
        if x.name != "article":
            todo.extend(k for k in reversed(x.kids) if not isinstance(k, str) and not k.gone)
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                blocks.append(text)
            parts.clear()

    for top in mains["article"] or mains["main"] or [root]:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                parts.append(html.unescape(x) if "&" in x else x)
            elif (x.gone and x is not top) or x.name == "br":
                parts.append(" ")
            else:
                if x is top or x.name in BLOCKS:
                    end()
                    todo.append(None)
                todo.extend(reversed(x.kids))
    return "\n".join(blocks)


def places(host: str, path: str) -> list[int]:
    """The host, then each directory of the path, hashed."""
    h = xxhash.xxh3_64(host.encode("utf-8", "replace"))
    out = [signed(h.intdigest())]
    for part in path.split("/")[1:-1]:
        h.update(b"/" + part.encode("utf-8", "replace"))
        out.append(signed(h.intdigest()))
    return out


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and sums of a task's pages; given on when there are many, and at the end."""
    columns = ["host", "place", "top", "kind", "hash", "n", "share", "times", "depth"]
    sums: dict[tuple, list] = {}

    def full() -> pd.DataFrame:
        out = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=columns)
        sums.clear()
        return out

    for batch in batches:
        for host, path, page in zip(batch["host"], batch["path"], batch["html"], strict=True):
            found = evidence(parse(page))
            for k, place in enumerate(places(host, path)):
                for kind, h, share, times, depth in found:
                    row = sums.get(key := (host, place, not k, kind, h))
                    if row is None:
                        sums[key] = [1, share, times, depth]
                    else:
                        row[0] += 1
                        row[1] += share
                        row[2] += times
                        row[3] = min(row[3], depth)
        if len(sums) >= HELD:
            yield full()
    if sums:
        yield full()


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(leaf, place, not k) for leaf, host, path in zip(batch["leaf"], batch["host"], batch["path"], strict=True) for k, place in enumerate(places(host, path))]
        yield pd.DataFrame(rows, columns=["leaf", "place", "top"])


def _located(pages: DataFrame, *columns: str) -> DataFrame:
    """host, path, leaf (the host and the path's innermost directory) and html beside the columns."""
    x = pages.select(*columns, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    return x.withColumn("leaf", F.concat("host", F.regexp_extract("path", "(?s)^(.*)/", 1)))


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per host the hashes of its template's subtrees, and per leaf those of its directories besides; their number is bounded by what a page has, over MOST_SHARE, for each host or directory."""
    x = _located(pages)
    placed = x.select("leaf", "host", "path").transform(mapped, _placed, "leaf string, place long, top boolean")
    sizes = placed.groupBy("place").agg(F.count("*").alias("pages"))
    schema = "host string, place long, top boolean, kind int, hash long, n long, share double, times long, depth int"
    found = x.select("host", "path", "html").transform(mapped, _evidence, schema, 200).groupBy("host", "place", "top", "kind", "hash")
    found = found.agg(F.sum("n").alias("n"), F.round(F.sum("share") / F.sum("n"), 6).alias("share"), (F.sum("times") / F.sum("n")).alias("times"), F.min("depth").alias("depth")).where(F.col("n") >= LEAST_PAGES)
    found = found.join(sizes, "place").where(F.col("n") >= MOST_SHARE * F.col("pages"))
    # of the containers that have most of the text, the innermost is the content of its host or directory
    content = found.where((F.col("kind") == 2) & (F.col("share") >= CONTENT_SHARE) & (F.col("times") <= ONCE)).groupBy("host", "place", "top").agg(F.max_by("hash", F.struct("depth", "share", "hash")).alias("hash"))
    found = stage(found.where("kind < 2").select("host", "place", "top", "hash").unionByName(content), "templates")
    whole = found.where("top")
    parts = found.where("not top").join(whole.select("host", "hash"), ["host", "hash"], "left_anti").groupBy("place").agg(F.collect_list("hash").alias("part"))
    leaves = placed.where("not top").select("leaf", "place").distinct().join(parts, "place").groupBy("leaf").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("part")))).alias("more"))
    return whole.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template")), leaves


def _with(rows: DataFrame, hashes: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the hashes of their key; broadcast only up to BROADCAST_ROWS."""
    few = hashes.select(F.coalesce(F.sum(F.size(name) + 4), F.lit(0))).first()[0] <= BROADCAST_ROWS
    return rows.join(F.broadcast(hashes) if few else hashes, key, "left")


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    whole, leaves = (stage(x, "templates") for x in templates(pages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(parse(page), {h for t in both if t is not None for h in t}) for page, *both in zip(batch["html"], batch["template"], batch["more"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = _located(pages, "page_id", "url")
    rows = _with(_with(rows, whole, "host", "template"), leaves, "leaf", "more").select("page_id", "url", "html", "template", "more")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.transform(mapped, run, f"page_id {kind}, url string, text string, n_chars long", 200)
