"""Main text of web pages by wrapper induction.

A page becomes a small tree: runs of siblings with the same tag and class fold into one node, so a tree's size follows a page's
layout and not its length. Pages of a host are aligned by simple tree matching (the maximum matching of ordered child lists by
dynamic programming) into a template tree that holds, for each node, the pages that have it, how many of different text are among
them (copies of a page are no evidence) and whether the node's text was ever another one. Tasks build a template per host from the pages they read; templates of a host are merged by the same matching, in
rounds over salted groups, so neither a task nor a group grows with a host. A partial template covers WINDOW pages at most and is thinned
once, when it is handed on, and so is each merge of FAN_IN of them: nodes on fewer than 1 in RARE of its pages go, so odd class names do not add
up. Such a thinning costs a node less than 1 in RARE of its host's pages, so one on a larger share than the rounds' number in RARE stays in its
template in whatever order the pages come. Template nodes whose text never varies over
enough pages are boilerplate; nodes that vary are slots. The content region of a host is its slots, wherever they stand: of a page the
text of all nodes goes out but for boilerplate nodes (inside an article or main node too) and for navigation, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles (by tag, role, class or id). A host with fewer than CONSTANT_PAGES
different pages has no evidence for that; there the page's own article or main nodes are the region, else the body.

Templates are sent to all tasks while they are below BROADCAST_BYTES, else joined by host.

Defined results: null or empty html, and a page without text, give an empty text; a null url belongs to a host of its own; a host with
few pages has no boilerplate by template, only by name; broken markup is read as browsers do in the main (unclosed and stray tags,
references without a semicolon, quotes outside a value); nodes nested deeper than DEPTH are read in place, flat; repeated pages are read alike
and count once as evidence; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import html as markup
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BROADCAST_BYTES = 64 << 20
#: Templates merged in one group, and pages of different text that a text must stand on unchanged to be boilerplate.
FAN_IN = 32
CONSTANT_PAGES = 5
#: A template's nodes stand on one of so many of its pages at least.
RARE = 256
#: Pages of a host that one partial template covers.
WINDOW = 4 * RARE
#: Nodes of pages whose templates a task holds before it hands them on.
HELD_NODES = 300_000
#: Levels of a tree; matching takes several calls a level.
DEPTH = 512

# HTML's elements by kind, and names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template iframe nav header footer aside form button select option input textarea svg math canvas object embed audio video dialog menu title noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FURNITURE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|footer|foot|sidebar|side|aside|widget|related|share|sharing|social|"
    r"comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notice|notices|newsletter|subscribe|signup|login|popup|modal|overlay|toolbar|pagination|pager|skip)(?:$|[-_\s\d])",
    re.I,
)
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
_scan = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|[^>])*+)(?:>|$)", re.S)
_attr = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")


class Node:
    __slots__ = ("tag", "name", "kids", "furniture", "named")

    def __init__(self, tag: str, name: str = "", furniture: bool = False, named: bool = False) -> None:
        self.tag, self.name, self.kids, self.furniture, self.named = tag, name, [], furniture or named, named and not furniture


def parse(page: str | None) -> Node:
    """The page's tree; kids are nodes and strings (references decoded)."""
    root = Node("#root")
    stack, page, at = [root], page or "", 0
    low = None
    while at < len(page):
        m = _scan.search(page, at)
        if m is None:
            stack[-1].kids.append(markup.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(markup.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(n.tag == tag for n in stack[1:]):
                while True:
                    gone = stack.pop()
                    if gone.kids is stack[-1].kids:
                        gone.kids.append(Node("br"))
                    if gone.tag == tag:
                        break
            continue
        attrs = {k.lower(): v.strip("\"'") for k, v in _attr.findall(m[3])} if m[3] else {}
        while len(stack) > 1:
            open_p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag not in INLINE), 0)
            if open_p and tag in CLOSED_BY.get(stack[open_p].tag, ()):
                if stack[open_p].kids is stack[open_p - 1].kids:
                    stack[open_p].kids.append(Node("br"))
                del stack[open_p:]
            else:
                break
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None
        named = tag not in ("body", "html", "article", "main") and FURNITURE.search(names) is not None
        node = Node(tag, attrs.get("class", ""), tag in DROPPED or hidden or attrs.get("role", "").lower() in ROLES, named)
        if tag in ("article", "main", "h1"):  # a wrapper of these is not furniture, whatever its name says
            for n in stack:
                if n.named:
                    n.furniture = n.named = False
        if len(stack) >= DEPTH and tag not in VOID and tag not in RAW and not node.furniture:  # its text goes to the node above
            stack[-1].kids.append(Node("br"))
            node.kids = stack[-1].kids
            stack.append(node)
            continue
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            low = low or page.lower()
            end = low.find(f"</{tag}", at)
            end = len(page) if end < 0 else end
            node.kids.append(page[at:end])
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            continue
        stack.append(node)
    return root


def text_of(node: Node) -> str:
    out: list[str] = []

    def walk(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, str):
                out.append(k)
            elif not k.furniture:
                block = k.tag not in INLINE
                out.append(" " * block)
                walk(k)
                out.append(" " * block)

    walk(node)
    return " ".join("".join(out).split())


def digest(nodes: list[Node]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(map(text_of, nodes)).encode("utf-8", "surrogatepass"))


def runs(node: Node) -> list[list[Node]]:
    """The blocks below a node that are not furniture, runs of like siblings together."""
    out: list[list[Node]] = []
    for k in node.kids:
        if isinstance(k, str) or k.furniture or k.tag in INLINE or k.tag in VOID or k.tag in RAW:
            continue
        if out and (out[-1][0].tag, out[-1][0].name) == (k.tag, k.name):
            out[-1].append(k)
        else:
            out.append([k])
    return out


def outline(node: Node, room: list[int] | None = None, content: str | None = None) -> list:
    """The template of one page: [label, pages, digest or None if it varies, [children], contents]; runs of like siblings are one
    node, whose digest is that of the whole run. Contents are the digests of the different pages that have the node, or
    CONSTANT_PAGES once there are that many. With room, no more nodes than that."""
    own = digest([node])
    content, kids = content or own, []
    for run in runs(node):
        if room is not None:
            if room[0] <= 0:
                continue
            room[0] -= 1
        kid = outline(run[0], room, content)
        for k in run[1:]:
            kid = merged(kid, outline(k, room, content), pages=1)
        if len(run) > 1:
            kid[2] = digest(run)
        kids.append(kid)
    return [f"{node.tag}.{node.name}" if node.name else node.tag, 1, own, kids, [content]]


def together(a: list | int, b: list | int) -> list | int:
    """Contents of both."""
    if isinstance(a, int) or isinstance(b, int):
        return CONSTANT_PAGES
    both = sorted({*a, *b})
    return CONSTANT_PAGES if len(both) >= CONSTANT_PAGES else both


def matching(a: list, b: list) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: pairs of equal labels in order, of the greatest total size."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [(i, i) for i in range(len(a))]
    if len(a) * len(b) > 10_000:
        return long_matching(a, b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            here = best[i][j] + size(a[i], b[j]) if a[i][0] == b[j][0] else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], here)
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def long_matching(a: list, b: list) -> list[tuple[int, int]]:
    """The same for long lists: a row of the table at once, and of each row only the bits that the way back needs."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y[0], []).append(j)
    row, up, left = np.zeros(len(b) + 1, np.int64), [], []
    for x in a:
        own = np.array(places.get(x[0], ()), np.int64)
        new = row.copy()
        if len(own):
            weights = np.array([size(x, b[j]) if x[3] and b[j][3] else 1 for j in own], np.int64)
            new[own + 1] = np.maximum(new[own + 1], row[own] + weights)
            np.maximum.accumulate(new, out=new)
        up.append(np.packbits(new == row))
        left.append(np.packbits(np.concatenate(([False], new[1:] == new[:-1]))))
        row = new
    out, i, j = [], len(a), len(b)
    while i and j:
        if up[i - 1][j >> 3] >> (7 - (j & 7)) & 1:
            i -= 1
        elif left[i - 1][j >> 3] >> (7 - (j & 7)) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def size(a: list, b: list) -> int:
    n = 1
    for i, j in matching(a[3], b[3]):
        n += size(a[3][i], b[3][j])
    return n


def merged(a: list, b: list, pages: int | None = None) -> list:
    """Template of both; the nodes of either that have no partner are kept in place."""
    kids, i, j = [], 0, 0
    for x, y in [*matching(a[3], b[3]), (len(a[3]), len(b[3]))]:
        kids += a[3][i:x] + b[3][j:y]
        if x < len(a[3]):
            kids.append(merged(a[3][x], b[3][y], pages))
        i, j = x + 1, y + 1
    return [a[0], pages or a[1] + b[1], a[2] if a[2] == b[2] else None, kids, together(a[4], b[4])]


def count(a: list) -> int:
    return 1 + sum(map(count, a[3]))


def thinned(a: list) -> list:
    """The template without nodes on fewer than 1 in RARE of its pages. The pages of all nodes must have been counted from the first one on."""
    least = a[1] // RARE

    def inside(x: list) -> list:
        return [*x[:3], [inside(k) for k in x[3] if k[1] >= least], *x[4:]]

    return inside(a) if least > 1 else a


def extract(page: str | None, template: list | None) -> str:
    """Main text of a page, given its host's template: the slots, inside an article or main node and outside. Only where the host
    has too few pages for a template to decide, the page's own article or main nodes are the region."""
    tree = parse(page)
    if template is not None and template[4] == CONSTANT_PAGES:
        constant(tree, outline(tree), template)
        return text_of(tree)
    found: list[Node] = []

    def regions(n: Node, tags: tuple[str, ...]) -> None:
        for k in n.kids:
            if not isinstance(k, str) and not k.furniture:
                if k.tag in tags:
                    found.append(k)
                else:
                    regions(k, tags)

    for tags in (("article",), ("main",)):
        regions(tree, tags)
        if found:
            return " ".join(t for t in map(text_of, found) if t)
    return text_of(tree)


def constant(node: Node, own: list, template: list) -> None:
    """Mark the nodes of a page that match boilerplate of the template; own is the page's outline. A node whose text never varies
    on pages of different content is boilerplate: what makes the contents differ stands outside it."""
    below = runs(node)
    for i, j in matching(own[3], template[3]):
        mine, t = own[3][i], template[3][j]
        run = below[i]
        if t[2] is not None and t[2] == mine[2] and t[4] == CONSTANT_PAGES:
            for k in run:
                k.furniture = True
        else:
            for k in run:
                constant(k, mine if len(run) == 1 else outline(k), t)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON), by rounds of merging."""

    def handed(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(thinned(t)) for t in held.values()], pa.string())], ["host", "template"])

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        nodes = 0
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = outline(parse(page))
                nodes += count(tree)
                held[host] = merged(held[host], tree) if host in held else tree
                if held[host][1] >= WINDOW:
                    yield handed({host: held.pop(host)})
                if nodes > HELD_NODES:
                    yield handed(held)
                    held, nodes = {}, 0
        if held:
            yield handed(held)

    def merged_group(group: pd.DataFrame) -> pd.DataFrame:
        trees = [json.loads(t) for t in sorted(group["template"])]
        out = trees[0]
        for t in trees[1:]:
            out = merged(out, t)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [json.dumps(thinned(out))]})

    found = cut(pages.select("host", "html").mapInArrow(per_task, "host string, template string"))
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        # Rows are dealt out by number: equal templates of a host don't meet in one group.
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-most // FAN_IN)))
        found = cut(found.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(merged_group, "host string, template string"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    found = templates(rows)
    n, size_of = found.agg(F.count("*"), F.sum(F.length("template"))).first()
    small = (size_of or 0) + 100 * n <= BROADCAST_BYTES

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict[str | None, list | None] = {None: None}
        for page, template in batches:
            for t in set(template) - memo.keys():
                memo[t] = json.loads(t)
            yield pd.Series([extract(p, memo[t]) for p, t in zip(page, template, strict=True)], dtype="object")
            if len(memo) > 1000:
                memo = {None: None}

    joined = rows.join(F.broadcast(found) if small else found, "host", "left")
    return joined.select("page_id", "url", of("html", "template").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
