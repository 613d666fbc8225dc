"""Main text of web pages by wrappers of their hosts, which are union-free regular expressions inferred from the hosts' pages.

A wrapper is an expression over a page's stream of block elements and texts: elements in order, some optional, some repeated
(a group of up to SQUARE elements after each other too), and texts that are the same on every page or slots. It starts as one
page and is aligned with one token stream of the host after another: equal neighbours fold into a repeated group; of two streams' elements the
best common order is matched, what only one of them has becomes optional, and texts that differ become slots. Wrappers are aligned
with each other in the same way, so each task infers those of its own pages and few small ones are merged for a host: a host of most
pages is no large task. Lists of more than WIDEST elements become one repeated group of optional ones, so a wrapper's
size follows the markup, not the pages.

The wrapper tells where the main text is: an article or main element, or else the element into which most of the text outside links
leads, on all pages of the host together. Left out are elements whose name, class, id or role says that they aren't the article (LEFT_OUT),
headers but for their headings, lists that are links for the most part, and texts of up to SHORT characters, not headings, that are the same on half
of the pages and on SAME with different contents. A page on which the host's main element is missing is its own wrapper.

Texts of block elements are blocks: character references decoded, white space (Unicode's) one space, trimmed, joined by two line ends.
Null pages are empty; pages without url are those of one host; repeated rows are pages of their own; unfinished and very long pages are read
whole; pages without text give an empty one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.exchange import checkpointed, lean
from vectide.llm.html_tree import Element, Text, parse

SQUARE, WIDEST, SAME, SHORT = 3, 24, 5, 60
BROADCAST = 16_000_000  # bytes of all wrappers up to which they are sent to every task
#: Elements that are not the article, and words of classes, ids and roles that say so.
LEFT_OUT = set("aside audio button canvas dialog embed fieldset footer form head hr iframe map menu nav noscript object option search select svg template textarea video".split())
WORDS = set("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies dialog disqus footer form gdpr hidden login menu menubar modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted related recommended replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"", "html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td", "()", "any"}


class Node:
    """Part of a wrapper. pages: with it; chars, links: of its own texts; text: the same on all pages, or None; seen: SAME at most of the pages' contents."""

    __slots__ = ("key", "kids", "optional", "repeated", "pages", "chars", "links", "text", "seen", "members")

    def __init__(self, key: str, kids: list[Node] | None = None, pages: int = 1, chars: int = 0, links: int = 0, text: str | None = None):
        self.key, self.kids, self.pages, self.chars, self.links, self.text = key, kids or [], pages, chars, links, text
        self.optional = self.repeated = False
        self.seen: frozenset[int] = frozenset()
        self.members: list = []

    def shape(self) -> str:
        """The expression as text."""
        return f"{self.key}({','.join(k.shape() for k in self.kids)}){'+' * self.repeated}{'?' * self.optional}"

    def alike(self, other: Node) -> bool:
        """Whether both may be one repeated element: of one key; of containers without class or id also most children in common."""
        if self.key != other.key or self.key not in CONTAINERS:
            return self.key == other.key
        if len(self.kids) == len(other.kids) == 1:
            return self.kids[0].key == other.kids[0].key
        mine, theirs = {k.key for k in self.kids}, {k.key for k in other.kids}
        return 3 * len(mine & theirs) >= 2 * max(len(mine), len(theirs))

    def total(self) -> tuple[int, int]:
        """Characters, and those in links, with all that is in it."""
        got = [k.total() for k in self.kids]
        return self.chars + sum(c for c, _ in got), self.links + sum(n for _, n in got)


def joined(a: Node, b: Node, apart: bool = True) -> Node:
    """a with what b matches; apart: of two pages, else of two places of one."""
    a.text, a.repeated, a.optional = (a.text if a.text == b.text else None), a.repeated or b.repeated, a.optional or b.optional
    a.pages = a.pages + b.pages if apart else max(a.pages, b.pages)
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    if not b.seen <= a.seen:
        a.seen = frozenset(sorted(a.seen | b.seen)[:SAME])
    if len(a.kids) == len(b.kids) == 1 and a.kids[0].key == b.kids[0].key:
        joined(a.kids[0], b.kids[0], apart)
    elif a.kids or b.kids:
        a.kids = aligned(a.kids, b.kids, apart)
    a.members += b.members
    return a


def folded(nodes: list[Node]) -> list[Node]:
    """The expression of a list of neighbours: equal groups after each other become one that repeats."""

    def alike(some: list[Node], others: list[Node]) -> bool:
        if len(others) == len(some) == 1:
            return some[0].key == others[0].key != "#" and some[0].alike(others[0])
        return len(some) == len(others) and all(x.key != "#" and x.alike(y) for x, y in zip(some, others))

    def add(some: list[Node], others: list[Node]) -> None:
        for x, y in zip(some, others):
            joined(x, y, apart=False)

    for size in range(1, SQUARE + 1):
        if len(nodes) < 2 * size:
            break
        out: list[Node] = []
        k = 0
        while k < len(nodes):
            group = nodes[k : k + size]
            if size > 1 and out and out[-1].key == "()" and alike(out[-1].kids, group):
                add(out[-1].kids, group)
            elif len(group) == size and alike(out[-size:], group) and (size == 1 or all(x.key != "()" for x in group)):
                add(out[-size:], group)
                if size > 1:
                    out[-size:] = [Node("()", out[-size:], pages=out[-1].pages)]
                out[-1].repeated = True
            else:
                out, group = out + group[:1], group[:1]
            k += len(group)
        nodes = out
    return nodes


def matched(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of the best common order: most elements of one key, those alike first."""
    if [x.key for x in a] == [x.key for x in b]:
        return [(k, k) for k in range(len(a))]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    worth = [[(1.0 + x.alike(y) if x.key == y.key else 0.0) for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], worth[i][j] and best[i + 1][j + 1] + worth[i][j])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if worth[i][j] and best[i][j] == best[i + 1][j + 1] + worth[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _any(nodes: list[Node], apart: bool) -> Node:
    """One repeated group of optional elements, in whatever order they come."""
    kids: dict[str, Node] = {}
    for x in [y for n in nodes for y in (n.kids if n.key in ("()", "any") else [n])]:
        kids[x.key] = joined(kids[x.key], x, apart) if x.key in kids else x
    out = Node("any", list(kids.values()), pages=max((n.pages for n in nodes), default=1))
    out.repeated = True
    for x in out.kids:
        x.optional = True
    return out


def aligned(a: list[Node], b: list[Node], apart: bool) -> list[Node]:
    """The expression that takes what either takes."""
    if any(x.key == "any" for x in a + b):
        return [_any(a + b, apart)]
    out, i, j = [], 0, 0
    for x, y in [*matched(a, b), (len(a), len(b))]:
        for rest in (a[i:x], b[j:y]):
            for n in rest:
                n.optional = True
                out.append(n)
        if x < len(a):
            out.append(joined(a[x], b[y], apart))
        i, j = x + 1, y + 1
    if len(out) > max(len(a), len(b)):
        out = folded(out)
    return out if len(out) <= WIDEST else [_any(out, apart)]


def expression(e: Element | Text) -> Node:
    """The wrapper of one page."""
    if isinstance(e, Text):
        out = Node("#", chars=len(e.text), links=e.links, text=e.text)
    else:
        out = Node(e.key, folded([expression(k) for k in e.kids]))
        if len(out.kids) > WIDEST:
            out.kids = [_any(out.kids, False)]
    out.members = [e]
    return out


def bare(node: Node, contents: int | None = None) -> Node:
    """node without the page's own elements; texts by hash, so that a wrapper is small."""
    if contents is None:
        contents = zlib.crc32("\n".join(_texts(node)).encode("utf-8", "replace"))
    node.members = []
    if node.key == "#":
        node.seen = frozenset([contents])
        if node.text is not None:
            node.text = f"{zlib.crc32(node.text.encode('utf-8', 'replace'))} {len(node.text)}"
    for k in node.kids:
        bare(k, contents)
    return node


def _texts(node: Node) -> list[str]:
    return [x.text for x in node.members if isinstance(x, Text)] + [t for k in node.kids for t in _texts(k)]


def merged(wrappers: list[Node]) -> Node:
    """One wrapper of all, in the order of their shapes; those of one shape differ in texts and counts only."""
    wrappers = sorted(wrappers, key=Node.shape)
    out = wrappers[0]
    for w in wrappers[1:]:
        out = joined(out, w)
    return out


@lru_cache(100_000)
def _tag(key: str) -> str:
    return re.match(r"[^.#@]*", key)[0] if key not in ("#", "") else key


@lru_cache(100_000)
def left_out(key: str) -> bool:
    tag = _tag(key)
    if tag in ("", "html", "body", "main", "()", "any", "#"):
        return False
    words = re.sub(r"\b(has|with|no|without)[-_]\w+", "", key[len(tag) :])
    return tag in LEFT_OUT or bool(WORDS & set(re.split(r"[^a-z]+", words)))


def main_of(wrapper: Node) -> Node:
    """The element of the main text."""

    def all_of(node: Node):
        for k in node.kids:
            if not left_out(k.key):
                yield k
                yield from all_of(k)

    def mass(node: Node) -> int:
        return node.chars - node.links + sum(mass(k) for k in node.kids if not left_out(k.key))

    found = [*all_of(wrapper)]
    for is_main in (lambda k: _tag(k) == "article" or k.endswith(("@articlebody", "@article")), lambda k: _tag(k) == "main" or k.endswith("@main")):
        some = [x for x in found if is_main(x.key)]
        if some and 3 * mass(best := max(some, key=mass)) >= mass(wrapper) > 0:
            return best
    at = wrapper
    while True:
        inner = [k for k in at.kids if not left_out(k.key)]
        best = max(inner, key=mass, default=None)
        if best is None or _tag(best.key) not in CONTAINERS or 2 * mass(best) <= mass(at):
            return at
        at = best


def aside(node: Node, main: Node) -> bool:
    """Whether a part of the main element isn't of the article, as the host's pages tell: a short text that most of them share, or links."""
    if node.key == "#":
        return node.text is not None and len(node.seen) >= SAME and 2 * node.pages >= main.pages and node.chars <= SHORT * node.pages
    if _tag(node.key) in ("ul", "ol", "dl", "div", "table"):
        chars, links = node.total()
        return links > 0.8 * chars > 0
    return False


def assign(node: Node, page: Node) -> None:
    """Gives each element of a page (its expression) the wrapper's node that takes it."""
    for e in page.members:
        e.node = node
    flat = lambda nodes: [y for n in nodes for y in (flat(n.kids) if n.key in ("()", "any") else [n])]
    theirs = flat(page.kids)
    if any(k.key in ("()", "any") for k in node.kids):
        by = {k.key: k for k in reversed(flat(node.kids))}
        pairs = [(by[x.key], x) for x in theirs if x.key in by]
    else:
        pairs = [(node.kids[i], theirs[j]) for i, j in matched(node.kids, theirs)]
    for n, x in pairs:
        assign(n, x)


def blocks_of(page: Element, wrapper: Node | None, main: Node | None = None) -> list[str]:
    """Blocks of the page's main text, given its host's wrapper and main element; without a wrapper the page is its own."""
    own = expression(page)
    if wrapper is None:
        wrapper = own
    main = main or main_of(wrapper)
    assign(wrapper, own)
    out: list[str] = []
    met = False

    def walk(e: Element | Text, inside: bool, heads_only: bool, heading: bool) -> None:
        nonlocal met
        if isinstance(e, Text):
            if inside and not heads_only and not (e.node and not heading and aside(e.node, main)):
                out.append(e.text)
            return
        if left_out(e.key) or inside and e.node is not None and e.node is not main and aside(e.node, main):
            return
        inside = inside or e.node is main
        met = met or e.node is main
        heads_only = heads_only and e.tag not in HEADINGS or inside and _header(e.key)
        for k in e.kids:
            walk(k, inside, heads_only, heading or e.tag in HEADINGS)

    walk(page, False, False, False)
    return out if met or wrapper is own else blocks_of(page, None)


@lru_cache(100_000)
def _header(key: str) -> bool:
    tag = _tag(key)
    return tag not in HEADINGS and (tag == "header" or "header" in re.split(r"[^a-z]+", key[len(tag) :]))


def _store(w: Node) -> bytes:
    def flat(n: Node):
        return n.key, [flat(k) for k in n.kids], n.optional, n.repeated, n.pages, n.chars, n.links, n.text, sorted(n.seen)

    return zlib.compress(pickle.dumps(flat(w)), 1)


def _load(data: bytes) -> Node:
    def node(x) -> Node:
        out = Node(x[0], [node(k) for k in x[1]], x[4], x[5], x[6], x[7])
        out.optional, out.repeated, out.seen = x[2], x[3], frozenset(x[8])
        return out

    return node(pickle.loads(zlib.decompress(data)))


def _hosted(pages: DataFrame, url_col: str, html_col: str, *more) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"^[^/?#]*//([^/?#]*)", 1))
    return pages.select(*more, host.alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", held: int = 2000) -> DataFrame:
    """host, wrapper (as stored): from all pages. A task holds as many expressions at a time, one for each host and shape."""

    @lean
    def own(batches):
        got: dict[str, dict[str, Node]] = {}
        n = 0

        def flush():
            rows = [(h, _store(merged(list(x.values())))) for h, x in sorted(got.items())]
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                w = bare(expression(parse(page.as_py())))
                shapes, shape = got.setdefault(host, {}), w.shape()
                n += shape not in shapes
                shapes[shape] = joined(shapes[shape], w) if shape in shapes else w
                if n >= held:
                    yield flush()
                    n = 0
        if got:
            yield flush()

    @lean
    def both(t: pa.Table) -> pa.Table:
        w = merged([_load(x) for x in sorted(t["wrapper"].to_pylist())])
        return pa.table({"host": t["host"].slice(0, 1), "wrapper": pa.array([_store(w)], pa.binary())})

    kind = "host string, wrapper binary"
    parts = _hosted(pages, url_col, html_col).mapInArrow(own, kind)
    parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = parts.groupBy("host", "part").applyInArrow(lambda t: both(t), kind)
    return parts.groupBy("host").applyInArrow(lambda t: both(t), kind)  # 64 a host at most


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text of every page."""
    wrappers = checkpointed(infer_wrappers(pages, url_col, html_col))
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rows = _hosted(pages, url_col, html_col, F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    # Beyond the bound a join by host, whose large partitions Spark splits.
    both = rows.join(F.broadcast(wrappers) if size <= BROADCAST else wrappers, "host")

    @lean
    def run(batches):
        known: dict[bytes, tuple[Node, Node]] = {}
        for batch in batches:
            texts = []
            for page, data in zip(batch.column("html"), batch.column("wrapper").to_pylist()):
                if data not in known:
                    if len(known) > 500:
                        known.clear()
                    known[data] = ((w := _load(data)), main_of(w))
                texts.append("\n\n".join(blocks_of(parse(page.as_py()), *known[data])))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    return both.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
