"""HTML extraction by wrapper induction.

1. Every page is parsed to a DOM tree and to a skeleton: the tree with text left
   out and like siblings (same tag and class) folded into one node.
2. The most common skeleton of a host is its reference. Every other skeleton of
   the host is aligned with it by simple tree matching (Yang, 1991), so that a
   node of any page is a slot of the host's reference.
3. Slots are read over all pages of the host. A text that stands in one slot on
   nearly every page is constant: template. What varies is content, and the
   container that holds nearly all varying text is the host's content slot.
4. Main text is what stands in the content slot, less constant blocks at its
   edges (a heading, or what stands between varying blocks, stays) and less
   elements that are no article text by meaning (navigation, adverts, notices,
   forms, comments, ...), which may vary from page to page. Where induction
   finds no slot inside a page's article or main element, that element counts;
   without one, the body blocks that are not mostly links.

Pages are not moved: the induced templates are small, and only what is below a
checked size is broadcast; beyond that, templates are joined to the pages.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: One page alone shows no variance.
MIN_PAGES = 2
#: Share of a host's pages on which a constant text stands at least.
CONSTANT = 0.9
#: Share of a container's varying text that one child holds if it is the content slot.
DOMINANT = 0.75
#: Templates beyond so many bytes are joined instead of broadcast.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol table dl article section div main body td th".split())
_NOT_TEXT = frozenset(
    "head title script style nav header footer aside form button select option optgroup textarea input label fieldset noscript template iframe "
    "svg canvas object embed audio video map menu dialog math noembed noframes xmp".split()
)
_NOT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: A class or id names such a part only if all of its hyphenated words do.
_CHROME = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners promo promos promotion promotions sponsor sponsored "
    "sponsors cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal modals overlay overlays newsletter "
    "newsletters subscribe subscription signup login sidebar sidebars nav navs navbar navigation menu menus breadcrumb breadcrumbs footer footers masthead "
    "topbar toolbar comment comments commentlist disqus reply replies share sharing social widget widgets pagination pager disclaimer disclaimers form forms".split()
)
_JOINT = frozenset("site page global main top bottom left right box block bar list links link container wrapper wrap section area slot item items inner outer header "
                   "log in sign up skip crumb crumbs pop print sr only side bread privacy policy user reader thread respond post article entry".split())  # fmt: skip
_PAIRS = frozenset(("site-header page-header pop-up sign-up log-in side-bar bread-crumb bread-crumbs skip-link print-only sr-only related related-posts "
                    "related-articles related-links recommended recommendations").split())
_ROOT = frozenset(("html", "body"))
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "sig", "children", "out", "attrs", "main")

    def __init__(self, tag: str, sig: str, out: bool, main: bool):
        self.tag, self.sig, self.out, self.main = tag, sig, out, main
        self.children: list = []  # nodes and strings


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def _is_out(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _NOT_TEXT:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _NOT_ROLE:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return tag not in _ROOT and any(map(_is_chrome, f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()))


def _is_chrome(name: str) -> bool:
    """``cookie-notice`` is a notice; ``notice-of-death`` may be an article."""
    if name in _CHROME or name in _PAIRS:
        return True
    words = re.split(r"[-_]+", name.strip("-_"))
    words = [w for w in words if not w.isdigit()]
    return any(w in _CHROME for w in words) and all(w in _CHROME or w in _JOINT for w in words)


def parse(text: str) -> Node:
    """A forgiving DOM: unclosed, misnested and cut-off elements are accepted."""
    root = Node("#root", "#root", False, False)
    stack, at, end = [root], 0, len(text)
    while at < end:
        lt = text.find("<", at)
        if lt < 0:
            stack[-1].children.append(text[at:])
            break
        if lt > at:
            stack[-1].children.append(text[at:lt])
        m = _TOKEN.match(text, lt)
        if not m:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            else:
                if tag == "p" or tag == "br":
                    stack[-1].children.append(Node(tag, tag, False, False))
            continue
        attrs = _attributes(m[3] or m[6] or "")
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE:
                    break
        if tag in _SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SAME[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "table", "dl", "select", "menu"):
                    break
        first = attrs.get("class", "").split()
        main = tag in ("article", "main") or attrs.get("role", "").lower() == "main"
        node = Node(tag, f"{tag}.{first[0]}" if first else tag, _is_out(tag, attrs), main)
        stack[-1].children.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            if not close:
                break  # an open script or style runs to the end
            at = close.start()
            stop = text.find(">", at)
            at = end if stop < 0 else stop + 1
        elif tag not in _VOID and not (m[3] or m[6] or "").rstrip().endswith("/") or tag in _BLOCK and tag not in _VOID:
            stack.append(node)
    return root


class Page:
    """Skeleton and blocks of one page.

    ``skeleton`` is one line "depth signature" per folded node in preorder.
    ``blocks`` are (skeleton node, text, part): white space folded, part 2 inside
    the main region, 1 elsewhere in the body, 0 left out by meaning.
    """

    def __init__(self, text: str | None):
        root = parse(text or "")
        self.nodes: list[tuple[int, str]] = []
        self.blocks: list[list] = []
        self._at: dict[tuple[int, str], int] = {}
        self._mark(root)
        self._walk(root)
        order: dict[int, list[int]] = {}
        for (parent, _), k in self._at.items():
            order.setdefault(parent, []).append(k)
        lines, new, todo = [], {}, [(k, 0) for k in reversed(order.get(-1, []))]
        while todo:
            k, depth = todo.pop()
            new[k] = len(lines)
            lines.append(f"{depth} {self.nodes[k][1]}")
            todo += [(c, depth + 1) for c in reversed(order.get(k, []))]
        self.skeleton = "\n".join(lines)
        for b in self.blocks:
            b[0] = new[b[0]]
        self.has_main = any(b[2] == 2 for b in self.blocks)

    @staticmethod
    def _mark(root: Node) -> None:
        """An element around the main region is never left out."""
        todo: list[tuple[Node, bool]] = [(root, False)]
        while todo:
            node, done = todo.pop()
            if done:
                if node.out and node.tag not in ("head", "template") and any(isinstance(c, Node) and c.main and not c.out for c in node.children):
                    node.out, node.main = False, True
                continue
            todo.append((node, True))
            todo += [(c, False) for c in node.children if isinstance(c, Node)]

    def _walk(self, root: Node) -> None:
        inline: list[str] = []
        where = [(-1, 0, False)]

        def flush() -> None:
            if inline:
                text = " ".join(_html.unescape("".join(inline)).split())
                if text:
                    own = where[0]
                    self.blocks.append([own[0], text, own[1], link[0]])
                inline.clear()
                link[0] = 0

        link = [0]
        # (node or string or closing tag, skeleton parent, part, inside a link)
        todo: list = [(root, -1, 1, False)]
        while todo:
            item, parent, part, in_link = todo.pop()
            if isinstance(item, str):
                if part:
                    if not inline:
                        where[0] = (parent, part)
                    inline.append(item)
                    if in_link:
                        link[0] += len(item)
                elif not item.isspace():
                    text = " ".join(_html.unescape(item).split())
                    if text:
                        self.blocks.append([parent, text, 0, 0])
                continue
            if item is None:
                flush()
                continue
            block = item.tag in _BLOCK or item.tag == "#root"
            if item.out or block:
                flush()
            key = (parent, item.sig)
            k = self._at.get(key)
            if k is None:
                k = self._at[key] = len(self.nodes)
                self.nodes.append((parent, item.sig))
            inner = 0 if item.out or not part else 2 if item.main or part == 2 else 1
            slot = k if block or item.out else parent
            if block or item.out:
                todo.append((None, k, inner, False))
            todo += [(c, slot, inner, in_link or item.tag == "a") for c in reversed(item.children)]

    def main_blocks(self, template: frozenset | set = frozenset(), root: int = -1) -> list[str]:
        """Texts of the content slot ``root`` (-1: none was induced), else of the
        main region, without the ``template`` (node, text hash) at its edges."""
        lines = self.skeleton.split("\n")
        inside = range(root, _subtree_end(lines, root)) if root >= 0 else range(0)
        own = [b for b in self.blocks if b[2] and b[0] in inside]
        if not own or self.has_main and not all(b[2] == 2 for b in own):
            want = 2 if self.has_main else 1
            own = [b for b in self.blocks if b[2] == want and (want == 2 or b[3] <= len(b[1]) / 2)]
        if template:
            fixed = [(b[0], text_hash(b[1])) in template for b in own]
            varying = [k for k, x in enumerate(fixed) if not x]
            first, last = (varying[0], varying[-1]) if varying else (0, len(own))
            own = [b for k, b in enumerate(own) if not fixed[k] or first < k < last or k < first and _HEADING.match(lines[b[0]])]
        return [b[1] for b in own]


_HEADING = re.compile(r"\d+ h[1-6](?:\.|$)")


def _subtree_end(lines: list[str], node: int) -> int:
    depth = int(lines[node].partition(" ")[0])
    for k in range(node + 1, len(lines)):
        if int(lines[k].partition(" ")[0]) <= depth:
            return k
    return len(lines)


def text_hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _tree(skeleton: str) -> list[tuple[str, list[int]]]:
    """(signature, children) by number; node 0 is the root."""
    nodes: list[tuple[str, list[int]]] = []
    path: list[int] = []
    for k, line in enumerate(skeleton.split("\n")):
        depth, _, sig = line.partition(" ")
        nodes.append((sig, []))
        del path[int(depth) :]
        if path:
            nodes[path[-1]][1].append(k)
        path.append(k)
    return nodes


def match_trees(one: str, two: str) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping top-down matching, as a
    map from nodes of ``one`` to nodes of ``two``.

    Like siblings are folded, so a signature stands once among siblings and every
    node has at most one partner, the one on the same path. The best matching of
    two lists of children is then the heaviest run of partners in the order of
    both, found in n log n steps; trees are walked without recursion, so that
    neither depth nor width is bounded.
    """
    if one == two:
        return {k: k for k in range(one.count("\n") + 1)}
    a, b = _tree(one), _tree(two)
    if a[0][0] != b[0][0]:
        return {}
    pairs, partners = [(0, 0)], {}
    for x, y in pairs:  # grows while it is walked
        place = {b[d][0]: (j, d) for j, d in enumerate(b[y][1])}
        partners[x] = [(place[a[c][0]][0], c) for c in a[x][1] if a[c][0] in place]
        pairs += [(c, place[a[c][0]][1]) for _, c in partners[x]]
    weight: dict[int, int] = {}
    chosen: dict[int, list[int]] = {}
    for x, y in reversed(pairs):
        weight[x], chosen[x] = _heaviest(partners[x], weight, len(b[y][1]))
    out, todo, partner = {}, [0], dict(pairs)
    while todo:
        x = todo.pop()
        out[x] = partner[x]
        todo += chosen[x]
    return out


def _heaviest(found: list[tuple[int, int]], weight: dict[int, int], n: int) -> tuple[int, list[int]]:
    """One plus the weight of, and the children in, the heaviest subsequence of
    (place, child) with rising places; by a Fenwick tree of best weights."""
    best: list[tuple[int, int]] = [(0, -1)] * (n + 1)
    before = []
    for k, (j, c) in enumerate(found):
        top, i = (0, -1), j
        while i:
            top, i = max(top, best[i]), i & (i - 1)
        before.append(top[1])
        own, i = (top[0] + weight[c], k), j + 1
        while i <= n:
            best[i], i = max(best[i], own), i + (i & -i)
    top, i = (0, -1), n
    while i:
        top, i = max(top, best[i]), i & (i - 1)
    out, k = [], top[1]
    while k >= 0:
        out.append(found[k][1])
        k = before[k]
    return top[0] + 1, out[::-1]


_CONTAINER = re.compile(r"(?:html|body|div|article|main|section|center|table|tbody|tr|td|#root)(?:\.|$)")
_FINAL = re.compile(r"(?:article|main)(?:\.|$)")


def content_slot(skeleton: str, volume: dict[int, int]) -> int:
    """The slot that holds the varying text: from the root down into the child
    with DOMINANT of it, as long as that is a container and leaves no varying
    heading behind; -1 if nothing varies."""
    tree = _tree(skeleton)
    total = [volume.get(k, 0) for k in range(len(tree))]
    heads = [int(total[k] > 0 and re.match(r"h[1-6](?:\.|$)", tree[k][0]) is not None) for k in range(len(tree))]
    for k in reversed(range(len(tree))):
        for c in tree[k][1]:
            total[k] += total[c]
            heads[k] += heads[c]
    if total[0] <= 0:
        return -1
    at = 0
    while not _FINAL.match(tree[at][0]):
        top = max(tree[at][1], key=lambda c: total[c], default=None)
        if top is None or not _CONTAINER.match(tree[top][0]) or total[top] < DOMINANT * total[at] or heads[top] < heads[at]:
            break
        at = top
    return at


def skeleton_hash(skeleton: str) -> int:
    return text_hash(skeleton)


def _features(pages: DataFrame) -> DataFrame:
    """(host, body, skel, skeleton, slots): one row per page with a host; body is
    a hash of the main text, slots are its (node, text hash, characters outside
    links)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, text in zip(batch.column(0), batch.column(1)):
                host = host_of(url.as_py())
                if not host:
                    continue
                page = Page(text.as_py())
                # what is left out by meaning need not be induced
                slots = sorted({(b[0], text_hash(b[1]), max(0, len(b[1]) - b[3])) for b in page.blocks if b[2]})
                body = text_hash("\n".join(b[1] for b in page.blocks if b[2]))
                rows.append((host, body, skeleton_hash(page.skeleton), page.skeleton, [{"node": n, "h": h, "len": k} for n, h, k in slots]))
            cols = list(zip(*rows)) or [[], [], [], [], []]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("node", pa.int32()), ("h", pa.int64()), ("len", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["host", "body", "skel", "skeleton", "slots"])

    return pages.select("url", "html").mapInArrow(run, "host string, body long, skel long, skeleton string, slots array<struct<node:int,h:long,len:long>>")


def induce(pages: DataFrame, min_pages: int = MIN_PAGES, constant: float = CONSTANT) -> DataFrame:
    """(host, skel, root, drop): for each skeleton of a host the node that is the
    content slot (-1: it has none) and the (node, text hash) pairs that are
    template. Pages with the same body count once, so that many copies of one
    article do not make it a template."""
    spark = pages.sparkSession
    seen = _features(pages).groupBy("host", "body", "skel").agg(F.first("skeleton").alias("skeleton"), F.first("slots").alias("slots"))
    seen = materialize(spark, seen, "page-slots")
    total = seen.groupBy("host").agg(F.countDistinct("body").alias("total")).filter(F.col("total") >= min_pages)
    total = materialize(spark, total, "host-pages")
    slot = seen.select("host", "skel", F.explode("slots").alias("s")).groupBy("host", "skel", F.col("s.node").alias("node"), F.col("s.h").alias("h"))
    slot = materialize(spark, slot.agg(F.count("*").alias("n"), F.max("s.len").alias("len")), "slot-texts")
    # a text on too few pages of its host in any slot is constant in none
    often = slot.groupBy("host", "h").agg(F.sum("n").alias("upper")).filter(F.col("upper") >= constant * min_pages)
    often = often.join(total, "host").filter(F.col("upper") >= constant * F.col("total")).select("host", "h", "total")
    often = materialize(spark, often, "frequent-texts")
    kinds = seen.join(total.select("host"), "host", "left_semi").groupBy("host", "skel").agg(F.first("skeleton").alias("skeleton"), F.count("*").alias("n"))
    kinds = materialize(spark, kinds, "skeletons")
    pivot = kinds.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skel")).alias("pivot"))
    pivot = materialize(spark, pivot, "references")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for host, skel, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                for x, y in match_trees(one, two).items():
                    for k, v in enumerate((host, skel, x, y)):
                        out[k].append(v)
            kinds_ = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds_)], names=["host", "skel", "node", "slot"])

    # by skeleton too: those of a large host are aligned by many tasks
    both = kinds.join(pivot, "host").select("host", "skel", "skeleton", "pivot").repartition("host", "skel")
    aligned = materialize(spark, both.mapInArrow(align, "host string, skel long, node int, slot int"), "aligned")
    known = slot.join(often, ["host", "h"]).join(aligned, ["host", "skel", "node"])
    fixed = known.groupBy("host", "slot", "h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("len")).alias("volume"), F.first("total").alias("total"))
    fixed = materialize(spark, fixed.filter(F.col("n") >= constant * F.col("total")).select("host", "slot", "h", "volume"), "constants")
    drop = fixed.join(aligned, ["host", "slot"]).groupBy("host", "skel").agg(F.collect_list(F.struct("node", "h")).alias("drop"))

    # text of every slot, less what is constant in it
    text = slot.groupBy("host", "skel", "node").agg(F.sum(F.col("n") * F.col("len")).alias("volume")).join(aligned, ["host", "skel", "node"])
    text = text.select("host", "slot", "volume").unionByName(fixed.select("host", "slot", (-F.col("volume")).alias("volume")))
    text = text.groupBy("host", "slot").agg(F.sum("volume").alias("volume")).groupBy("host").agg(F.collect_list(F.struct("slot", "volume")).alias("volumes"))

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [content_slot(t, {v["slot"]: v["volume"] for v in vs}) for t, vs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["host", "slot"])

    slots = pivot.join(text, "host").select("host", "pivot", "volumes").mapInArrow(choose, "host string, slot int")
    roots = aligned.join(materialize(spark, slots, "content-slots"), ["host", "slot"]).select("host", "skel", F.col("node").alias("root"))
    out = roots.join(drop, ["host", "skel"], "full").select("host", "skel", F.coalesce("root", F.lit(-1)).alias("root"), F.coalesce("drop", F.array()).alias("drop"))
    return materialize(spark, out, "templates")


_OUT = "page_id {kind}, url string, text string, n_chars long"


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Main text per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty html gives an empty text; a page without a host, or whose host
    has no second page, is not aligned with others; repeated rows give the same text; an empty table gives
    no rows; only page_id, url and html are read.
    """
    spark = pages.sparkSession
    templates = induce(pages)
    size = templates.agg(F.sum(F.size("drop") * 12 + F.octet_length("host") + 20)).collect()[0][0] or 0
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    shared = None
    if size <= broadcast_bytes:
        found = {(r[0], r[1]): (r[2], frozenset((d[0], d[1]) for d in r[3])) for r in templates.toLocalIterator()}
        shared = spark.sparkContext.broadcast(found)
        rows = rows.withColumn("root", F.lit(None).cast("int")).withColumn("drop", F.lit(None).cast("array<struct<node:int,h:long>>"))
    else:
        keyed = rows.mapInArrow(_keys, "page_id {}, url string, html string, _host string, _skel long".format(pages.schema["page_id"].dataType.simpleString()))
        hit = (F.col("_host") == F.col("host")) & (F.col("_skel") == F.col("skel"))
        rows = keyed.join(templates.hint("merge"), hit, "left").select("page_id", "url", "html", "root", "drop")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else None
        for batch in batches:
            texts = []
            for url, text, node, drop in zip(*batch.columns[1:]):
                page = Page(text.as_py())
                if known is None:
                    root, template = node.as_py(), {(d["node"], d["h"]) for d in drop.as_py() or ()}
                else:
                    root, template = known.get((host_of(url.as_py()), skeleton_hash(page.skeleton)), (-1, frozenset()))
                texts.append(" ".join(page.main_blocks(template, -1 if root is None else root)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, _OUT.format(kind=pages.schema["page_id"].dataType.simpleString()))


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = [host_of(u.as_py()) for u in batch.column(1)]
        skels = [skeleton_hash(Page(t.as_py()).skeleton) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.string()), pa.array(skels, pa.int64())], names=["page_id", "url", "html", "_host", "_skel"])
