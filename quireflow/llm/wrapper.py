"""Main text of HTML pages by wrapper induction.

A page's DOM is reduced to its block elements, labelled by tag and class; runs of like siblings fold to one node,
so pages of one template have one small tree. Trees of a host's pages are aligned with the host's most frequent
tree by simple tree matching. A text block that stands in the same node on nearly all of the host's pages that have the
node is part of the template; what varies there is in a slot. Content are the varying blocks of the smallest region that
holds all of the varying text, without those that are menus, headers, footers, adverts, forms, comments and the like
by tag, class or role.

Slot statistics cover all pages that have text. They are rows for each host, tree, node and hash of a block, dealt out
by all of these and reduced to one for each host and node, so no task takes a host with a third of all pages. Each
tree is sent once.
Wrappers, one row for each host, are broadcast if they are few; else adaptive execution splits the join's hot
hosts. Pages are parsed twice and never grouped.

Edge cases: null or empty html gives empty text; hosts with fewer than ``min_pages`` pages, or whose pages are
all copies, have no wrapper: then labels alone decide, within article or main elements where there are any;
unclosed, misnested and truncated markup is read as browsers do, roughly; nesting beyond ``MAX_DEPTH`` is flattened,
but for boilerplate there, which goes; very long pages are read whole, in time that grows with their length; repeated
rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, worker_cache
from .url_cascade import host_of

#: Possessive, so each tag is read once; a quote that nothing closes is a character like others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# HTML element names by kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select button xmp noembed noframes".split())
BLOCK = frozenset(
    "html head body title article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption "
    "figure figcaption nav header footer aside form fieldset address details summary dialog center hgroup menu search".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th summary".split())
NOT_CONTENT = frozenset("head title nav header footer aside form fieldset menu dialog search".split())
NOT_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended "
    "comment comments disqus reply replies respond footer header masthead copyright pagination pager widget toolbar skip search complementary contentinfo".split()
)
MAX_DEPTH = 120


class Node:
    __slots__ = ("children", "label", "parent", "tag", "text", "depth", "slot")

    def __init__(self, tag: str, label: str, parent: Node | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.children: list[Node] = []
        self.text: list[list[str]] = []  # blocks
        self.depth = parent.depth + 1 if parent else 0
        self.slot = -1


def label_of(tag: str, attributes: str) -> str:
    names = [f"{m[1].lower()}={(m[2] or m[3] or m[4] or '').lower()}" for m in NAMED.finditer(attributes)] if attributes else []
    return tag + "".join("[" + re.sub(r"[^\w= -]|\d+", "", x) + "]" for x in sorted(names))


def boilerplate(label: str) -> bool:
    tag, _, rest = label.partition("[")
    if tag in NOT_CONTENT:
        return True
    words = [w for w in re.split(r"[^a-z]+", rest) if w and w not in ("class", "id", "role")]
    # a paragraph with other names too is one of the text that is set apart
    return bool(words) and (all if tag in LEAF else any)(w in NOT_CONTENT_WORDS for w in words)


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the page's text blocks in order with their elements."""
    root = at = Node("#root", "#root", None)
    blocks: list[tuple[Node, str]] = []
    held: list[str] = []
    flat: list[tuple[str, bool]] = []  # open elements beyond the depth, and whether they are boilerplate

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text and not any(bad for _, bad in flat):
                blocks.append((at, text))

    pos, n = 0, len(html)
    while pos < n:
        m = TOKEN.search(html, pos)
        held.append(html[pos : m.start() if m else n])
        if not m:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1]:
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
                    pos = end.end() if end else n
                continue
            if tag == "br":
                held.append("\n")
            if tag in VOID or tag not in BLOCK:
                continue
            flush()
            if tag in CLOSES_P:
                x = at
                while x is not None and x.tag not in ("p", "table", "#root"):
                    x = x.parent
                if x is not None and x.tag == "p":
                    at = x.parent
            if tag in SIBLINGS:
                x = at
                while x.parent is not None and x.tag not in SCOPE[tag]:
                    if x.tag in SIBLINGS[tag]:
                        at = x.parent
                        if tag != "tr":
                            break
                    x = x.parent
            if at.depth >= MAX_DEPTH:
                flat.append((tag, boilerplate(label_of(tag, m[3]))))
                continue
            child = Node(tag, label_of(tag, m[3]), at)
            at.children.append(child)
            at = child
        elif tag in BLOCK:
            flush()
            if flat:
                k = next((k for k in range(len(flat) - 1, -1, -1) if flat[k][0] == tag), None)
                if k is not None:
                    del flat[k:]
                    continue
            x = at
            while x is not None and x.tag != tag:
                x = x.parent
            if x is not None and x.parent is not None:
                at = x.parent
    flush()
    return root, blocks


class Tree:
    """Folded nodes in preorder: label and parent; like siblings are one node."""

    def __init__(self, labels: list[str], parents: list[int]):
        self.labels, self.parents = labels, parents
        self.children: list[list[int]] = [[] for _ in labels]
        for k, p in enumerate(parents):
            if p >= 0:
                self.children[p].append(k)

    def __str__(self) -> str:
        return "\n".join(f"{p} {x}" for p, x in zip(self.parents, self.labels))

    @classmethod
    def of(cls, text: str) -> Tree:
        rows = [x.split(" ", 1) for x in text.split("\n")]
        return cls([r[1] for r in rows], [int(r[0]) for r in rows])


def fold(root: Node) -> Tree:
    """Folds runs of siblings with one label, their children together, and gives each node its slot."""
    labels, parents = [], []
    stack: list[tuple[list[Node], int]] = [([root], -1)]
    while stack:
        group, parent = stack.pop()
        k = len(labels)
        labels.append(group[0].label)
        parents.append(parent)
        runs: list[list[Node]] = []
        for node in group:
            node.slot = k
            for c in node.children:
                if runs and runs[-1][0].label == c.label:
                    runs[-1].append(c)
                else:
                    runs.append([c])
        merged: list[list[Node]] = []
        for r in runs:  # children of several folded parents repeat in the same order: fold those too
            same = next((x for x in merged if x[0].label == r[0].label), None) if len(group) > 1 else None
            if same is None:
                merged.append(r)
            else:
                same += r
        stack += [(r, k) for r in reversed(merged)]
    return Tree(labels, parents)


def tree_match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the pairs of a largest order-preserving alignment of equal labels, root to root."""
    size: dict[tuple[int, int], int] = {}

    def align(i: int, j: int) -> list[list[int]]:
        x, y = a.children[i], b.children[j]
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(1, len(x) + 1):
            for q in range(1, len(y) + 1):
                m[p][q] = max(m[p - 1][q], m[p][q - 1], m[p - 1][q - 1] + weight(x[p - 1], y[q - 1]))
        return m

    def weight(i: int, j: int) -> int:
        if a.labels[i] != b.labels[j]:
            return 0
        if (i, j) not in size:
            size[i, j] = 1 + align(i, j)[-1][-1]
        return size[i, j]

    pairs: dict[int, int] = {}
    todo = [(0, 0)] if weight(0, 0) else []
    while todo:
        i, j = todo.pop()
        pairs[i] = j
        x, y, m = a.children[i], b.children[j], align(i, j)
        p, q = len(x), len(y)
        while p and q:
            w = weight(x[p - 1], y[q - 1])
            if w and m[p][q] == m[p - 1][q - 1] + w:
                todo.append((x[p - 1], y[q - 1]))
                p, q = p - 1, q - 1
            elif m[p][q] == m[p - 1][q]:
                p -= 1
            else:
                q -= 1
    return pairs


def aligned(tree: str, reference: str) -> dict[int, int]:
    """tree_match of the two trees as text; the last ones are kept."""
    store = worker_cache().setdefault("aligned", {})
    if (tree, reference) not in store:
        if len(store) > 2000:
            store.clear()
        a, b = Tree.of(tree), Tree.of(reference)
        store[tree, reference] = {k: k for k in range(len(a.labels))} if tree == reference else tree_match(a, b)
    return store[tree, reference]


def text_hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def slot_statistics(pages: DataFrame) -> DataFrame:
    """pages: host, html. host, tree_id, slot, h, tree, n, mass: pages with a block of hash h in the slot, its characters.

    h is null for the pages that have text in the slot; slot 0 counts the tree's pages and alone has the tree. Pages
    without text count nowhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                root, blocks = parse(html.as_py() or "")
                if not blocks:
                    continue
                tree = str(fold(root))
                tree_id = text_hash(tree)
                own: dict[tuple, int] = {}
                for node, text in blocks:
                    if node.slot > 0:
                        own[node.slot, None] = 0
                        key = node.slot, text_hash(text)
                        own[key] = own.get(key, 0) + len(text)
                for slot, h, t, size in [(0, None, tree, 0), *((*k, None, v) for k, v in own.items())]:
                    x = found.setdefault((host, tree_id, slot, h), [t, 0, 0])
                    x[1], x[2] = x[1] + 1, x[2] + size
            keys, values = list(found), list(found.values())
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = [*([k[i] for k in keys] for i in range(4)), *([v[i] for v in values] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["host", "tree_id", "slot", "h", "tree", "n", "mass"])

    raw = pages.mapInArrow(run, "host string, tree_id long, slot int, h long, tree string, n long, mass long")
    return raw.groupBy("host", "tree_id", "slot", "h").agg(F.max("tree").alias("tree"), F.sum("n").alias("n"), F.sum("mass").alias("mass"))


def induce_wrappers(pages: DataFrame, min_pages: int = 5, constant_share: float = 0.9) -> DataFrame:
    """host, reference, constant (slot of the reference and hash) and masses (varying characters by slot) for hosts with enough pages.

    A block is constant if that share of the pages that have its slot, at least half of the host's, have it there.
    """
    stats = cut(slot_statistics(pages))
    trees = stats.where("slot = 0").select("host", "tree_id", "tree", "n")
    hosts = cut(trees.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("reference"), F.sum("n").alias("pages")).where(F.col("pages") >= min_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, i, slot, at) for h, i, t, x in zip(*(batch.column(k).to_pylist() for k in range(4))) for slot, at in aligned(t, x).items() if at > 0]
            columns = zip(*rows) if rows else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["host", "tree_id", "slot", "at"])

    paired = trees.join(maybe_broadcast(hosts), "host").select("host", "tree_id", "tree", "reference")
    placed = cut(paired.mapInArrow(run, "host string, tree_id long, slot int, at int"))
    texts = stats.where("slot > 0").select("host", "tree_id", "slot", "h", "n", "mass").join(maybe_broadcast(placed), ["host", "tree_id", "slot"])
    texts = cut(texts.groupBy("host", "at", "h").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")))
    slots = cut(texts.where("h IS NULL").select("host", "at", F.col("n").alias("of")))
    fixed = (F.col("n") >= constant_share * F.col("of")) & (2 * F.col("of") >= F.col("pages"))
    known = texts.where("h IS NOT NULL").join(maybe_broadcast(slots), ["host", "at"]).join(maybe_broadcast(hosts.select("host", "pages")), "host").withColumn("fixed", fixed)
    by_slot = known.groupBy("host", "at").agg(F.sum(F.when(~F.col("fixed"), F.col("mass"))).alias("mass"), F.collect_list(F.when(F.col("fixed"), F.struct("at", "h"))).alias("constant"))
    by_host = by_slot.groupBy("host").agg(F.flatten(F.collect_list("constant")).alias("constant"), F.map_from_entries(F.collect_list(F.when(F.col("mass") > 0, F.struct("at", "mass")))).alias("masses"))
    return by_host.join(maybe_broadcast(hosts.select("host", "reference")), "host").select("host", "reference", "constant", "masses")


def region_of(tree: Tree, masses: dict[int, int]) -> int:
    """The smallest container that has all of the varying text, article and main elements being the smallest; boilerplate doesn't count."""
    own, bad = [0] * len(tree.labels), [False] * len(tree.labels)
    for k, x in enumerate(tree.labels):
        bad[k] = boilerplate(x) or (tree.parents[k] >= 0 and bad[tree.parents[k]])
        own[k] = 0 if bad[k] else masses.get(k, 0)
    for k in range(len(own) - 1, 0, -1):
        own[tree.parents[k]] += own[k]
    at = 0
    while tree.labels[at].split("[")[0] not in ("article", "main"):
        inner = [c for c in tree.children[at] if tree.labels[c].split("[")[0] not in LEAF and tree.children[c] and own[c] == own[at] and own[c]]
        if not inner:
            return at
        at = inner[0]
    return at


def main_text(html: str | None, reference: str | None = None, constant: set[tuple[int, int]] | None = None, masses: dict[int, int] | None = None) -> str:
    """The page's content blocks, joined by two line feeds."""
    if not html:
        return ""
    root, blocks = parse(html)
    if reference and masses:
        tree = fold(root)
        pairs = aligned(str(tree), reference)
        store = worker_cache().setdefault("regions", {})
        if reference not in store or store[reference][0] != masses:
            if len(store) > 2000:
                store.clear()
            store[reference] = (masses, region_of(Tree.of(reference), masses))
        region, fixed = store[reference][1], constant or set()
        inside = {k for k, r in pairs.items() if r == region}
    else:
        inside, fixed, pairs = set(), set(), {}

    def state(node: Node) -> tuple[bool, bool, bool]:
        """In the region; in an article; boilerplate."""
        there, article, bad = not inside, False, False
        x: Node | None = node
        heading = node.tag in ("h1", "h2", "h3")
        while x is not None:
            if x.slot >= 0 and x.slot in inside:
                there = True
            if x.tag in ("article", "main"):
                article = True
            if boilerplate(x.label):
                bad = bad or not (x.tag == "header" and heading and in_article(x) and not boilerplate("div" + x.label[6:]))
            x = x.parent
        return there, article, bad

    def in_article(x: Node | None) -> bool:
        while x is not None:
            if x.tag in ("article", "main"):
                return True
            x = x.parent
        return False

    known: dict[int, tuple[bool, bool, bool]] = {}
    judged = []
    for node, text in blocks:
        s = known.get(id(node))
        if s is None:
            s = known[id(node)] = state(node)
        judged.append((node, text, s))
    kept = [x for x in judged if not x[2][2]]
    if any(x[2][1] for x in kept):
        kept = [x for x in kept if x[2][1]]
    slots = [x for x in kept if x[2][0] and (pairs.get(x[0].slot), text_hash(x[1])) not in fixed]
    kept = slots or kept
    return "\n\n".join(x[1] for x in kept)


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", min_pages: int = 5) -> DataFrame:
    """page_id, url, text."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    wrappers = cut(induce_wrappers(src.select("host", "html"), min_pages))
    rows = src.join(maybe_broadcast(wrappers), "host", "left").select("page_id", "url", "html", "reference", "constant", "masses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (3, 4, 5)]
            out = [main_text(h.as_py(), r, {(x["at"], x["h"]) for x in c or ()}, dict(m or ())) for h, r, c, m in zip(batch.column(2), *columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
