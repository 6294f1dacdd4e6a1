"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page is parsed into a tree of blocks;
siblings with one label are one node, as lists and paragraphs vary in number.
The outlines of a host's pages are merged into one template by simple tree
matching (Yang, 1991), in a tree of bounded groups on the executors, and every
page is then matched to it: a node of a page is the node of the template that it
is aligned with, and what aligns with none is known by the labels on its path.
For every node the host's distinct pages that have it are counted, and those that
hold each of its texts. Nodes whose text stays the same are template, nodes
whose text varies are slots. Slots are content unless they lie in parts that
pages mark as something else (navigation, header, footer, aside, forms,
adverts, notices, comments: by tag, role, class or id) or that are mostly links
on the host's pages; if sibling articles (or main parts) hold most of a page's
varying text, only they are content; constant text inside the content is
dropped as well, but never most of a page, since a host may repeat an article.

All distinct pages are counted whole: a task sends one row of hashes a page,
equal pages are taken once, and (host, path, text) is counted with partial
sums, so that a host with a third of all pages is no one task's work. Kept are
the texts and paths of links that reach MIN_PAGES and the shares, which are few
a host. ``Template`` and ``merge`` are the same counts for pages in memory.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm.common import materialize, read_table

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object select".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody "
                   "td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl div section article body main aside nav".split())
ASIDE_TAGS = frozenset("nav header footer aside form menu button dialog head fieldset".split())
ROOTS = ("article", "main")
#: Words in class, id and role that name parts that are no content.
ASIDE_WORDS = frozenset("ad ads advert advertisement advertising adsense banner sponsor sponsored promo nav navbar navigation menu "
                        "breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent notice alert popup modal "
                        "overlay newsletter subscribe signup login share sharing social related recommended comment comments "
                        "commentlist disqus reply replies respond widget toolbar pagination pager search contentinfo complementary".split())
#: Pages that make a text a template's, and their share of the pages that have its path.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: Nodes of a host's template; those that fewer outlines have are known by their labels.
MAX_NODES = 2000
#: Outlines that are merged in one group.
FAN_IN = 16
#: Alignments of an outline with a template that a task remembers.
MEMO_OUTLINES = 2000
#: Most of a page's content that template text may be, and link share that makes a slot navigation.
MAX_DROPPED, LINK_SHARE = 0.25, 0.8
#: Bytes of all wrappers up to which they are broadcast.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S | re.X)
_UNFINISHED = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
_LABEL = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


#: Beginnings of class names that say what a page has or lacks, not what a part is.
_MODIFIER = re.compile(r"(?:^|[\s_])(?:has|no|with|without|is|not)[-_]\S*")
#: Labels are no evidence about these elements, nor about what holds a root.
NEVER_ASIDE = frozenset(("html", "body", *ROOTS))


class Node:
    """An element with block children and texts, in page order."""
    __slots__ = ("tag", "key", "aside", "kids")

    def __init__(self, tag: str, key: str, aside: bool):
        self.tag, self.key, self.aside = tag, key, aside
        self.kids: list = []  # Node or (text, is_link)


def _named(attrs: str) -> tuple[str, set[str]]:
    """(class and id as a label, their words)."""
    parts, words = [], set()
    for name, *values in _LABEL.findall(attrs):
        value = "".join(values).lower()
        words.update(_WORD.findall(_MODIFIER.sub(" ", value)))
        if name.lower() != "id":
            parts.append(re.sub(r"\d+", "#", value))
    return " ".join(parts), words


def parse(text: str) -> Node:
    """The tree of a page. Inline elements dissolve into the texts around
    them; what HTML lets authors leave out is closed as browsers do it."""
    root = Node("#root", "#root", False)
    stack = [root]
    opened: list[str] = []  # names of open elements, inline ones included
    count: dict[str, int] = {}  # how many of each name are open
    doubtful: list[Node] = []  # aside by a label, or a form
    blocks: list[Node | None] = []
    links, at = 0, 0

    def put(raw: str) -> None:
        if raw:
            stack[-1].kids.append((html_lib.unescape(raw) if "&" in raw else raw, links > 0))

    def pop_to(i: int) -> None:
        nonlocal links
        while len(opened) > i:
            name = opened.pop()
            count[name] -= 1
            if name == "a":
                links -= 1
            if blocks.pop() is not None:
                stack.pop()

    def last(name: str) -> int:
        i = len(opened) - 1
        while opened[i] != name:
            i -= 1
        return i

    for m in iter(lambda: _TOKEN.search(text, at), None):
        put(text[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                put(html_lib.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if m["end"]:
            if count.get(tag):
                pop_to(last(tag))
            elif tag == "p":
                put(" ")
            continue
        if tag in RAW:
            if not m["attrs"].endswith("/") or tag in ("script", "style"):
                close = re.compile(r"</" + re.escape(tag) + r"(?=[\s/>]|\Z)[^>]*>?", re.I).search(text, at)
                at = close.end() if close else len(text)
            continue
        if tag in BLOCKS and count.get("p"):
            i = last("p")
            if not any(o in ("button", "td", "th") for o in opened[i:]):
                pop_to(i)
        if tag in CLOSES and any(count.get(x) for x in CLOSES[tag]):
            for i in range(len(opened) - 1, -1, -1):
                if opened[i] in CLOSES[tag]:
                    pop_to(i)
                    break
                if opened[i] in SCOPES:
                    break
        if tag in VOID:
            put(" ")
            continue
        if tag in BLOCKS or tag == "button":
            label, words = _named(m["attrs"]) if m["attrs"] else ("", set())
            labelled = bool(words & ASIDE_WORDS) and tag not in NEVER_ASIDE
            node = Node(tag, f"{tag}.{label}" if label else tag, tag in ASIDE_TAGS or labelled)
            if tag == "form" or labelled and tag not in ASIDE_TAGS:
                doubtful.append(node)
            stack[-1].kids.append(node)
            stack.append(node)
            blocks.append(node)
        else:
            blocks.append(None)
            links += tag == "a"
        opened.append(tag)
        count[tag] = count.get(tag, 0) + 1
    put(_UNFINISHED.sub("", text[at:]))
    if doubtful:
        _acquit(root, doubtful)
    return root


def _acquit(root: Node, doubtful: list[Node]) -> None:
    """A part that holds a main part or an article is no aside, nor is a form
    that holds most of the page's text."""
    sizes: dict[int, tuple[int, bool]] = {}
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node)]
    for node in reversed(order):
        size, holds = 0, node.tag in ROOTS
        for k in node.kids:
            if isinstance(k, Node):
                n, inner = sizes[id(k)]
                size, holds = size + n, holds or inner
            else:
                size += len(k[0].strip())
        sizes[id(node)] = size, holds
    whole = sizes[id(root)][0]
    for node in doubtful:
        size, holds = sizes[id(node)]
        if holds or node.tag == "form" and 2 * size > whole:
            node.aside = False


def lines(node: Node):
    """The node's own blocks of text, as (text, link share), where children
    part them; children are not entered."""
    run: list[tuple[str, bool]] = []
    for k in [*node.kids, None]:
        if isinstance(k, tuple):
            run.append(k)
            continue
        if run:
            text = " ".join("".join(t for t, _ in run).split())
            if text:
                total = sum(len(t.strip()) for t, _ in run)
                yield text, sum(len(t.strip()) for t, linked in run if linked) / max(1, total)
            run = []
        if k is not None:
            yield k


# ------------------------------------------------------------------- templates
def fingerprint(text: str) -> int:
    raw = text.encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


#: Hashes of paths that a task remembers.
MEMO_PATHS = 100_000
_PATHS: dict[tuple[int, str], int] = {}


def path_of(parent: int, key: str) -> int:
    """A 64-bit hash of the labels from the root to a node."""
    path = _PATHS.get((parent, key))
    if path is None:
        if len(_PATHS) >= MEMO_PATHS:
            _PATHS.clear()
        path = _PATHS[parent, key] = fingerprint(f"{parent} {key}")
    return path


@dataclass
class Wrapper:
    """What a host's pages have in common: paths that are mostly links, and
    template texts as path ^ fingerprint."""
    links: set[int] = field(default_factory=set)
    texts: set[int] = field(default_factory=set)

    @classmethod
    def of_tree(cls, tree: "Template") -> "Wrapper":
        w = cls()
        stack = [(tree, path_of(0, tree.key))]
        while stack:
            t, path = stack.pop()
            if t.pages >= MIN_PAGES:
                if t.linked > LINK_SHARE * max(1, t.chars):
                    w.links.add(path)
                w.texts.update(path ^ x for x, n in t.texts.items() if n >= max(MIN_PAGES, MIN_SHARE * t.pages))
            stack += [(k, path_of(path, k.key)) for k in t.kids]
        return w

    def packed(self) -> bytes:
        return np.array([len(self.links), *sorted(self.links), *sorted(self.texts)], np.int64).tobytes()

    @classmethod
    def of_bytes(cls, raw: bytes) -> "Wrapper":
        n, *hashes = np.frombuffer(raw, np.int64).tolist()
        return cls(set(hashes[:n]), set(hashes[n:]))


class Template:
    """A node of a host's tree: pages that have it, its texts by the number of
    pages, shares of links, children in order."""
    __slots__ = ("key", "pages", "texts", "chars", "linked", "kids")

    def __init__(self, key: str):
        self.key, self.pages, self.chars, self.linked = key, 0, 0, 0
        self.texts: dict[int, int] = {}
        self.kids: list[Template] = []

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)

    def to_list(self) -> list:
        return [self.key, self.pages, self.chars, self.linked, list(self.texts.items()), [k.to_list() for k in self.kids]]

    @classmethod
    def of_list(cls, x: list) -> "Template":
        t = cls(x[0])
        t.pages, t.chars, t.linked = x[1:4]
        t.texts = {int(a): b for a, b in x[4]}
        t.kids = [cls.of_list(k) for k in x[5]]
        return t


def skeleton(node: Node, depth: int = 0) -> Template:
    """A page as a tree of its own: siblings with one label are one node, as
    lists and paragraphs vary in number."""
    t = Template(node.key)
    t.pages = 1
    by_key: dict[str, Template] = {}
    for item in lines(node):
        if isinstance(item, Node):
            kid = skeleton(item, depth + 1) if depth < 60 else Template(item.key)
            same = by_key.get(kid.key)
            if same is None:
                by_key[kid.key] = kid
                t.kids.append(kid)
            else:
                _add(same, kid, pages=False)
        else:
            text, share = item
            t.texts[fingerprint(text)] = 1
            t.chars += len(text)
            t.linked += round(share * len(text))
    return t


def match(a: Template, b: Template) -> tuple[int, list]:
    """Simple tree matching: (matched nodes, aligned pairs of children)."""
    if a.key != b.key:
        return 0, []
    m, n = len(a.kids), len(b.kids)
    if not m or not n:
        return 1, []
    score = [[0] * (n + 1) for _ in range(m + 1)]
    pairs = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            w, inner = match(a.kids[i - 1], b.kids[j - 1])
            if w:
                pairs[i, j] = (w, inner)
            score[i][j] = max(score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + w)
    out, i, j = [], m, n
    while i and j:
        w, inner = pairs.get((i, j), (0, []))
        if w and score[i][j] == score[i - 1][j - 1] + w:
            out.append((i - 1, j - 1, inner))
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + score[m][n], out[::-1]


def _add(a: Template, b: Template, pages: bool = True, aligned: list | None = None) -> None:
    """Merge b into a; what does not align is inserted at its place."""
    if pages:
        a.pages += b.pages
    for t, n in b.texts.items():
        a.texts[t] = a.texts.get(t, 0) + n if pages else 1
    a.chars += b.chars
    a.linked += b.linked
    if aligned is None:
        aligned = match(a, b)[1]
    kids, i, j = [], 0, 0
    for x, y, inner in [*aligned, (len(a.kids), len(b.kids), None)]:
        kids += a.kids[i:x] + b.kids[j:y]
        if inner is not None:
            _add(a.kids[x], b.kids[y], pages, inner)
            kids.append(a.kids[x])
        i, j = x + 1, y + 1
    a.kids = kids


def merge(a: Template, b: Template) -> Template:
    _add(a, b)
    least = 1
    while a.size() > MAX_NODES:
        least += 1
        _prune(a, least)
    return a


def _prune(t: Template, least: int) -> None:
    t.kids = [k for k in t.kids if k.pages >= least]
    for k in t.kids:
        _prune(k, least)


# -------------------------------------------------------------------- alignment
def outline(root: Node) -> Template:
    """The page's nodes without their texts, labelled parts left out; a tree
    of at most 60 levels and MAX_NODES nodes, all others are known by their labels."""
    top = Template(root.key)
    top.pages = made = 1
    stack = [(root, top, {}, 0)]
    while stack:
        node, t, by_key, depth = stack.pop()
        below = []
        for k in node.kids:
            if isinstance(k, Node) and not k.aside and depth < 60 and (k.key in by_key or made < MAX_NODES):
                if k.key not in by_key:
                    kid = Template(k.key)
                    kid.pages, made = 1, made + 1
                    by_key[k.key] = kid, {}
                    t.kids.append(kid)
                below.append((k, *by_key[k.key], depth + 1))
        stack += below[::-1]
    return top


def packed_outline(t: Template) -> str:
    return json.dumps(t.to_list(), ensure_ascii=False, separators=(",", ":"))


def align(template: Template, page: Template) -> dict[int, int]:
    """The label paths of a page's nodes that are other nodes of the template
    than the first of their labels, by simple tree matching."""
    out: dict[int, int] = {}
    at = path_of(0, page.key)
    stack = [(template, page, match(template, page)[1], at, at)]
    while stack:
        a, b, pairs, path, node = stack.pop()
        with_b = {j: (i, inner) for i, j, inner in pairs}
        keys = [k.key for k in a.kids] if a is not None else []
        for j, kid in enumerate(b.kids):
            below = path_of(path, kid.key)
            if j in with_b:
                i, inner = with_b[j]
                nth = keys[:i].count(kid.key)
                own = path_of(node, kid.key if not nth else f"{kid.key} {nth + 1}")
                stack.append((a.kids[i], kid, inner, below, own))
            else:  # a node of its own, where the template has others of the label
                own = path_of(node, f"{kid.key} -" if kid.key in keys else kid.key)
                stack.append((None, kid, [], below, own))
            if own != below:
                out[below] = own
    return out


class Aligner:
    """Alignments with packed templates, remembered by outline."""

    def __init__(self):
        self.templates: dict[str, Template] = {}
        self.known: dict[tuple[str, str], dict[int, int]] = {}

    def of(self, root: Node, packed: str | None) -> dict[int, int]:
        if packed is None:
            return {}
        page = outline(root)
        key = packed, packed_outline(page)
        if key not in self.known:
            if len(self.known) >= MEMO_OUTLINES:
                self.known.clear()
            if packed not in self.templates:
                if len(self.templates) > 500:
                    self.templates.clear()
                self.templates[packed] = Template.of_list(json.loads(packed))
            self.known[key] = align(self.templates[packed], page)
        return self.known[key]


# -------------------------------------------------------------------- extraction
def blocks_of(root: Node, aligned: dict[int, int] | None = None):
    """(node, text, link share, groups of ROOTS it lies in) in page order, of
    all that is no labelled part; (node, None, 0.0, groups) where a node begins.
    ``aligned`` has the nodes that are not the hash of their label path."""
    at, aligned = path_of(0, root.key), aligned or {}
    yield at, None, 0.0, {}
    open_nodes = [(lines(root), root, at, {})]  # a stack of its own: pages nest without bound
    while open_nodes:
        items, node, at, groups = open_nodes[-1]
        item = next(items, None)
        if item is None:
            open_nodes.pop()
        elif not isinstance(item, Node):
            yield aligned.get(at, at), *item, groups
        elif not item.aside:
            inner = {**groups, item.tag: id(node)} if item.tag in ROOTS and item.tag not in groups else groups
            path = path_of(at, item.key)
            yield aligned.get(path, path), None, 0.0, inner
            open_nodes.append((lines(item), item, path, inner))


def extract(root: Node, wrapper: Wrapper | Template | None, aligned: dict[int, int] | None = None) -> str:
    """Main text of a page under its host's wrapper (None: by labels alone)."""
    if isinstance(wrapper, Template):
        wrapper = Wrapper.of_tree(wrapper)
    w = wrapper or Wrapper()
    found = [(text, (path ^ fingerprint(text)) in w.texts, groups) for path, text, share, groups in blocks_of(root, aligned)
             if text is not None and not (share > LINK_SHARE and path in w.links)]
    found = _content(found)
    total = sum(len(t) for t, _ in found)
    if sum(len(t) for t, c in found if c) <= MAX_DROPPED * total:
        found = [(t, c) for t, c in found if not c]
    return "\n".join(t for t, _ in found)


def _content(found: list[tuple[str, bool, dict]]) -> list[tuple[str, bool]]:
    """The texts in sibling articles that together hold most of the page's
    varying text, else those in such main parts, else all."""
    varying = [x for x in found if not x[1]] or found
    for tag in ROOTS:
        sizes: dict[int, int] = {}
        for text, _, groups in varying:
            if tag in groups:
                sizes[groups[tag]] = sizes.get(groups[tag], 0) + len(text)
        best = max(sizes, key=sizes.get, default=None)
        if best is not None and 2 * sizes[best] > sum(len(t) for t, _, _ in varying):
            return [(t, c) for t, c, groups in found if groups.get(tag) == best]
    return [(t, c) for t, c, _ in found]


# --------------------------------------------------------------------- DataFrames
def host_of(url):
    """Host of an address; NULL and addresses without a host share ''."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _facts(root: Node, aligned: dict[int, int] | None = None) -> tuple[list, list, list, list]:
    """Paths of a page (text None) and their texts, each once, with letters and
    linked letters of a path: (path, text, chars, linked) as columns."""
    sums: dict[int, list[int]] = {}
    texts: dict[tuple[int, int], None] = {}
    for path, text, share, _ in blocks_of(root, aligned):
        if text is None:
            sums.setdefault(path, [0, 0])
            continue
        sums[path][0] += len(text)
        sums[path][1] += round(share * len(text))
        texts[path, fingerprint(text)] = None
    none = [0] * len(texts)
    return ([*sums, *(p for p, _ in texts)], [*([None] * len(sums)), *(t for _, t in texts)],
            [*(c for c, _ in sums.values()), *none], [*(c for _, c in sums.values()), *none])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) from all rows (host, html): the outlines of a host's
    pages, each once, merged by simple tree matching. A group has about FAN_IN
    outlines or merged trees, whatever the number of pages."""
    def run(batches):
        for batch in batches:
            found = {(h, packed_outline(outline(parse(t)))) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t}
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())],
                                             names=["host", "template"])

    trees = materialize(pages.select("host", "html").mapInArrow(run, "host string, template string").distinct().withColumn("k", F.xxhash64("template")), "html-outlines")
    most = trees.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0

    def together(rows: pa.Table) -> pa.Table:
        packed = sorted(zip(rows.column("k").to_pylist(), rows.column("template").to_pylist()))
        tree = Template.of_list(json.loads(packed[0][1]))
        for _, t in packed[1:]:
            merge(tree, Template.of_list(json.loads(t)))
        return pa.table({"host": rows.column("host")[:1], "template": [packed_outline(tree)], "k": pa.array([packed[0][0]], pa.int64())})

    groups = 1
    while groups * FAN_IN < most:
        groups *= FAN_IN
    while True:
        grouped = trees.withColumn("part", F.pmod(F.col("k"), F.lit(groups)))
        trees = grouped.groupBy("host", "part").applyInArrow(together, "host string, template string, k long")
        if groups == 1:
            return trees.select("host", "template")
        groups //= FAN_IN


def with_templates(rows: DataFrame, side: DataFrame, name: str, broadcast_bytes: int) -> DataFrame:
    """``rows`` with their host's row of ``side``."""
    size = side.agg(F.coalesce(F.sum(F.length(name) + F.length("host")), F.lit(0)).alias("b")).first()["b"]
    return rows.join(F.broadcast(side) if size <= broadcast_bytes else side, "host", "left")


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all rows (host, html) and their hosts' templates,
    which are made where the column is missing. Equal pages of a host count once,
    whichever tasks read them; hosts without template have no row."""
    if "template" not in pages.columns:
        pages = with_templates(pages, materialize(templates(pages), "html-templates"), "template", BROADCAST_BYTES)

    def run(batches):
        aligner = Aligner()
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                page, ends, columns = [], [0], ([], [], [], [])
                for text, template in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                    page.append(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest())
                    root = parse(text)
                    for column, new in zip(columns, _facts(root, aligner.of(root, template))):
                        column += new
                    ends.append(len(columns[0]))
                items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["path", "text", "chars", "linked"])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(page, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)],
                                                 names=["host", "page", "items"])

    sent = pages.select("host", "html", "template").mapInArrow(run, "host string, page binary, items array<struct<path: long, text: long, chars: long, linked: long>>")
    items = sent.dropDuplicates(["host", "page"]).select("host", F.inline("items"))
    counted = items.groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    often = materialize(counted.where(F.col("pages") >= MIN_PAGES), "html-counts")
    paths = often.where(F.col("text").isNull())
    links = paths.where(F.col("linked") > F.lit(LINK_SHARE) * F.greatest(F.lit(1), F.col("chars"))).select(
        "host", F.col("path").alias("link"), F.lit(None).cast("long").alias("text"))
    texts = often.where(F.col("text").isNotNull()).select("host", "path", "text", "pages").join(
        paths.select("host", "path", F.col("pages").alias("of")), ["host", "path"]).where(F.col("pages") >= F.lit(MIN_SHARE) * F.col("of"))
    both = links.unionByName(texts.select("host", F.lit(None).cast("long").alias("link"), F.col("path").bitwiseXOR(F.col("text")).alias("text")))
    # a row a host: its template's texts are at most 1 / MIN_SHARE times those of a page
    grouped = both.groupBy("host").agg(F.collect_set("link").alias("links"), F.collect_set("text").alias("texts"))

    def pack(batches):
        for batch in batches:
            raw = [Wrapper(set(a), set(b)).packed() for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["host", "wrapper"])

    return grouped.mapInArrow(pack, "host string, wrapper binary")


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: page_id, url, text (empty if the page has none) and n_chars. A
    NULL html is an empty page; a NULL url has the host ''; repeated rows give
    repeated results; other columns are not read."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        host_of(F.col(url).cast("string")).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    trees = materialize(templates(rows.select("host", "html")), "html-templates")
    known_hosts = with_templates(rows, trees, "template", broadcast_bytes)
    wrappers = materialize(induce(known_hosts.select("host", "html", "template")), "html-wrappers")
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches):
        known: dict[bytes, Wrapper] = {}
        aligner = Aligner()
        for batch in batches:
            out = []
            for text, raw, template in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                if raw is not None and raw not in known:
                    if len(known) > 500:
                        known.clear()
                    known[raw] = Wrapper.of_bytes(raw)
                root = parse(text)
                out.append(extract(root, known.get(raw), aligner.of(root, template) if raw is not None else None) if text else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    joined = with_templates(known_hosts, wrappers, "wrapper", broadcast_bytes).select("page_id", "url", "html", "wrapper", "template")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
