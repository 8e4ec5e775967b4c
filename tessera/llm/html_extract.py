"""Operator 8, main text of HTML pages by wrapper induction.

Pages of one host share a template.  A page's tree of block elements, runs of
like siblings folded, is its skeleton.  For each host the most frequent
skeleton is the reference; every other skeleton is aligned to it by simple tree
matching (equal roots, then the heaviest common subsequence of the children).
Over all pages of the host each aligned node is constant (one text on all
pages: template) or varying (a slot).  The content root is the deepest
container that holds all slot text outside menus, headers, footers, sidebars,
notices, adverts, forms and comments.  A page's text is the blocks below its
content root, and those of its other nodes that the reference doesn't have.
Nothing below the content root is dropped for being constant, but for a header
element.

Furniture is told by tag, role, class and id.  Names count as wholes, not their
parts ("sidebar", not "with-sidebar").  Inside an article or main element only
names that mean nothing else (adverts, comments, cookie notices) count.

Copies of a page count once.  Counts are kept by host, hash of the skeleton and
node and are merged by aggregates, so a host with most of the pages meets no
single task; a skeleton is kept and aligned once for each host that has it.

A null or empty page has an empty text.  Pages without a host (null or broken
url) form one host.  Hosts with one page, and pages that don't align, fall back
to an article or main element, then to the body.  Of skeletons that are equally
frequent the greatest hash is the reference.  Broken markup closes itself; very
long and deeply nested pages are read whole, in time and memory that grow with
their length; repeated rows repeat; other columns, of any name, are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import steps
from tessera.llm.common import materialize

#: Share of the host's different pages that must have a node for it to be template.
TEMPLATE_SHARE = 0.9
#: Different pages on which a text must be the same to be template.
CONSTANT_PAGES = 3
#: Alignments that a task holds.
HELD_GROUPS = 2_000
#: Wrappers are broadcast up to this many characters of skeletons; beyond that the join shuffles.
BROADCAST_CHARS = 16 << 20

# Element sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul head title button".split()
)
CLOSES_P = BLOCK - frozenset("html head title body option td th tr tbody thead tfoot legend summary button select li dd dt".split()) | frozenset(["li", "dd", "dt"])
CONTAINERS = frozenset("html body div article main section center table tbody tr td #root".split())
DROPPED_TAGS = frozenset("head title header nav footer aside form button select option dialog menu search fieldset noscript template iframe object svg canvas math audio video".split())
# Class, id and role names of page furniture.
DROPPED_NAMES = frozenset(
    "nav navbar navigation menu sidebar aside ad ads advert adverts advertisement sponsored promo banner cookie cookies consent notice popup modal "
    "footer header masthead breadcrumb breadcrumbs pagination share sharing social comment comments disqus related newsletter subscribe signup login "
    "search toolbar widget complementary contentinfo".split()
)
# Those that mean nothing else inside an article.
DROPPED_INSIDE = frozenset("navbar ad ads advert adverts advertisement sponsored cookie cookies comment comments disqus newsletter complementary contentinfo".split())
# What may stand before or after such a name.
_NAME = re.compile(r"(?:site|page|main|top|bottom|left|right|global|user|reader|cookie)?[-_]?([a-z]+?)[-_]?(?:bar|box|area|wrapper|container|section|list|notice|banner)?")
KEPT_TAGS = frozenset("html body article main".split())

_RAW = r"script|style|noscript|template|textarea|xmp"
_FOREIGN = r"iframe|svg|math|canvas"  # these may close themselves
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<foreign>{_FOREIGN})\b(?:[^>]*[^>/])?>.*?(?:</(?P=foreign)\s*>|\Z)"
    rf"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _is_furniture(name: str, names: frozenset[str]) -> bool:
    if name in names:
        return True
    part = _NAME.fullmatch(name)
    return part is not None and part[1] in names


@lru_cache(maxsize=20_000)
def label_of(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """A node's label, and whether it is page furniture outside and inside an article."""
    names: list[str] = []
    for _, a, b, c in _ATTR.findall(attrs):
        names += (a or b or c).lower().split()
    outside = tag in DROPPED_TAGS or tag not in KEPT_TAGS and any(_is_furniture(n, DROPPED_NAMES) for n in names)
    inside = tag in DROPPED_TAGS or tag not in KEPT_TAGS and any(_is_furniture(n, DROPPED_INSIDE) for n in names)
    return ".".join([tag, *(re.sub(r"[^a-z]+", "-", n) for n in names)]), outside, inside


class Page:
    """Block elements of a page in order, and its blocks of text with their elements."""

    __slots__ = ("labels", "tags", "parents", "children", "dropped", "blocks", "node_of", "nodes", "furniture")

    def __init__(self, html: str):
        self.labels, self.tags, self.parents, self.children, self.dropped = ["#root"], ["#root"], [-1], [[]], [False]
        self.blocks: list[tuple[int, str]] = []
        self._parse(html)
        self._fold()

    def _parse(self, html: str) -> None:
        stack, text, last = [0], [], 0
        articles = [False]  # is the element in an article or main element?
        loose: list[int] = []  # headers inside a container that may be an article's

        def flush() -> None:
            if text:
                block = " ".join(unescape("".join(text)).split())
                if block:
                    self.blocks.append((stack[-1], block))
                text.clear()

        for m in _TOKEN.finditer(html):
            if m.start() > last:
                text.append(html[last : m.start()])
            last = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in BLOCK:
                if tag == "br":
                    text.append(" ")
                continue
            flush()
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        del stack[k:]
                        break
                    if self.tags[stack[k]] in ("article", "main", "body") and tag in ("p", "li", "div", "section"):
                        break  # a stray end tag doesn't close the article
                continue
            if tag in CLOSES_P and self.tags[stack[-1]] == "p":
                stack.pop()
            if tag in ("li", "option", "tr", "td", "th", "dd", "dt") and self.tags[stack[-1]] == tag:
                stack.pop()
            if tag in VOID:
                continue
            label, outside, inside = label_of(tag, m["attrs"] or "")
            top = stack[-1]
            dropped = inside if articles[top] else outside
            if tag == "header" and articles[top]:
                dropped = False  # the article's own title
            elif tag == "header" and self.tags[top] in ("div", "section"):
                dropped = False
                loose.append(len(self.labels))
            self.labels.append(label)
            self.tags.append(tag)
            self.parents.append(top)
            self.children.append([])
            self.dropped.append(dropped or self.dropped[top])
            self.children[top].append(len(self.labels) - 1)
            articles.append(articles[top] or tag in ("article", "main"))
            stack.append(len(self.labels) - 1)
        if last < len(html):
            text.append(html[last:])
        flush()
        self._settle(loose)

    def _settle(self, headers: list[int]) -> None:
        """A header inside a container is content if it has a title of the first rank, else furniture."""
        if not headers:
            return
        titled = [t == "h1" for t in self.tags]
        for k in range(len(self.tags) - 1, 0, -1):
            titled[self.parents[k]] = titled[self.parents[k]] or titled[k]
        for k in headers:
            self.dropped[k] = self.dropped[k] or not titled[k]
        for k in range(1, len(self.tags)):
            self.dropped[k] = self.dropped[k] or self.dropped[self.parents[k]]

    def _fold(self) -> None:
        """``nodes``: (label, children) of the skeleton in preorder; ``node_of``: each element's node."""
        shapes: dict[tuple, int] = {}  # each different subtree has a number
        shape = [0] * len(self.labels)
        for k in range(len(self.labels) - 1, -1, -1):
            inner: list[int] = []
            for c in self.children[k]:
                if not inner or inner[-1] != shape[c]:
                    inner.append(shape[c])
            shape[k] = shapes.setdefault((self.labels[k], *inner), len(shapes))
        self.node_of = [-1] * len(self.labels)
        self.nodes: list[list] = [["#root", []]]  # a node comes after its parent
        self.furniture: list[bool] = [False]
        self.node_of[0] = 0
        todo = [(0, [0])]  # a node and the elements folded into it
        while todo:
            node, elements = todo.pop()
            if len(elements) > 1:  # folded elements have one shape: walk them in step
                columns = list(zip(*(self._runs(e, shape) for e in elements)))
                groups = [[x for part in column for x in part] for column in columns]
            else:
                groups = self._runs(elements[0], shape)
            for group in groups:
                self.nodes.append([self.labels[group[0]], []])
                self.furniture.append(self.dropped[group[0]])
                child = len(self.nodes) - 1
                self.nodes[node][1].append(child)
                for e in group:
                    self.node_of[e] = child
                todo.append((child, group))

    def _runs(self, element: int, shape: list[int]) -> list[list[int]]:
        runs: list[list[int]] = []
        for c in self.children[element]:
            if runs and shape[runs[-1][0]] == shape[c]:
                runs[-1].append(c)
            else:
                runs.append([c])
        return runs

    def skeleton(self) -> str:
        """Labels, children and furniture marks of the nodes."""
        return json.dumps([[label, inner, int(f)] for (label, inner), f in zip(self.nodes, self.furniture)], separators=(",", ":"))

    def node_texts(self) -> dict[int, list]:
        """For each skeleton node: checksum and characters of the text that it holds itself."""
        out: dict[int, list] = {}
        for element, text in self.blocks:
            node = self.node_of[element]
            if node >= 0:
                held = out.setdefault(node, [0, 0])
                held[0] = zlib.crc32(text.encode("utf-8", "replace"), held[0])
                held[1] += len(text)
        return out


def _numbered(nodes: list, numbers: dict[tuple, int]) -> list[int]:
    """A number for each node's subtree; equal subtrees of all pages that share ``numbers`` have one."""
    out = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        out[k] = numbers.setdefault((nodes[k][0], *(out[c] for c in nodes[k][1])), len(numbers))
    return out


def align(a: list, b: list) -> dict[int, int]:
    """Simple tree matching of two skeletons: nodes of a to nodes of b.

    Equal first and last subtrees of two nodes are matched at once, which no
    heavier matching beats; the rest goes through the table of common
    subsequences.  A stack of its own walks trees of any depth.
    """
    numbers: dict[tuple, int] = {}
    na, nb = _numbered(a, numbers), _numbered(b, numbers)
    size = [1] * len(a)
    for k in range(len(a) - 1, -1, -1):
        size[k] += sum(size[c] for c in a[k][1])
    memo: dict[tuple[int, int], tuple[int, list]] = {}
    todo = [(0, 0)] if a[0][0] == b[0][0] else []
    while todo:
        i, j = todo[-1]
        if (i, j) in memo:
            todo.pop()
            continue
        x, y = a[i][1], b[j][1]
        if na[i] == nb[j]:
            memo[i, j] = size[i], list(zip(x, y))
            todo.pop()
            for pair in zip(x, y):
                if pair not in memo:
                    todo.append(pair)
            continue
        head = 0
        while head < min(len(x), len(y)) and na[x[head]] == nb[y[head]]:
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and na[x[-1 - tail]] == nb[y[-1 - tail]]:
            tail += 1
        same = [*zip(x[:head], y[:head]), *zip(x[len(x) - tail :], y[len(y) - tail :])]
        p, q = x[head : len(x) - tail], y[head : len(y) - tail]
        missing = [(u, v) for u, v in [*same, *((u, v) for u in p for v in q)] if a[u][0] == b[v][0] and (u, v) not in memo]
        if missing:
            todo += missing
            continue
        todo.pop()
        weight, pairs = _heaviest(p, q, lambda u, v: memo[u, v][0] if a[u][0] == b[v][0] else 0)
        memo[i, j] = 1 + weight + sum(memo[s][0] for s in same), same + pairs
    out, walk = {}, [(0, 0)] if memo else []
    while walk:
        i, j = walk.pop()
        out[i] = j
        walk += memo[i, j][1]
    return out


def _heaviest(x: list[int], y: list[int], weight) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest common subsequence: its weight and its pairs."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p, u in enumerate(x, 1):
        for q, v in enumerate(y, 1):
            w = weight(u, v)
            best[p][q] = max(best[p - 1][q], best[p][q - 1], best[p - 1][q - 1] + w if w else 0)
    pairs, p, q = [], len(x), len(y)
    while p and q:
        w = weight(x[p - 1], y[q - 1])
        if w and best[p][q] == best[p - 1][q - 1] + w:
            pairs.append((x[p - 1], y[q - 1]))
            p, q = p - 1, q - 1
        elif best[p][q] == best[p - 1][q]:
            p -= 1
        else:
            q -= 1
    return best[-1][-1], pairs


def wrapper_of(nodes: list, stats: dict[int, tuple[int, int, int, int]], total: int) -> tuple[int, list[int]]:
    """Content root and template headers, from (pages, least and greatest checksum, characters) of each node and the host's pages."""
    dropped = [bool(f) for _, _, f in nodes]
    same = lambda i: i in stats and stats[i][0] >= max(CONSTANT_PAGES, TEMPLATE_SHARE * total) and stats[i][1] == stats[i][2]
    mass = [0 if dropped[i] or i not in stats or same(i) else stats[i][3] for i in range(len(nodes))]
    if not sum(mass):
        mass = [0 if dropped[i] or i not in stats else stats[i][3] for i in range(len(nodes))]
    below = list(mass)
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        below[i] += sum(below[c] for c in nodes[i][1])
    root = 0
    while sum(mass):
        deeper = [c for c in nodes[root][1] if nodes[c][0].split(".")[0] in CONTAINERS and below[c] == below[0]]
        if not deeper:
            break
        root = deeper[0]
    headers: list[int] = []
    for i, (label, inner, _) in enumerate(nodes):
        if label.split(".")[0] == "header" and i in stats and same(i):
            headers.append(i)
    return root, headers


def main_text(page: Page, root: int | None, template: set[int], aligned: set[int] = frozenset()) -> str:
    """The blocks below a skeleton node and of nodes that aren't aligned, without furniture and template."""
    if root is None:
        named = [t in ("article", "main") and not d for t, d in zip(page.tags, page.dropped)]
        tops = {k for k, n in enumerate(named) if n} or {0}
    else:
        tops = {k for k, n in enumerate(page.node_of) if n == root or n not in aligned}
    inside = [False] * len(page.labels)
    for k in range(len(page.labels)):
        inside[k] = k in tops or page.parents[k] >= 0 and inside[page.parents[k]]
    return "\n".join(text for e, text in page.blocks if inside[e] and not page.dropped[e] and page.node_of[e] not in template)


# ---------------------------------------------------------------- over tables

_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), _HOST, 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def _code(skeleton: str) -> str:
    return hashlib.md5(skeleton.encode()).hexdigest()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, hash of the skeleton, hash of the page's texts, the skeleton where this task first meets it, and each text node's checksum and characters.

    Node -1 stands for the page.
    """
    kind = pa.list_(pa.struct([("node", pa.int32()), ("least", pa.int64()), ("chars", pa.int64())]))
    seen: set[tuple[str, str]] = set()
    for part in steps(batches, "html"):
        hosts = part.column(0).to_pylist()
        codes, hashes, skeletons, nodes = [], [], [], []
        for host, html in zip(hosts, part.column(1).to_pylist()):
            page = Page(html)
            skeleton = page.skeleton()
            code, texts = _code(skeleton), sorted(page.node_texts().items())
            new = (host, code) not in seen
            if new:
                if len(seen) > HELD_GROUPS:
                    seen.clear()
                seen.add((host, code))
            codes.append(code)
            skeletons.append(skeleton if new else None)
            hashes.append(hashlib.md5(json.dumps([code, texts]).encode()).hexdigest())
            nodes.append([{"node": -1, "least": 0, "chars": 0}, *({"node": n, "least": check, "chars": chars} for n, (check, chars) in texts)])
        columns = [part.column(0), *(pa.array(c, pa.string()) for c in (codes, hashes, skeletons)), pa.array(nodes, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "code", "page", "skeleton", "nodes"])


def _merge(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(c) for c, f in (("pages", F.sum), ("least", F.min), ("most", F.max), ("chars", F.sum))])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each skeleton of a host its nodes and the reference's nodes that they are aligned to."""
    for batch in batches:
        for host, code, skeleton, reference in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = json.loads(skeleton), json.loads(reference)
            pairs = list(align(a, b).items()) if skeleton != reference else [(i, i) for i in range(len(a))]
            mine, its = zip(*pairs) if pairs else ((), ())
            columns = [pa.array([host] * len(pairs)), pa.array([code] * len(pairs)), pa.array(mine, pa.int32()), pa.array(its, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["host", "code", "node", "its"])


def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            root, headers = wrapper_of(json.loads(r["reference"]), {x["node"]: (x["pages"], x["least"], x["most"], x["chars"]) for x in r["stats"]}, r["total"])
            rows.append((r["host"], r["reference"], root, headers))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["host", "reference", "root", "template"])


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, reference, root, template``: a wrapper for each host, from all its pages."""
    texts = _hosted(pages).select("host", "html").mapInArrow(_texts, "host string, code string, page string, skeleton string, nodes array<struct<node:int,least:long,chars:long>>")
    texts = materialize(texts, "page-texts")
    skeletons = materialize(texts.where("skeleton is not null").groupBy("host", "code").agg(F.max("skeleton").alias("skeleton")), "skeletons")
    each = texts.select("host", "code", "page", "nodes").dropDuplicates(["host", "page"]).select("host", "code", F.explode("nodes").alias("n"))
    each = each.select("host", "code", "n.node", F.lit(1).cast("long").alias("pages"), "n.least", F.col("n.least").alias("most"), "n.chars")
    counts = materialize(_merge(each, "host", "code", "node"), "page-counts")
    sized = counts.where("node = -1").groupBy("host").agg(F.max(F.struct("pages", "code")).alias("m"), F.sum("pages").alias("total")).select("host", "total", F.col("m.code").alias("code"))
    reference = materialize(sized.join(skeletons, ["host", "code"]).select("host", "total", F.col("skeleton").alias("reference")), "references")
    met = skeletons.join(reference.select("host", "reference"), "host").select("host", "code", "skeleton", "reference")
    nodes = met.mapInArrow(_aligned, "host string, code string, node int, its int")
    found = counts.where("node >= 0").join(nodes, ["host", "code", "node"]).select("host", F.col("its").alias("node"), "pages", "least", "most", "chars")
    stats = _merge(found, "host", "node")
    listed = stats.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "least", "most", "chars")).alias("stats"))  # a row for each node of one skeleton
    listed = reference.join(listed, "host").select("host", "reference", "total", "stats")
    return listed.mapInArrow(_induced, "host string, reference string, root int, template array<int>")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], dict[int, int]] = {}
    for part in steps(batches, "html"):
        texts = []
        for html, reference, root, template in zip(*(part.column(i).to_pylist() for i in range(2, 6))):
            page = Page(html)
            back: dict[int, int] | None = None
            if reference is not None:
                own = page.skeleton()
                key = _code(own), _code(reference)
                if key not in known:
                    if len(known) > HELD_GROUPS:
                        known.clear()
                    pairs = align(json.loads(own), json.loads(reference)) if own != reference else {i: i for i in range(len(page.nodes))}
                    known[key] = {j: i for i, j in pairs.items()}
                back = known[key]
            if back is None or root not in back:
                texts.append(main_text(page, None, set()))
            else:
                texts.append(main_text(page, back[root], {back[t] for t in template if t in back}, set(back.values())))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: the main text of every page."""
    found = materialize(wrappers(pages), "wrappers")
    held = found.agg(F.sum(F.length("reference") + 4 * F.size("template") + 100)).head()[0] or 0
    met = _hosted(pages).join(F.broadcast(found) if held <= BROADCAST_CHARS else found, "host", "left")
    return met.select("page_id", "url", "html", "reference", "root", "template").mapInArrow(_extracted, "page_id long, url string, text string")


def digests(extracted: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extracted.withColumn("n_chars", F.char_length("text").cast("long"))
