"""Main text of web pages by wrapper induction.

1. Every page is parsed once to a DOM tree, and its blocks are folded to a skeleton: alike siblings next to one another are one
   node, in article containers alike siblings anywhere. What is kept of the page are its skeleton and its texts with their nodes.
2. A host's template tree is induced from all its different skeletons by simple tree matching: matched nodes are one, others
   are added in their places. Skeletons are merged in chunks, then the merged ones, so no host makes a large group.
   Each skeleton is then aligned to the template by the same matching; a text's slot is the template node of its block.
3. A slot is typed from all pages: the texts that are in at least CONSTANT_SHARE of the pages with the slot are constant, so
   template; the rest of the slot varies. The same is counted for each layout (the upper LAYOUT_LEVELS levels of the
   skeleton), so a notice of one of many layouts is constant too.
4. Regions of menus, headers, footers, forms, notices, adverts and comments (told by element, role, id and class) are never
   content. Constant texts are not content. Varying text is content inside an article container; outside one it is
   if it is not mostly links and, where the page has a container with text, the slot was seen to vary between pages.

Copies of an article are told by page: pages of one main text count as one, and where most of an article's text is constant
that page is a copy of others, and its text stays. In containers a text needs LEAST_INSIDE pages to be constant.

Scale: the parsed pages are a table in the shared folder (about the visible text); skeletons are aligned once each, not once a page.
Texts are counted by host, slot and text, never by host alone. Templates go to the pages by a broadcast join if their
measured size is under BROADCAST_BYTES, else by a shuffled join whose hot keys are salted by their share of pages.

Defined results: null or empty html, and pages without content, give ''. A null or broken url counts as host ''.
Unclosed and crossed tags are repaired as browsers do for p, li and table cells; a tag whose quotes do not close ends at the next ">", and
one that the page's end cuts is left out. Repeated rows repeat; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
import sys
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut

BROADCAST_BYTES = 8 << 20
#: Texts in this share of a slot's pages are constant, if there are so many different pages: outside and inside articles, and of one layout.
CONSTANT_SHARE = 0.8
LEAST_PAGES, LEAST_INSIDE, LEAST_LAYOUT = 2, 3, 4
LAYOUT_LEVELS = 3
#: Skeletons merged in one group. Child lists with more kept nodes than FOLD fold alike siblings wherever they are, which bounds a matching.
MERGED, FOLD = 64, 32
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold article text, and words of class, id and role that tell the same (fixed values).
NOT_CONTENT = frozenset("nav header footer aside form button menu dialog head".split()) | RAW
ARTICLE = frozenset("article main".split())
NOT_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside related recommended share social cookie cookies consent notice popup modal newsletter subscribe comment comments respond login search widget".split()
)
ARTICLE_WORDS = frozenset("article articlebody post-content entry-content main-content article-body post-body content-body".split())
#: Words before or after such a word in a class that say something of the page or of a state and not what the element is (fixed values).
ABOUT_PAGE = frozenset("has have with without no is not show hide hides".split())
STATES = frozenset("fixed sticky open opened closed visible hidden enabled disabled on off active layout page".split())
#: Elements whose content is left out, but that end at once if they close themselves or never close.
MAY_CLOSE = frozenset("svg math iframe object noscript template select".split())
#: An open element that a start tag ends first (fixed values of HTML).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


_END_OF = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Node:
    """An element or, with tag '#', a text. kind: 1 article container, -1 not content, 0 neither."""

    __slots__ = ("tag", "kind", "text", "children")

    def __init__(self, tag: str, kind: int = 0, text: str = ""):
        self.tag, self.kind, self.text, self.children = tag, kind, text, []


_kinds: dict[tuple[str, str], int] = {}


def told_by(token: str) -> int:
    """-1, 1 or 0: whether a class, id or role names a region that is not content, or the article. "ad-top" and "cookie_notice" do, "has-sidebar",
    "header-fixed" and "adventure" do not."""
    if token in NOT_CONTENT_WORDS:
        return -1
    if token in ARTICLE_WORDS:
        return 1
    parts = _PARTS.split(token)
    if len(parts) > 1 and parts[0] not in ABOUT_PAGE and parts[-1] not in STATES and NOT_CONTENT_WORDS.intersection(parts):
        return -1
    return int(any(f"{x}-{y}" in ARTICLE_WORDS for x, y in zip(parts, parts[1:], strict=False)))


def kind_of(tag: str, attributes: str) -> int:
    if tag in NOT_CONTENT:
        return -1
    known = _kinds.get((tag, attributes))
    if known is None:
        found = {told_by(token) for _, v in _ATTR.findall(attributes) for token in v.strip("\"'").lower().split()} if attributes else set()
        known = 1 if tag in ARTICLE else 0 if tag in ("body", "html") else -1 if -1 in found else int(1 in found)
        if len(_kinds) > 100_000:
            _kinds.clear()
        _kinds[tag, attributes] = known
    return known


def parse(html: str) -> Node:
    """A tree of elements and texts. Contents of RAW elements are left out."""
    root = Node("root")
    stack = [root]
    opened: Counter = Counter()

    def close(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            stack[-1].children.append(Node("#", 0, text))
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        tag = name.lower()
        if m.group(1):
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag not in INLINE and tag in INLINE:
                        break
            continue
        if tag in RAW:
            if tag in MAY_CLOSE and m.group(3).endswith("/"):
                continue
            over = _END_OF[tag].search(html, at)
            at = over.end() if over else at if tag in MAY_CLOSE else end
            continue
        if tag in BLOCKS_END_P:  # an open p ends, with the inline elements in it
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in ENDS and any(opened[x] for x in ENDS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS[tag]:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table"):
                    break
        node = Node(tag, kind_of(tag, m.group(3)))
        stack[-1].children.append(node)
        if tag not in VOID and not m.group(3).endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def clean(text: str) -> str:
    return _SPACE.sub(" ", _html.unescape(text)).strip()


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


# ---- skeletons and templates: trees [tag, kind, children, numbers], and simple tree matching ------------------------

sys.setrecursionlimit(1_000_000)  # trees are as deep as pages are; calls from Python to Python take no C stack


def alike(a: list, b: list) -> bool:
    return a[0] == b[0] and a[1] == b[1]


def matched(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the largest number of pairs of alike nodes of two trees that keep parents and the order of siblings."""
    key = (id(a), id(b))
    size = memo.get(key)
    if size is None:
        size = 1
        if a[2] and b[2]:
            size += _scores(a[2], b[2], memo)[0][0]
        memo[key] = size
    return size


def _scores(xs: list, ys: list, memo: dict) -> list[list[int]]:
    """score[i][j]: the best matching of xs from i on with ys from j on."""
    n, m = len(xs), len(ys)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = score[i], score[i + 1], xs[i]
        for j in range(m - 1, -1, -1):
            best = below[j] if below[j] >= row[j + 1] else row[j + 1]
            if x[0] == ys[j][0] and x[1] == ys[j][1]:
                both = below[j + 1] + matched(x, ys[j], memo)
                if both > best:
                    best = both
            row[j] = best
    return score


def pairs(xs: list, ys: list, memo: dict) -> list[tuple[int, int]]:
    """Places of the children that a best matching pairs, in order."""
    if not xs or not ys:
        return []
    score, out, i, j = _scores(xs, ys, memo), [], 0, 0
    while i < len(xs) and j < len(ys):
        if alike(xs[i], ys[j]) and score[i][j] == score[i + 1][j + 1] + matched(xs[i], ys[j], memo):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif score[i][j] == score[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def merge(a: list, b: list, memo: dict | None = None) -> list:
    """a with b in it: matched nodes are one and keep the numbers of both; others are added in their places, next to an alike sibling as one with it."""
    memo = {} if memo is None else memo
    children: list = []

    def add(node: list) -> None:
        if children and alike(children[-1], node):
            children[-1] = merge(children[-1], node)
        else:
            children.append(node)

    i = j = 0
    for p, q in pairs(a[2], b[2], memo):
        for node in a[2][i:p]:
            add(node)
        for node in b[2][j:q]:
            add(node)
        add(merge(a[2][p], b[2][q], memo))
        i, j = p + 1, q + 1
    for node in a[2][i:]:
        add(node)
    for node in b[2][j:]:
        add(node)
    return [a[0], a[1], children, a[3] + b[3]]


def numbers_to_slots(skeleton: list, template: list) -> dict[int, int]:
    """Slot (a number of the template) of each number of the skeleton whose node is matched."""
    memo: dict = {}
    out: dict[int, int] = {}
    todo = [(skeleton, template)]
    while todo:
        s, t = todo.pop()
        for n in s[3]:
            out[n] = t[3][0]
        todo += [(s[2][i], t[2][j]) for i, j in pairs(s[2], t[2], memo)]
    return out


def written(tree: list) -> str:
    """The tree as text: tag, kind and depth of its nodes in page order."""
    out, stack = [], [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        out.append(f"{node[0]} {node[1]} {depth}")
        stack += [(c, depth + 1) for c in reversed(node[2])]
    return "|".join(out)


def read(text: str) -> list:
    """The tree that was written; a node's number is its place."""
    path: list[list] = []
    for n, item in enumerate(text.split("|")):
        tag, kind, depth = item.rsplit(" ", 2)
        node = [tag, int(kind), [], [n]]
        del path[int(depth) :]
        if path:
            path[-1][2].append(node)
        path.append(node)
    return path[0]


# ---- pages as runs of text in nodes ----------------------------------------------------------------------------------


class Run:
    """A text between block tags, its block, and if it is inside an article container and in a block of mostly links."""

    __slots__ = ("text", "node", "inside", "links")

    def __init__(self, text: str, node: int, inside: bool):
        self.text, self.node, self.inside, self.links = text, node, inside, False


def page(root: Node) -> tuple[str, int, list[Run]]:
    """(skeleton as written, layout, texts outside the regions that are not content in page order; their nodes are places in the skeleton)."""
    found: list[Run] = []
    above, total, linked = [-1], [0], [0]
    run: list[str] = []
    tree = [root.tag, root.kind, [], [0]]
    # Entries: node, its next child, block, tree node, inside an article container, skipped, in a link.
    stack = [[root, 0, 0, tree, root.kind > 0, root.kind < 0, False]]

    def flush(block: int, inside: bool) -> None:
        if run:
            text = clean("".join(run))
            run.clear()
            if text:
                found.append(Run(text, block, inside))

    while stack:
        top = stack[-1]
        node, at, block, kept, inside, skipped, in_link = top
        if at == len(node.children):
            stack.pop()
            if node.tag not in INLINE:
                flush(block, inside)
            continue
        top[1] += 1
        c = node.children[at]
        if c.tag == "#":
            k = len(c.text.strip())
            total[block] += k
            linked[block] += k * in_link
            if not skipped:
                run.append(c.text)
        elif c.tag in VOID:
            if not skipped:
                run.append(" ")
        elif c.tag in INLINE:
            stack.append([c, 0, block, kept, inside, skipped or c.kind < 0, in_link or c.tag == "a"])
        else:
            flush(block, inside)
            above.append(block)
            total.append(0)
            linked.append(0)
            n = len(above) - 1
            # Folded into the sibling before it if that is alike; in containers and long lists into any.
            siblings = kept[2] if inside or len(kept[2]) > FOLD else kept[2][-1:]
            own = next((x for x in reversed(siblings) if x[0] == c.tag and x[1] == c.kind), None)
            if own is None:
                own = [c.tag, c.kind, [], []]
                kept[2].append(own)
            own[3].append(n)
            stack.append([c, 0, n, own, inside or c.kind > 0, skipped or c.kind < 0, in_link])
    for i in range(len(above) - 1, 0, -1):
        total[above[i]] += total[i]
        linked[above[i]] += linked[i]
    place, order, paths = {}, [(tree, 0, ())], set()
    n = 0
    while order:
        t, depth, path = order.pop()
        for block in t[3]:
            place[block] = n
        n += 1
        if depth <= LAYOUT_LEVELS:
            path = (*path, t[0], t[1])
            paths.add(path)
        order += [(x, depth + 1, path) for x in reversed(t[2])]
    for r in found:
        r.links = 2 * linked[r.node] >= total[r.node] > 0
        r.node = place[r.node]
    return written(tree), digest(repr(sorted(paths)).encode()), found


def in_layout(layout: int, slot: int) -> int:
    """The number of a slot in a layout, apart from those of slots."""
    x = (layout ^ (slot + 1) * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF
    return -1 - x


class Template:
    """A host's slots: in how many of its pages each is, and which texts are in nearly all of those."""

    def __init__(self, source: str | None):
        slots = json.loads(source).get("slots", ()) if source else ()
        self.pages = {s["slot"]: s["pages"] for s in slots}
        self.constant = {(s["slot"], t) for s in slots for t in s["texts"]}

    def is_constant(self, slot: int, own: int, code: int, inside: bool) -> bool:
        least = LEAST_INSIDE if inside else LEAST_PAGES
        return (slot, code) in self.constant and self.pages[slot] >= least or (own, code) in self.constant and self.pages[own] >= LEAST_LAYOUT

    def content(self, layout: int, slots: list[int], texts: list[str], codes: list[int], inside: list[bool], links: list[bool]) -> str:
        constant = [self.is_constant(s, in_layout(layout, s), c, i) for s, c, i in zip(slots, codes, inside, strict=True)]
        article = sum(len(t) for t, i in zip(texts, inside, strict=True) if i)
        # Mostly what other pages have too: a copy of an article, whose text is not the host's.
        copied = 2 * sum(len(t) for t, i, c in zip(texts, inside, constant, strict=True) if i and not c) < article
        out = []
        for text, slot, i, link, c in zip(texts, slots, inside, links, constant, strict=True):
            if i:
                wanted = copied or not c
            else:
                wanted = not c and not link and (not article or self.pages.get(slot, 0) >= LEAST_PAGES)
            if wanted:
                out.append(text)
        return " ".join(out)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


PARSED = {"skeleton": pa.string(), "copy": pa.int64(), "layout": pa.int64(), "nodes": pa.list_(pa.int32()), "texts": pa.list_(pa.string()), "codes": pa.list_(pa.int64()), "inside": pa.list_(pa.bool_()), "links": pa.list_(pa.bool_())}
_PARSED_SQL = "skeleton string, copy long, layout long, nodes array<int>, texts array<string>, codes array<long>, inside array<boolean>, links array<boolean>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host and PARSED of each page, as a table in the shared folder. Pages of one main text have one number `copy`."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in PARSED]
            for text in b.column("html").to_pylist():
                skeleton, layout, found = page(parse(text or ""))
                codes = [digest(r.text.encode("utf-8", "replace")) for r in found]
                main = [c for c, r in zip(codes, found, strict=True) if r.inside] or codes
                row = (skeleton, digest(repr(main).encode()), layout, [r.node for r in found], [r.text for r in found], codes, [r.inside for r in found], [r.links for r in found])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), *(pa.array(c, k) for c, k in zip(cols, PARSED.values(), strict=True))], names=["page_id", "url", "host", *PARSED])

    found = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html").mapInArrow(run, f"page_id {kind}, url string, host string, {_PARSED_SQL}")
    path = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    found.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def templates(skeletons: DataFrame, merged: int = MERGED) -> DataFrame:
    """(host, template): one tree a host, merged from all its skeletons (host, skeleton) by chunks of `merged`, then from the merged ones."""

    def run(key, table):
        trees = sorted(set(table.column("skeleton").to_pylist()), key=lambda t: (len(t), t))
        whole = read(trees[0])
        for t in trees[1:]:
            whole = merge(whole, read(t))
        return pa.table({"host": [key[0].as_py()], "skeleton": [written(whole)]})

    trees = skeletons
    while True:
        per = trees.groupBy("host").agg(F.ceil(F.count("*") / merged).alias("chunks"))
        chunk = F.pmod(F.xxhash64("skeleton"), F.col("chunks"))
        trees = cut(trees.join(per, "host").groupBy("host", chunk.alias("chunk")).applyInArrow(run, "host string, skeleton string"))
        if trees.groupBy("host").count().where("count > 1").isEmpty():
            return trees.withColumnRenamed("skeleton", "template")


def aligned(skeletons: DataFrame, trees: DataFrame) -> DataFrame:
    """(host, skeleton, slots): the template's slot of each node of a skeleton, -1 where it is not matched."""

    def run(batches):
        memo: dict[str, list] = {}
        for b in batches:
            slots = []
            for s, t in zip(b.column("skeleton").to_pylist(), b.column("template").to_pylist(), strict=True):
                if t not in memo:
                    if len(memo) > 500:
                        memo.clear()
                    memo[t] = read(t)
                of = numbers_to_slots(read(s), memo[t])
                slots.append([of.get(n, -1) for n in range(s.count("|") + 1)])
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("skeleton"), pa.array(slots, pa.list_(pa.int32()))], names=["host", "skeleton", "slots"])

    return skeletons.join(trees, "host").select("host", "skeleton", "template").mapInArrow(run, "host string, skeleton string, slots array<int>")


def attach(rows: DataFrame, table: DataFrame, keys: list[str], size: int, broadcast_bytes: int) -> DataFrame:
    """rows with the columns of table, which has a row a key: by broadcast if its size is within bounds, else shuffled with hot keys salted."""
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(table), keys, "left")
    counts = rows.groupBy(*keys).count()
    salted = table.join(counts, keys).withColumn("salts", F.ceil(F.col("count") / 5000).cast("int"))
    spread = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("count", "salts")
    many = salted.where("salts > 1").select(*keys, "salts")
    marked = rows.join(F.broadcast(many) if many.count() * 64 <= broadcast_bytes else many, keys, "left")
    return marked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "copy"), F.coalesce("salts", F.lit(1))).cast("int")).join(spread, [*keys, "salt"], "left").drop("salt", "salts")


def typed(rows: DataFrame) -> DataFrame:
    """(host, template): of each slot of a host, also of its layouts, in how many pages it is and which texts are constant. rows: pages with their skeleton's slots."""

    def run(batches):
        for b in batches:
            out = []
            for h, copy, layout, nodes, codes, slots in zip(*(b.column(c).to_pylist() for c in ("host", "copy", "layout", "nodes", "codes", "slots")), strict=True):
                seen = {(slots[n], c) for n, c in zip(nodes, codes, strict=True) if slots[n] >= 0}
                out += [(h, copy, s, c) for slot, c in seen for s in (slot, in_layout(layout, slot))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "page", "slot", "text"])

    cols = ("host", "copy", "layout", "nodes", "codes", "slots")
    seen = cut(rows.select(*cols).where("size(nodes) > 0").mapInArrow(run, "host string, page long, slot long, text long").distinct())
    in_slot = seen.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    of_text = seen.groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    slots = in_slot.join(of_text, ["host", "slot"], "left").groupBy("host", "slot", "pages").agg(
        F.collect_list(F.when(F.col("n") >= CONSTANT_SHARE * F.col("pages"), F.col("text"))).alias("texts")
    )
    return slots.groupBy("host").agg(F.to_json(F.struct(F.collect_list(F.struct("slot", "pages", "texts")).alias("slots"))).alias("template"))


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, merged: int = MERGED) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = parsed(pages)
    skeletons = cut(rows.select("host", "skeleton").distinct())
    slots = cut(aligned(skeletons, templates(skeletons, merged)))
    size = slots.agg(F.sum(F.length("skeleton") + F.length("host") + 4 * F.size("slots") + 32)).first()[0] or 0
    placed = attach(rows, slots, ["host", "skeleton"], size, broadcast_bytes)
    found = cut(typed(placed))
    size = found.agg(F.sum(F.length("template") + F.length("host") + 32)).first()[0] or 0
    joined = attach(placed, found, ["host"], size, broadcast_bytes)
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        memo: dict[str, Template] = {}
        for b in batches:
            texts = []
            for template, layout, of, nodes, *own in zip(*(b.column(c).to_pylist() for c in ("template", "layout", "slots", "nodes", "texts", "codes", "inside", "links")), strict=True):
                t = memo.get(template or "")
                if t is None:
                    if len(memo) > 2000:
                        memo.clear()
                    t = memo[template or ""] = Template(template)
                texts.append(t.content(layout, [of[n] for n in nodes], *own))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "template", "layout", "slots", "nodes", "texts", "codes", "inside", "links").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
