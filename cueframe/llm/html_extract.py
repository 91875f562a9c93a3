"""Main text of web pages by site style trees.

The pages of one host are merged: elements with the same path of tags and classes are one node of the host's tree. Plain
text elements (paragraphs, headings, links and the like without a class) belong to the element around them. Each node has

- a presentation importance: the entropy of the sequences of children that it has on its pages. A layout repeats itself,
  an article has other paragraphs on each page;
- a content importance: its share of the tree's information, which is its words, weighted by one minus the entropy of each
  text over the pages (what stands on every page says little);
- both combined as Yi, Liu and Li (2003) do, the presentation with weight 1 - DAMP ** number of children.

Inside a layout, branches of low importance are removed. Below a node of high presentation entropy and content, which is
an article whatever it is called, only elements whose texts stand on most pages are removed. Tags seed the tree where HTML
says what they are: navigation, footers, asides, forms and hidden elements have no importance, article and main elements
have full importance. No names of classes are known. Hosts with few pages have too little statistics and share one
tree, which is the mean of all hosts' trees; of what too few pages have there, the seeds decide. A page of which the tree
would leave nothing keeps what the seeds leave.

Features are counted per task before they are shuffled and summed by (host, node, feature), so a host with a large
share of all pages is dealt over all tasks; the trees themselves are sums over rows, and no host is gathered.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, slices

#: Pages that a tree and a node must have; of a node also this share of the tree's pages, which bounds the nodes of a tree.
LEAST_PAGES, LEAST_SHARE = 16, 0.001
LEVEL, DAMP = 0.2, 0.9
#: Presentation entropy and share of information from which a node is an article; share of repeated words that is too much.
RICH, MOST, REPEATED = 0.3, 0.5, 0.8
#: Elements further down belong to their ancestor at this depth.
DEEPEST = 32
#: So many judged nodes are broadcast at most (about 8 bytes each); beyond, Spark joins them by host.
BROADCAST_NODES = 500_000

#: Fixed: what HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An element that opens ends an open one of the first set, unless one of the second stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
P_SCOPE = frozenset("article aside blockquote body button dd details div dl dt fieldset figure footer form header li main nav ol section table td th ul".split())
#: Elements that are never main text, and landmark roles that say the same.
NOISE_TAGS = frozenset("nav footer aside form head button select input label svg math canvas audio video object dialog menu".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre td th tr table tbody thead tfoot dl dt dd figure figcaption hgroup".split())

#: One value or name of a tag, as HTML reads it: quotes count only behind =, an unquoted value ends at white space or >. A
#: quote that is never closed is part of an unquoted value. Nothing is ever gone back over.
_VALUE = r"""(?>"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TOKEN = re.compile(rf"""<!--(?>.*?(?:-->|\Z))|<!\[CDATA\[(?>.*?(?:\]\]>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(rf"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+""")
_END_OF = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    """An element. plain: a text element without a class, which belongs to `unit`, the element around it."""

    __slots__ = ("tag", "look", "noise", "path", "parent", "children", "unit", "depth")

    def __init__(self, tag: str, look: str, noise: bool, parent: Node | None):
        self.tag, self.look, self.noise, self.parent = tag, look, noise, parent
        self.children: list[Node | str] = []
        self.unit, self.depth, self.path = self, 0, 0
        if parent is not None:
            above = parent.unit
            if tag == look and (tag in TEXT_TAGS or tag not in BLOCK) or above.depth >= DEEPEST:
                self.unit = above
            else:
                self.depth = above.depth + 1
                self.path = xxhash.xxh3_64_intdigest(look.encode("utf-8", "surrogatepass"), seed=above.path) & ~3


def _look(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's presentation, and whether its tag, role or style say that it is not main text."""
    noise = tag in NOISE_TAGS
    if not attributes.strip():
        return tag, noise
    found = {k.lower(): html_lib.unescape(v.strip("\"'")).lower() for k, v in _ATTRIBUTE.findall(attributes)}
    names = sorted(set(_WORD.findall(f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}")))
    noise = noise or "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", ""))) or found.get("role") in NOISE_ROLES
    return " ".join([tag, *names]), noise


def parse(html: str) -> Node:
    """A tree of elements and texts; forgiving: what is not closed ends with its parent."""
    root = Node("#root", "#root", False, None)
    at, top, end = 0, root, len(html)
    looks: dict[tuple[str, str], tuple[str, bool]] = {}
    open_tags: defaultdict[str, int] = defaultdict(int)
    unclosed: set[str] = set()

    def close(upto: Node) -> Node:
        """Ends the open elements down to one, and it; gives its parent."""
        node = top
        while node is not upto:
            open_tags[node.tag] -= 1
            node = node.parent
        open_tags[upto.tag] -= 1
        return upto.parent

    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            top.children.append(html[at:])
            break
        if m.start() > at:
            top.children.append(html[at : m.start()])
        at = m.end()
        if not m[2] or not m[4]:  # no element, or a tag that the page ends in
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag]:
                node = top
                while node.tag != tag:
                    node = node.parent
                top = close(node)
            continue
        if tag in CLOSES_P and open_tags["p"]:
            node = top
            while node is not root and node.tag != "p" and node.tag not in P_SCOPE:
                node = node.parent
            if node.tag == "p":
                top = close(node)
        if tag in ENDS and any(open_tags[t] for t in ENDS[tag][0]):
            gone, stop = ENDS[tag]
            node, last = top, None
            while node is not root and node.tag not in stop:
                last = node if node.tag in gone else last
                node = node.parent
            top = close(last) if last is not None else top
        key = (tag, m[3])
        if key not in looks:
            looks[key] = _look(tag, m[3].rstrip("/"))
        node = Node(tag, *looks[key], top)
        top.children.append(node)
        if tag in RAW:
            found = None if tag in unclosed else _END_OF[tag].search(html, at)
            if found is None:  # never closed: code hides the rest, other elements count as empty
                unclosed.add(tag)
                at = end if tag in ("script", "style") else at
            else:
                after = html.find(">", found.end())
                at = end if after < 0 else after + 1
        elif tag not in VOID and not m[3].endswith("/"):
            top = node
            open_tags[tag] += 1
    return root


#: What the tree says of a node, in the two lowest bits of its path.
LOW, STALE, ARTICLE = 1, 2, 3


def blocks(root: Node, judged: dict[int, int]) -> list[str]:
    """The text blocks of a page without what its host's tree judges unimportant; judged: {path: what}. Seeds decide
    alone where the tree says nothing, and where it would leave nothing of the page."""
    return _blocks(root, judged) or (_blocks(root, {}) if judged else [])


def _blocks(root: Node, judged: dict[int, int]) -> list[str]:
    out: list[str] = []
    part: list[str] = []

    def flush():
        text = " ".join("".join(part).split())
        if text:
            out.append(text)
        part.clear()

    # (node, whether an article is around it, whether it is an article element)
    todo: list[tuple[Node | str | None, bool, bool]] = [(root, False, False)]
    while todo:
        node, inside, within = todo.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            part.append(html_lib.unescape(node))
            continue
        seed = node.tag == "main" or node.tag == "article"
        # an article inside an article is a comment on it
        gone = node.noise or node.tag == "header" and not inside or node.tag == "article" and within
        if not gone and not seed and node.unit is node:
            said = judged.get(node.path)
            gone = said == STALE or said == LOW and not inside
            inside = inside or said == ARTICLE
        if gone:
            flush()
            continue
        inside, within = inside or seed, within or node.tag == "article"
        if node.tag == "br":
            part.append(" ")
        if node.tag in BLOCK:
            flush()
            todo.append((None, inside, within))
        todo += [(c, inside, within) for c in reversed(node.children)]
    flush()
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, kind, feature, words, above, n): kind 0 counts pages (above: the node's ancestors), 1 sequences of
    children, 2 texts."""
    h = xxhash.xxh3_64_intdigest
    found: Counter = Counter()
    names = ["host", "node", "kind", "feature", "words", "above", "n"]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())

    def flush() -> pa.RecordBatch:
        columns = list(zip(*((*k, n) for k, n in found.items()), strict=True))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for record in slices(batches, 1, 4_000_000):
        for host, html in zip(record.column(0).to_pylist(), record.column(1).to_pylist(), strict=True):
            page = set()
            todo = [parse(html or "")]
            while todo:
                node = todo.pop()
                if node.noise:
                    continue
                unit = _signed(node.unit.path)
                inner = [c for c in node.children if not isinstance(c, str)]
                if node.unit is node:
                    above, up = [], node.parent
                    while up is not None:
                        above.append(_signed(up.unit.path))
                        up = up.unit.parent
                    page.add((host, unit, 0, 0, 0, tuple(above)))
                    look = "|".join([c.look for c in inner])
                    page.add((host, unit, 1, _signed(h(look.encode("utf-8", "surrogatepass"))), 0, None))
                for c in node.children:
                    if isinstance(c, str) and not c.isspace():
                        words = c.split()
                        page.add((host, unit, 2, _signed(h(" ".join(words).encode("utf-8", "surrogatepass"))), len(words), None))
                todo += inner
            found.update(page)
            if len(found) > 100_000:
                yield flush()
    if found:
        yield flush()


def _signed(x: int) -> int:
    return x - (1 << 63)


def node_statistics(pages: DataFrame) -> DataFrame:
    """(host, node, above, pages, style, mass, fresh, words) of each node of each host's tree. pages: (host, html).

    style: presentation entropy, null for a node of one page; mass: information in it, without what is below it; fresh and
    words: its words, those weighted by how few pages share their text, and all.
    """
    counted = pages.mapInArrow(_features, "host string, node long, kind int, feature long, words long, above array<long>, n long")
    counted = counted.groupBy("host", "node", "kind", "feature", "words").agg(F.sum("n").alias("n"), F.max("above").alias("above"))
    n, kind = F.col("n"), F.col("kind")
    m = counted.groupBy("host", "node").agg(
        F.max(F.when(kind == 0, n)).alias("pages"),
        F.max("above").alias("above"),
        F.sum(F.when(kind == 1, n * F.log(n)).otherwise(0.0)).alias("styles"),
        F.sum(F.when(kind == 2, n * F.col("words")).otherwise(0)).alias("words"),
        F.sum(F.when(kind == 2, n * F.col("words") * F.log(n)).otherwise(0.0)).alias("shared"),
    )
    log_m = F.log(F.col("pages").cast("double"))
    several = F.col("pages") > 1
    fresh = F.greatest(F.lit(0.0), F.when(several, F.col("words") - F.col("shared") / log_m).otherwise(F.col("words").cast("double")))
    stats = m.select("host", "node", "above", "pages", F.when(several, 1 - F.col("styles") / (F.col("pages") * log_m)).alias("style"), fresh.alias("fresh"), "words")
    # a text that all pages share is still words: copies of pages do not turn an article into nothing
    return stats.withColumn("mass", 0.7 * F.col("fresh") + 0.3 * F.col("words"))


def judged_nodes(stats: DataFrame) -> DataFrame:
    """(host, node, verdict) of node_statistics; the rows of one tree have one `host`. verdict: LOW, STALE, ARTICLE or 0."""
    below = stats.select("host", F.explode(F.concat(F.array("node"), F.coalesce("above", F.array().cast("array<bigint>")))).alias("top"), F.when(F.size("above") > 0, F.col("above")[0]).alias("up"), "mass", "fresh", "words")
    sums = below.groupBy("host", F.col("top").alias("node")).agg(
        F.sum("mass").alias("all_mass"), F.sum("fresh").alias("all_fresh"), F.sum("words").alias("all_words"), F.count(F.when(F.col("up") == F.col("top"), 1)).alias("children")
    )
    root = sums.where(F.col("node") == _signed(0)).select("host", F.col("all_mass").alias("whole"))
    whole = stats.where(F.col("node") == _signed(0)).select("host", F.col("pages").alias("all_pages"))
    rows = stats.select("host", "node", "pages", F.coalesce("style", F.lit(0.0)).alias("style")).join(sums, ["host", "node"]).join(root, "host").join(whole, "host")
    rows = rows.where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("all_pages")))
    share = F.when(F.col("whole") > 0, F.col("all_mass") / F.col("whole")).otherwise(1.0)
    damp = F.pow(F.lit(DAMP), F.col("children"))
    importance = (1 - damp) * F.col("style") + damp * share
    stale = (F.col("all_words") > 0) & (F.col("all_fresh") < (1 - REPEATED) * F.col("all_words")) & (share < MOST)
    verdict = F.when(stale, STALE).when((F.col("style") >= RICH) & (share >= MOST), ARTICLE).when(importance < LEVEL, LOW).otherwise(0)
    return rows.select("host", "node", "all_pages", verdict.alias("verdict"))


def style_trees(pages: DataFrame) -> tuple[DataFrame, list[int]]:
    """((host, nodes: array of paths with the verdict in the two lowest bits) of the hosts that have enough pages, the nodes
    of the mean tree). pages: (host, html). A node that too few pages have is not judged, in any tree."""
    stats = materialise(node_statistics(pages), "nodes")
    coded = F.col("node") + F.col("verdict")
    own = judged_nodes(stats).where(F.col("all_pages") >= LEAST_PAGES)
    trees = own.groupBy("host").agg(F.collect_list(F.when(F.col("verdict") > 0, coded)).alias("nodes"))
    # a node's weight in the mean tree is its pages; a node of one page says nothing of styles
    seen = F.when(F.col("style").isNotNull(), F.col("pages"))
    mean = stats.groupBy("node").agg(
        F.max("above").alias("above"), F.sum("pages").alias("pages"), (F.sum(F.col("style") * seen) / F.sum(seen)).alias("style"), *(F.sum(c).alias(c) for c in ("mass", "fresh", "words"))
    )
    # an empty name that is no literal: joins by a literal would become nested loops
    mean = judged_nodes(mean.withColumn("host", F.substring(F.col("node").cast("string"), 1, 0)))
    # at most 1 / LEAST_SHARE times the elements of a page, whatever the number of pages
    return materialise(trees, "trees"), [r[0] for r in mean.where("verdict > 0").select(coded).collect()]


def _extracted(mean: list[int]):
    def as_tree(nodes: list[int]) -> dict[int, int]:
        return {(x + (1 << 63)) & ~3: x & 3 for x in nodes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = as_tree(mean)
        trees: dict[str, dict[int, int]] = {}
        for record in slices(batches, 3, 4_000_000):
            texts = []
            for host, html, nodes in zip(*(record.column(c).to_pylist() for c in ("host", "html", "nodes")), strict=True):
                tree = common
                if nodes is not None:
                    if len(trees) > 1000:
                        trees.clear()
                    tree = trees.get(host)
                    if tree is None:
                        tree = trees[host] = as_tree(nodes)
                texts.append("\n".join(blocks(parse(html or ""), tree)))
            yield pa.RecordBatch.from_arrays([record.column("page_id"), record.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of (page_id, url, html).

    Null or empty html gives an empty text. Pages without url are one host. Repeated rows give repeated results and count
    again in the tree; further columns are not carried; an empty table gives an empty one. White space of any kind inside
    a block is one space.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    trees, mean = style_trees(pages.select("host", "html"))
    few = (trees.agg(F.sum(F.size("nodes") + 4)).first()[0] or 0) <= BROADCAST_NODES
    joined = pages.join(F.broadcast(trees) if few else trees, "host", "left")
    return joined.select("page_id", "url", "host", "html", "nodes").mapInArrow(_extracted(mean), "page_id long, url string, text string, n_chars long")
