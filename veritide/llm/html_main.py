"""Main text of web pages by site style trees.

Pages of a host are merged into one tree. A node is an element at its place in its parent's
sequence of children (a style), below its parent's node; so a page has a node at most once. A node's presentation
importance is the entropy of its child sequences over the pages that have it; its content importance is one less the mean
entropy of its text blocks: a block on every page weighs nothing. Both combine bottom-up, damped as in the published
method, towards 1 for nodes of few pages, and branches of low importance are removed from each page.

Two priors enter that importance. Elements that hold no prose (scripts, menus, forms, footers and
the like, and elements whose whole class names say so) have none. A marked article that holds most
of a page's text takes it from what stands outside.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, written
from .url_filter import host_of

#: A branch below this composite importance goes.
LEAST_IMPORTANCE = 0.2

#: What a weak class name leaves of a branch's importance inside an article.
WEAK_PRIOR = 0.5

#: Damping of the composite importance.
DAMPING = 0.9

#: Up to so many tree nodes travel with the tasks (about 60 bytes each); more are joined by host.
BROADCAST_NODES = 200_000

_SALTS = 16

# Element names of HTML, by their role.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section select "
    "summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noframes xmp".split())
_NEVER = frozenset(
    "head title script style noscript template svg iframe object canvas nav footer aside form button select option textarea "
    "dialog menu audio video".split()
)
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_SCOPES = frozenset("table ul ol dl select article section div body main aside nav footer form".split())
# Class names of branches without prose, of branches that have some inside an article, and words that may stand beside them.
_NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent popup modal overlay sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies newsletter subscribe login signup "
    "pagination pager".split()
)
_WEAK_WORDS = frozenset(
    "banner promo promotion notice notices alert reply share sharing social related recommended subscription toolbar widget widgets skip header".split()
)
_PLAIN_WORDS = frozenset("site page main global top bottom left right list box bar container wrapper section area block inner outer item items links text content".split())
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass
class Node:
    tag: str
    label: str
    parent: int
    index: int
    prior: float
    article: bool
    children: list[str] = field(default_factory=list)


def _named(given: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a whole class name or id is one of ``words``, alone or in a compound with plain words."""
    for name in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        parts = re.findall(r"[a-z0-9]+", name)
        if any(x in words for x in parts) and all(x in words or x in _PLAIN_WORDS or x in _WEAK_WORDS for x in parts):
            return True
    return False


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Element nodes in page order, and (node, text) of each text block with white space collapsed."""
    nodes = [Node("", "", -1, 0, 1.0, False)]
    blocks: list[tuple[int, str]] = []
    if not page:
        return nodes, blocks
    stack = [0]
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                at = next(i for i in reversed(stack) if nodes[i].tag in _BLOCKS or i == 0)
                blocks.append((at, joined))

    def close(names, scopes=_SCOPES) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in names:
                del stack[k:]
                return
            if tag in scopes:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag in _BLOCKS:
                flush()
                if tag != "p" or any(nodes[i].tag == "p" for i in stack):
                    close({tag}, frozenset())
            else:
                close({tag}, _BLOCKS)
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in _BLOCKS:
            flush()
            close({"p"})
            if tag in _CLOSED_BY:
                close(_CLOSED_BY[tag])
        if tag in _VOID:
            continue
        given = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTR.findall(m[3])} if "=" in m[3] else {}
        above = nodes[stack[-1]]
        label = f"{tag}.{'.'.join(given.get('class', '').split())}"
        inside = above.article or tag in ("article", "main")
        prior = above.prior
        if (
            tag in _NEVER
            or (tag == "header" and not above.article)
            or given.get("role", "").lower() in _NEVER_ROLES
            or "display:none" in given.get("style", "").replace(" ", "").lower()
            or given.get("aria-hidden") == "true"
        ):
            prior = 0.0
        elif tag not in ("html", "body", "main", "article") and given:
            if _named(given, _NEVER_WORDS):
                prior = 0.0
            elif _named(given, _WEAK_WORDS):
                prior = min(prior, WEAK_PRIOR) if inside else 0.0
        if tag in _RAW:
            found = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end if found is None else (page.find(">", found.start()) + 1 or end)
            above.children.append(label)
            continue
        above.children.append(label)
        nodes.append(Node(tag, label, stack[-1], len(above.children) - 1, prior, inside))
        stack.append(len(nodes) - 1)
    flush()
    return nodes, blocks


def _style(children: list[str]) -> int:
    return xxhash.xxh64_intdigest("|".join(children)) >> 1


def node_keys(nodes: list[Node]) -> list[int]:
    """Each node's key in the style tree: its parent's key and style, its place there, and its label."""
    keys, styles = [0], [_style(n.children) for n in nodes]
    for n in nodes[1:]:
        keys.append(xxhash.xxh64_intdigest(f"{keys[n.parent]}/{styles[n.parent]}/{n.index}/{n.label}") >> 1)
    return keys


def tree_features(page: str | None) -> Counter:
    """(node, kind, value) of a page: kind 0 the node itself, 1 its child sequence, 2 a text block, once each. Nodes without prose have none."""
    nodes, blocks = parse(page)
    keys = node_keys(nodes)
    out = {(k, 0, 0) for k, n in zip(keys, nodes, strict=True) if n.prior}
    out |= {(k, 1, _style(n.children)) for k, n in zip(keys, nodes, strict=True) if n.prior}
    out |= {(keys[i], 2, xxhash.xxh64_intdigest(t) >> 1) for i, t in blocks if nodes[i].prior}
    return Counter(out)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([k[2] for k in keys], pa.int32()),
                pa.array([k[3] for k in keys], pa.int64()),
                pa.array(list(held.values()), pa.int64()),
            ],
            names=["host", "node", "kind", "value", "n"],
        )
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for f in tree_features(page.as_py()):
                held[(host, *f)] += 1
            if len(held) > 100_000:
                yield flush()
    if held:
        yield flush()


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The merged trees: host, node, pages, styles, presentation and content importance. Written.

    Counts are summed per task first, so a host with most of the pages is no hot spot.
    """
    rows = pages.select(F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))
    counts = (
        rows.mapInArrow(_feature_batches, "host string, node long, kind int, value long, n long")
        .groupBy("host", "node", "kind", "value")
        .agg(F.sum("n").alias("n"))
    )
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c))
    merged = counts.groupBy("host", "node").agg(
        F.coalesce(of(0, F.col("n")), F.lit(0)).alias("pages"),
        F.coalesce(of(1, F.lit(1)), F.lit(0)).alias("styles"),
        of(1, F.col("n") * F.log("n")).alias("style_sum"),
        F.coalesce(of(2, F.lit(1)), F.lit(0)).alias("blocks"),
        of(2, F.log("n")).alias("block_sum"),
    )
    # nodes of one page are fully important and need no row; of few pages, their importance is drawn towards 1
    several = merged.where("pages > 1")
    m, drawn = F.log(F.col("pages").cast("double")), 1 - 1 / F.col("pages")
    return written(
        several.select(
            "host", "node", "pages", "styles",
            (1 - drawn * F.col("style_sum") / F.col("pages") / m).alias("presentation"),
            F.when(F.col("blocks") > 0, 1 - drawn * F.col("block_sum") / F.col("blocks") / m).alias("content"),
        )
    )


Tree = dict[int, tuple[int, float, float | None]]


def main_text(page: str | None, tree: Tree) -> str:
    """The page's article: its blocks, joined by two line feeds, without branches of low importance."""
    nodes, blocks = parse(page)
    blocks = [(i, t) for i, t in blocks if nodes[i].prior]
    inside = sum(len(t) for i, t in blocks if nodes[i].article)
    if 2 * inside > sum(len(t) for _, t in blocks):
        blocks = [(i, t) for i, t in blocks if nodes[i].article]
    worth = composite(nodes, blocks, tree)
    low = [False] * len(nodes)
    for i in range(1, len(nodes)):
        low[i] = low[nodes[i].parent] or worth[i] * nodes[i].prior < LEAST_IMPORTANCE
    return "\n\n".join(t for _, t in [(i, t) for i, t in blocks if not low[i]] or blocks)


def composite(nodes: list[Node], blocks: list[tuple[int, str]], tree: Tree) -> list[float]:
    """Importance of each node's branch, from the leaves up; nodes that the tree lacks are fully important."""
    with_text = {i for i, _ in blocks}
    keys = node_keys(nodes)
    total, parts, worth = [0.0] * len(nodes), [0] * len(nodes), [1.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        styles, presentation, content = tree.get(keys[i], (1, 1.0, 1.0))
        if i in with_text:
            total[i] += 1.0 if content is None else content
            parts[i] += 1
        if parts[i]:
            damp = DAMPING**styles
            worth[i] = (1 - damp) * presentation + damp * total[i] / parts[i]
            if i:
                total[nodes[i].parent] += worth[i]
                parts[nodes[i].parent] += 1
    return worth


def _rows_of(trees: dict[str, Tree]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [main_text(p, trees.get(h, {})) for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield _answer(part, found)

    return work


def _answer(part: pa.RecordBatch, found: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
        names=["id", "url", "text", "n_chars"],
    )


def _rows_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, tree = None, {}
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            found = []
            for p, t in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                if t != last:
                    last = t
                    tree = {x["node"]: (x["styles"], x["presentation"], x["content"]) for x in t or []}
                found.append(main_text(p, tree))
            yield _answer(part, found)


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES
) -> DataFrame:
    """id, url, text and n_chars of every row, repeated rows included.

    A null or empty html gives an empty text. A null url, or one without ``://``, has the host
    '', whose pages form one tree. If the tree finds all of a page's prose unimportant (a site of copies), the
    prose stays. Other columns are not read.
    """
    tree = style_tree(pages, url_col=url_col, html_col=html_col)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"),
        F.col(html_col).alias("html"),
    )
    schema = f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    if tree.count() <= broadcast_nodes:
        trees: dict[str, Tree] = {}
        for r in tree.collect():
            trees.setdefault(r["host"], {})[r["node"]] = (r["styles"], r["presentation"], r["content"])
        out = rows.mapInArrow(_rows_of(trees), schema)
    else:
        held = tree.groupBy("host").agg(F.collect_list(F.struct("node", "styles", "presentation", "content")).alias("tree"))
        held = held.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(_SALTS)])))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(_SALTS)).cast("int"))
        out = salted.join(held, ["host", "salt"], "left").select("id", "url", "host", "html", "tree").mapInArrow(_rows_joined, schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op4_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
