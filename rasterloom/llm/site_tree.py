"""Main text of web pages with a site style tree.

Pages of one host are merged: elements with the same path of (tag, class) are one node of the host's tree. Over its occurrences a node
has presentations (the sequence of its children) and contents (the text below it), and for each an entropy, divided by the largest that so
many occurrences can have. A node's importance mixes the two; branches that a host repeats nearly unchanged have little of it and
are cut from every page, whether the page has an article or not. Two things entropy cannot see are decided by what the markup says: scripts, forms, navigation, adverts,
comments and the like are cut by tag, role and class (inside an article only by classes that say nothing else) even where they differ on every page, and a host with fewer than LEAST
occurrences of a node gives no verdict on it. Article and main elements are never cut by importance, nor with a branch above them that is.

Counting is two aggregations by (host, node, feature) and (host, node) with partial sums, so one host may hold any share of the pages. Only cut
nodes are joined back, from a written table; Spark broadcasts it below its own threshold and else shuffles. Null and empty html give an
empty text; any markup, however broken, is parsed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read, small_batches, staged

IMPORTANCE, MIX, LEAST = 0.1, 0.8, 10  # cut below this importance; share of content in it; least occurrences for a verdict

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
CUT_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu audio video map title".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice gdpr "
    "newsletter subscribe subscription signup login popup modal overlay comment comments commentlist disqus reply replies share sharing social related recommended recommendations widget pagination pager toolbar search form".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("a center dd details div dl fieldset header hgroup ol section span summary td ul".split())
BESIDE = frozenset("area bar block body bottom box button buttons container content group holder icons inner item items left link links list outer post posts right row section slot thread title top unit wrap wrapper".split())
OF_AN_ARTICLE = frozenset("header masthead banner notice search form".split())  # words that say nothing by themselves inside an article
ENTRY = frozenset("article entry post story".split())
UNSEEN = RAW | frozenset("head noscript template select iframe object svg canvas audio video map".split())  # holds no text of the page, whatever is in it
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends the open elements named, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[^a-z0-9]+")


SHOWN, LOW, HIDDEN, GONE = range(4)  # of a walked element: text stays, is cut by importance, is cut by noise above, is never shown


class Node:
    __slots__ = ("attributes", "children", "key", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.key = 0


def parse(html: str) -> Node:
    """The element tree; children are Nodes and decoded strings."""
    root = Node("html")
    stack, at, end = [root], 0, len(html)

    def text(i: int, j: int) -> None:
        if i < j:
            stack[-1].children.append(unescape(html[i:j]))

    for_raw = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "button", "object"):
                    break
        if tag in ENDS:
            closes, stops = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stops:
                    break
                if stack[k].tag in closes:
                    del stack[k:]
                    break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            close = for_raw[tag].search(html, at)
            node.children.append(html[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def noise(node: Node, inner: bool = False, through: frozenset[str] = frozenset()) -> bool:
    """Whether tag, role or class says that this is not the article. inner: whether an article or main element is above it. through: tags that don't say so.

    A class name is cut into its words. Of a container outside articles one telling word suffices, but for the header of an entry; inside, and of
    elements that hold text themselves, all words have to tell (`comment-list`, but not `share-price-table`). A heading is not cut by its class.
    """
    if node.tag in CUT_TAGS and node.tag not in through:
        return True
    if not node.attributes or node.tag in ("article", "main"):
        return False
    for m in ATTRIBUTE.finditer(node.attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(PART.split(name)) - {""}
            if m[1].lower() == "role":
                if not CUT_ROLES.isdisjoint(words):
                    return True
            elif node.tag in HEADINGS:
                continue
            elif inner or node.tag not in CONTAINERS:
                if words and words <= CUT_WORDS | BESIDE and not words <= BESIDE | OF_AN_ARTICLE:
                    return True
            elif told := words & CUT_WORDS:
                if told != {"header"} or words.isdisjoint(ENTRY):
                    return True
    return False


def keyed(root: Node) -> list[Node]:
    """All nodes in page order, each with the hash of its path of tags and classes. No recursion, so depth is not limited."""
    out, todo = [], [(root, 0)]
    while todo:
        node, above = todo.pop()
        own = next((m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attributes) if m[1].lower() == "class"), "") if node.attributes else ""
        node.key = zlib.crc32(f"{node.tag}.{own}".encode(), above)
        out.append(node)
        todo += [(c, node.key) for c in reversed(node.children) if isinstance(c, Node)]
    return out


def walk(root: Node, cut: frozenset[int], kept: frozenset[int], through: frozenset[str] = frozenset()) -> tuple[list[str], dict[int, bool]]:
    """Blocks that stay, and of the outermost article and main elements the id and whether noise above hides it. kept: ids that noise does not hide."""
    out, now, tops = [], [], {}

    def close() -> None:
        if line := " ".join("".join(now).split()):
            out.append(line)
        now.clear()

    todo: list = [(root, SHOWN, False)]  # what, whether it shows, whether an article or main is above
    while todo:
        x, state, inner = todo.pop()
        if x is None:
            close()
            continue
        if isinstance(x, str):
            if state == SHOWN:
                now.append(x)
            continue
        if x.tag in ("article", "main"):
            if not inner:
                tops[id(x)] = state == HIDDEN
            if state == LOW or state == HIDDEN and (id(x) in kept or x.tag == "main" and not inner):
                state = SHOWN
            inner = True
        elif x.tag in UNSEEN:
            state = GONE
        elif x is not root and (noise(x, inner, through) or x.tag == "header" and not inner):
            state = max(state, HIDDEN)
        elif x is not root and x.key in cut:
            state = max(state, LOW)
        if x.tag == "br" and state == SHOWN:
            now.append(" ")
        if x.tag in BLOCK:
            close()
            todo.append((None, state, inner))
        if state != GONE:
            todo += [(c, state, inner) for c in reversed(x.children) if state == SHOWN or isinstance(c, Node)]
    close()
    return out, tops


def blocks(root: Node, cut: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks that stay, white space folded, in page order. cut: keys of branches to leave out.

    A branch that is cut is left out but for the article and main elements in it. One that noise hides is left out whole, but for a main
    and for what may be the page itself (an element around all of it, or one never closed): hidden articles that are all the page has, or one longer than the rest. If nothing else stays, so does what stands in a form.
    """
    keyed(root)
    out, tops = walk(root, cut, frozenset())
    if tops and all(tops.values()) and (len(tops) == 1 or not out):
        more, _ = walk(root, cut, frozenset(tops))
        if sum(map(len, more)) > 2 * sum(map(len, out)):
            return more
    if not out:  # a form around the whole page is not one to fill in
        out, _ = walk(root, cut, frozenset(), frozenset({"form"}))
    return out


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "").split("/")[0].split("?")[0].split("#")[0].lower()


def features(root: Node) -> Iterator[tuple[int, int]]:
    """(node, feature) pairs of a page: for each element its presentation (odd feature) and the text below it (even feature)."""
    nodes = keyed(root)
    below: dict[int, int] = {}
    for n in reversed(nodes):
        h = 0
        for c in n.children:
            h = zlib.crc32(" ".join(c.split()).encode(), h) if isinstance(c, str) else zlib.crc32(below[id(c)].to_bytes(4, "little"), h)
        below[id(n)] = h
        yield n.key, h << 1
        yield n.key, zlib.crc32(">".join(c.tag for c in n.children if isinstance(c, Node)).encode()) << 1 | 1


def low_nodes(pages: DataFrame, importance: float = IMPORTANCE, mix: float = MIX, least: int = LEAST) -> DataFrame:
    """host, cut: the keys of its nodes whose importance is below the bound. Hosts without such nodes are left out."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            n = Counter((host, *f) for host, html in zip((host_of(u) for u in b.column("url").to_pylist()), b.column("html").to_pylist()) for f in features(parse(html or "")))
            yield pa.record_batch([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int64()), pa.array([k[2] for k in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["host", "node", "feature", "n"])

    counts = pages.select("url", "html").mapInArrow(counted, "host string, node long, feature long, n long").groupBy("host", "node", "feature").agg(F.sum("n").alias("n"))
    odd = F.col("feature").bitwiseAND(F.lit(1)) == 1
    nlog = F.col("n") * F.log2("n")
    sums = counts.groupBy("host", "node").agg(F.sum(F.when(odd, F.col("n"))).alias("m"), F.sum(F.when(odd, nlog)).alias("style"), F.sum(F.when(~odd, nlog)).alias("content"))
    entropy = lambda s: (F.log2("m") - F.col(s) / F.col("m")) / F.log2("m")
    low = sums.where((F.col("m") >= least) & (mix * entropy("content") + (1 - mix) * entropy("style") < importance))
    return low.groupBy("host").agg(F.collect_set("node").alias("cut"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    spark = pages.sparkSession
    small_batches(spark)
    low = staged(low_nodes(pages))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*://)?([^/?#]*)", 1))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            out = ["\n".join(blocks(parse(html or ""), frozenset(c or ()))) for html, c in zip(b.column("html").to_pylist(), b.column("cut").to_pylist())]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host")).join(low, "host", "left").select("page_id", "url", "html", "cut")
    return rows.mapInArrow(cut, "page_id long, url string, text string, n_chars long")


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
