"""Main text of web pages by a style tree of each site."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import join_groups, text_of
from gridledger.session import materialize

# A node of a site's tree is kept from this importance on.
THRESHOLD = 0.8
# The importance of a node on a site of few pages leans on all sites, as much as so many pages.
PRIOR_PAGES = 50
# How fast the weight of the content falls with the number of presentations of a node.
GAMMA = 0.9
ROWS = 64

# HTML elements by their part in the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset(
    "head script style noscript template title nav footer aside form button select option textarea input iframe "
    "object embed svg canvas menu dialog".split())
MAIN = frozenset("article main".split())
CORE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption article main".split())
# Closing rules: an element of the key ends an open one of the values.
CLOSES = {
    **{tag: frozenset(("p",)) for tag in
       "p address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre "
       "section table ul".split()},
    "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")),
    "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
    "option": frozenset(("option",)),
}
SCOPE = frozenset("table ul ol dl div section article main aside nav footer header form body html".split())
# Words of class, id and role that mark menus, notices, adverts, forms and reader comments. A name counts if all of its
# words are here: "cookie-notice" does, "content-sidebar-wrap" does not. Inside an article ids do not count.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted recommended related replies reply search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split())

# A tag whose quotes are closed within so many characters; one whose are not ends at the next ">".
TAG_LENGTH = 1 << 14
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""", re.S)
_TAG_START = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_SENTENCE = re.compile(r"[.!?;:·|•]+\s*")
_WORD = re.compile(r"[a-z]+")


class _Node:
    """An open element. Its id in the site's tree is a hash of its parent's id and its own label."""

    __slots__ = ("tag", "id", "state", "inside", "styles", "marked", "holds", "under")

    def __init__(self, tag, node_id, state, inside, marked=False, under=None):
        self.tag, self.id, self.state, self.inside, self.styles = tag, node_id, state, inside, []
        # Named as no main text, with an article in it, and the named nodes from here to the root, as a linked list.
        self.marked, self.holds, self.under = marked, False, (self, under) if marked else under


def _chain(under) -> Iterator[_Node]:
    while under:
        node, under = under
        yield node


class Block:
    """Text of one node between block boundaries. ``state``: 0 never main text, 1 core of an article, 2 open."""

    __slots__ = ("id", "state", "inside", "text", "under")

    def __init__(self, node_id: int, state: int, inside: bool, text: str, under: tuple | None = None):
        self.id, self.state, self.inside, self.text, self.under = node_id, state, inside, text, under

    def is_marked(self) -> bool:
        return any(n.marked for n in _chain(self.under))


def _attributes(text: str) -> dict[str, str]:
    """Names, lower-cased, and values of the attributes of a tag; of repeated names the first."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2].strip("\"'") if m[2] else "")
    return found


def _hidden(given: dict[str, str]) -> bool:
    return ("hidden" in given and given["hidden"].strip().lower() not in ("false", "until-found")
            or given.get("aria-hidden", "").strip().lower() == "true"
            or "style" in given and bool(_NO_DISPLAY.search(unescape(given["style"]))))


def _opened(tag: str, attributes: str, above: _Node) -> _Node:
    given = _attributes(attributes) if attributes else {}
    own = " ".join(given[k].lower() for k in ("class", "role") if k in given)
    names = f"{own} {given.get('id', '').lower()}" if given else ""
    words = set(_WORD.findall(names)) if given else set()
    state, marked = 2, False
    if above.state == 0 or tag in NEVER or (given and _hidden(given)):
        state = 0
    elif tag == "header" and not above.inside:
        state = 0
    elif words & MARKS and tag not in ("html", "body", "main"):
        whole = [set(found) for n in (own if above.inside or tag in CORE else names).split()
                 if (found := _WORD.findall(n)) and MARKS.issuperset(found)]
        marked = bool(whole) and not (above.inside and set().union(*whole) <= {"header"}) and not (
            tag == "article" and not words & {"comment", "comments"})
        if marked and above.inside:
            state, marked = 0, False
    inside = above.inside or (state > 0 and not marked and (
        tag in MAIN or "articlebody" in given.get("itemprop", "").lower() or "main" in words))
    if inside and not above.inside:
        for node in _chain(above.under):
            node.marked, node.holds = node.marked and tag != "main", True
    if state == 2 and inside and tag in CORE:
        state = 1
    label = tag if not words else f"{tag}.{'.'.join(sorted(words))}"
    return _Node(tag, _hash(label, above.id), state, inside, marked, above.under)


def _next_tag(html: str, at: int) -> tuple[int, int, re.Match | None]:
    """Where the next tag, comment or declaration begins and ends, and the match of a well-formed tag.

    Every step looks at a bounded stretch or for the first of something, so a
    page full of unclosed quotes takes linear time.
    """
    size, last = len(html), False
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            return at, size if end < 0 else end + 3, None
        # No ">" after here: no more tags, but perhaps a comment that is never closed.
        end = -1 if last else html.find(">", at)
        last = end < 0
        if not last:
            tag = _TAG.match(html, at, min(size, at + TAG_LENGTH))
            if tag:
                return at, tag.end(), tag
            if html.startswith(("<!", "<?"), at) or _TAG_START.match(html, at):
                return at, end + 1, None
        at += 1
    return size, size, None


def parse(html: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks of a page in order, and its nodes with the sequence of their children (their presentation).

    Lenient like a browser: open paragraphs, list items and cells are closed
    where a new one begins, unknown end tags are passed over, and what is open
    at the end is closed there.
    """
    root = _Node("", 0, 2, False)
    stack, blocks, nodes, parts = [root], [], [], []
    holders, opened = [root], Counter()

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                holder = holders[-1]
                blocks.append(Block(holder.id, holder.state, holder.inside, text, holder.under))
            parts = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            opened[node.tag] -= 1
            if node.tag not in INLINE:
                flush()
                nodes.append((node.id, " ".join(node.styles)))
                holders.pop()

    at, size = 0, len(html)
    while at < size:
        stop, after, tag = _next_tag(html, at)
        if stop > at and stack[-1].state:
            parts.append(unescape(html[at:stop]))
        at = after
        if not tag:
            continue
        name = tag[2].lower()
        if tag[1]:
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
            elif name == "p":
                flush()
            continue
        ends = CLOSES.get(name)
        if ends and any(opened[t] for t in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if name in VOID:
            if name == "br" or name not in INLINE:
                parts.append(" ")
                if name == "hr":
                    flush()
            continue
        node = _opened(name, tag[3], stack[-1])
        if name in INLINE:
            if node.marked:
                node.state = 0
            elif node.state and node.state != stack[-1].state:
                node.state = stack[-1].state
        else:
            flush()
            holders[-1].styles.append(name)
            holders.append(node)
        stack.append(node)
        opened[name] += 1
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(html, at)
            at = end.start() if end else size
    close(1)
    flush()
    if not any(b.inside and b.state and not b.is_marked() for b in blocks):
        # The only articles are in branches named as something else, which then are not that.
        for node in {n for b in blocks if b.inside for n in _chain(b.under) if n.holds}:
            node.marked = False
    return [b for b in blocks if not b.is_marked()], nodes


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed & (1 << 64) - 1) - (1 << 63)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (host, node, kind, feature, n, n log n): for each page its nodes (0), presentations (1), sentences (2)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            found: Counter = Counter()
            costs: Counter = Counter()
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                blocks, nodes = parse(html)
                own = Counter((node, 1, style) for node, style in nodes)
                own.update((b.id, 2, s) for b in blocks for s in _SENTENCE.split(b.text) if s)
                own.update({(node, 0, "") for node, _, _ in own})
                for key, n in own.items():
                    found[host, *key] += n
                    costs[host, *key] += n * log(n)
            hosts, ids, kinds, features = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()),
                pa.array(map(_hash, features), pa.int64()), pa.array(found.values(), pa.int64()),
                pa.array(costs.values(), pa.float64())], ["host", "node", "kind", "feature", "n", "nlogn"])


def _importance(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Importance of the nodes of merged pages.

    With m pages, the entropy of a feature is that of its spread over pages,
    in logarithms to the base m: 0 if one page has it, 1 if all have it
    alike. A node's content counts 1 less the mean entropy of its features.
    The entropy of its presentations counts for the more, the more of them
    there are. A node on one page has importance 1.
    """
    features = counts.groupBy(*keys, "kind", "feature").agg(F.sum("n").alias("n"), F.sum("nlogn").alias("c"))
    spread = F.log("n") - F.col("c") / F.col("n")
    pages = F.sum(F.when(F.col("kind") == 0, F.col("n")))
    nodes = features.groupBy(*keys).agg(
        pages.alias("pages"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("shown"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("shown_cost"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("styles"),
        F.avg(F.when(F.col("kind") == 2, spread)).alias("content"))
    base = F.log("pages")
    content = 1 - F.coalesce("content", F.lit(0.0)) / base
    shown = F.coalesce((F.log("shown") - F.col("shown_cost") / F.col("shown")) / base, F.lit(0.0))
    weight = F.pow(F.lit(GAMMA), F.greatest(F.col("styles") - 1, F.lit(0)))
    importance = F.when(F.col("pages") <= 1, 1.0).otherwise((1 - weight) * F.least(shown, F.lit(1.0)) + weight * content)
    return nodes.select(*keys, "pages", importance.alias("importance"))


def _sites(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), text_of("html").alias("html"))


def weak_nodes(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per site the nodes of low importance: ``host, weak, pages``."""
    sites = _sites(pages)
    counts = sites.select("host", "html").mapInArrow(
        _statistics, "host string, node long, kind int, feature long, n long, nlogn double")
    counts = materialize(counts.groupBy("host", "node", "kind", "feature").agg(
        F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn")), "page-features")
    everywhere = _importance(counts, ["node"]).select("node", F.col("importance").alias("all"))
    here = _importance(counts, ["host", "node"]).join(everywhere, "node")
    blended = (F.col("pages") * F.col("importance") + PRIOR_PAGES * F.col("all")) / (F.col("pages") + PRIOR_PAGES)
    low = here.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(blended < threshold, F.col("node")))).alias("weak"), F.max("pages").alias("pages"))
    return low.filter(F.size("weak") > 0)


def extracted(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``.

    ``pages`` needs ``page_id, url, html``; other columns are not read. Pages
    of one host, lower-cased, are merged into one tree of nodes, told apart by
    the elements and class names above them. Blocks of weak nodes go, save
    paragraphs, headings, items and cells of an article, which stay even if
    many pages repeat them. Menus, headers, footers, sidebars, notices,
    adverts, forms and reader comments go by their elements and names, but
    not the only article inside one so named. References are
    decoded, white space inside a block becomes one space, blocks are joined
    by line ends. A null or empty page has an empty text; pages with a null or
    odd url form one site. Each row gives one row.
    """
    sites = _sites(pages)
    weak = materialize(weak_nodes(pages, threshold), "weak-nodes")
    found = join_groups(sites, weak, "host", "pages", pages.count(), "page_id")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [main_text(html, set(low or ())) for html, low in zip(
                    part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    rows = found.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "weak")
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def main_text(html: str, weak: set[int]) -> str:
    """The kept blocks of one page."""
    blocks, _ = parse(html)
    return "\n".join(b.text for b in blocks if b.state and (b.state == 1 or b.id not in weak))
