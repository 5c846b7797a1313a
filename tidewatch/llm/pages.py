"""Main text of web pages, with the site's own template removed.

Every element is hashed with all it holds; Spark counts the different pages of a host that hold each subtree
(in an article, the different articles), and those that recur across many go. What names itself a menu,
footer, advert and so on goes on any page.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import arrow_map, hash_side, table, written
from tidewatch.llm.urls import host_of

# Element names by what they do to the text, and names that classes and ids give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form script style noscript iframe template svg math button select textarea input object canvas audio video dialog menu title xmp noembed noframes".split())
BLOCKS = frozenset("address article blockquote body br dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 head hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("br body head html tbody td tfoot th thead tr".split()) | frozenset("nav header footer aside form menu".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table article main section div body html nav aside footer header form".split())
NAMES = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related share sharing sidebar signup skip social sponsored subscribe topbar".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</[^a-zA-Z][^>]*>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+\Z""", re.S)
_LOOSE = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


@dataclass
class Node:
    tag: str
    attributes: str = ""
    dropped: bool = False  #: this element or one around it isn't the article by name
    main: bool = False  #: in an article or main element
    parts: list = field(default_factory=list)  #: texts and nodes


def _is_named_away(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and not NAMES.isdisjoint(value.split()):
            return True
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))


def tree(page: str) -> Node:
    """The page's elements. Unclosed and stray tags are mended: a block ends an open p, an li ends the one before, an end tag closes what it holds, and a broken tag at the end is left out."""
    root = Node("#root")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # of each element's name, where it stands in the stack

    def say(text: str) -> None:
        if text:
            stack[-1].parts.append(text)

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names: tuple[str, ...], fences: frozenset = FENCES) -> None:
        top = last(names)
        if top and top >= last(fences):
            while len(stack) > top:
                places[stack.pop().tag].pop()

    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            say(page[at:])
            break
        say(page[at:less])
        m = _TAG.match(page, less) or _LOOSE.match(page, less)
        if not m:
            say("<")
            at = less + 1
            continue
        at = m.end()
        if m.lastindex is None or m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close((tag,), frozenset() if tag in FENCES else FENCES)
            continue
        if tag in CLOSES_P:
            close(("p",))
        if tag in CLOSES:
            close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "article", "main")))
        above = stack[-1]
        node = Node(tag, m[3].strip(), above.dropped or _is_named_away(tag, m[3]), above.main or tag in MAIN or 'role="main"' in m[3])
        above.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = len(page) if not end else end.start()
            if not end:
                continue
            shut = page.find(">", at)
            at = len(page) if shut < 0 else shut + 1
        elif tag not in VOID and not m[3].endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


@dataclass
class Page:
    blocks: list  #: (text, place in `chain` of the innermost element around it, or -1) in page order
    chain: list  #: (hash, place of the next element outside it, or -1) of elements around blocks, outer ones first
    subtrees: list  #: hashes of all elements outside the article
    article: int | None  #: a hash of the article's text; None without an article

    def around(self) -> set[int]:
        """Hashes of all elements around blocks."""
        return {h for h, _ in self.chain}

    def without(self, gone: set[int]) -> str:
        """The blocks that stand in no element of these hashes, joined by spaces."""
        out = []
        for h, outer in self.chain:
            out.append(h in gone or outer >= 0 and out[outer])
        return " ".join(text for text, at in self.blocks if at < 0 or not out[at])


def parsed(page: str | None) -> Page:
    root = tree(page or "")
    blocks, subtrees, chain = [], [], []
    held: list[str] = []

    def digest(node: Node) -> bytes:
        own = hashlib.blake2b(f"<{node.tag} {node.attributes}>".encode("utf-8", "replace"), digest_size=8)
        for p in node.parts:
            own.update(p.encode("utf-8", "replace") if isinstance(p, str) else main_digest if p.main and not node.main else hashes[id(p)])
        return own.digest()

    hashes: dict[int, bytes] = {}

    def flush(around: list | None) -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if not text:
            return
        # Elements around the block that have no place yet get one, the outermost first.
        new = []
        while around and around[2] < 0:
            new.append(around)
            around = around[1]
        place = around[2] if around else -1
        for link in reversed(new):
            chain.append((link[0], place))
            place = link[2] = len(chain) - 1
        blocks.append((text, place))

    # Depth first without recursion, as pages nest as deep as they like: hashes on the way out.
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node)]
    has_main = any(n.main and not n.dropped for n in order)
    # What surrounds an article is the same whatever the article is.
    main_digest = hashlib.blake2b(b"main", digest_size=8).digest()
    for node in reversed(order):
        hashes[id(node)] = digest(node)
        if not node.main and node.tag not in ("#root", "html", "body") and not any(isinstance(p, Node) and p.main for p in node.parts):
            subtrees.append(int.from_bytes(hashes[id(node)], "little", signed=True))
    # The elements around a block are linked: [hash, the link outside it, its place in `chain`]; deep pages share them.
    walk: list = [(root, iter(root.parts), None)]
    while walk:
        node, parts, around = walk[-1]
        p = next(parts, None)
        if p is None:
            if node.tag in BLOCKS or node.dropped:
                flush(around)
            walk.pop()
        elif isinstance(p, str):
            if not node.dropped and (node.main or not has_main):
                held.append(p)
        elif p.dropped:
            flush(around) if p.tag in BLOCKS or p.tag in DROPPED else None
        elif p.tag in VOID:
            if p.tag in BLOCKS and held:
                held.append(" ")
        else:
            inner = around
            if p.main == has_main and p.tag not in ("html", "body"):
                inner = [int.from_bytes(hashes[id(p)], "little", signed=True), around, -1]
            if p.tag in BLOCKS:
                flush(around)
            walk.append((p, iter(p.parts), inner))
    flush(None)
    if not has_main:
        return Page(blocks, chain, subtrees, None)
    text = hashlib.blake2b(" ".join(t for t, _ in blocks).encode("utf-8", "replace"), digest_size=8).digest()
    return Page(blocks, chain, subtrees, int.from_bytes(text, "little", signed=True))


@dataclass(frozen=True)
class Recurring:
    """A subtree belongs to the site's template if it stands on so many different pages of its host, and on so large a share of them or on `enough`."""

    pages: int = 5
    share: float = 0.2
    enough: int = 48


_SEEN = "host string, inside boolean, page long, subtree long"


def templates(pages: DataFrame, url: str = "url", html: str = "html", rule: Recurring = Recurring()) -> DataFrame:
    """(host, subtree) of what recurs: outside articles on different pages, inside them in articles of different text.

    So neither a copied page nor an article that stands on many pages is a template of itself.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows: list[tuple] = []
            for host, h, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = parsed(page)
                rows += [(host, False, h, s) for s in {None, *own.subtrees}]
                if own.article is not None:
                    rows += [(host, True, own.article, s) for s in {None, *own.around()}]
            columns = zip(*rows) if rows else ([], [], [], [])
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "inside", "page", "subtree"])

    source = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(html).alias("page"), F.col(html).cast("string").alias("html"))
    # Rows without a subtree count pages and articles. Counts group by a host and a hash first, so a host with a third of all pages is spread out.
    seen = written(arrow_map(source, read, _SEEN).distinct().groupBy("host", "inside", "subtree").count().where((F.col("count") >= rule.pages) | F.col("subtree").isNull()), "seen")
    of = seen.where(F.col("subtree").isNull()).select("host", "inside", F.col("count").alias("n"))
    found = seen.where(F.col("subtree").isNotNull() & (F.col("count") >= rule.pages)).join(of, ["host", "inside"])
    return found.where(F.col("count") >= F.least(rule.share * F.col("n"), F.lit(float(rule.enough)))).select("host", "subtree").distinct()


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rule: Recurring = Recurring(), most_sent: int = 1_000_000) -> DataFrame:
    """page_id, url and text of every row, text being the article's blocks joined by spaces.

    The article is what stands in article or main elements, or the whole body where there are
    none, without the host's templates. Up to `most_sent` templates are sent to all tasks (8 bytes
    each); more are joined. Null and empty pages have an empty text; a null url has an empty host;
    pages of any length are read whole; repeated rows come out alike; an empty table gives an empty one.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    gone = written(templates(pages, url, html, rule), "templates")
    if gone.count() > most_sent:
        return _joined(source, kind, gone)
    pair = F.xxhash64("host").bitwiseXOR(F.col("subtree")).alias("pair")
    sent = source.sparkSession.sparkContext.broadcast(np.sort(gone.select(pair).toArrow().column(0).to_numpy()))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in parts:
            texts = []
            for host, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own = parsed(page)
                around = np.fromiter(own.around(), np.int64)
                pairs = around ^ np.int64(host)
                at = np.searchsorted(known, pairs)
                hit = known[np.minimum(at, len(known) - 1)] == pairs if len(known) else np.zeros(len(pairs), bool)
                texts.append(own.without(set(around[hit].tolist())))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    hashed = source.select("page_id", "url", F.xxhash64(host_of(F.col("url"))).alias("host"), "html")
    return arrow_map(hashed, read, f"page_id {kind}, url string, text string")


def _joined(source: DataFrame, kind: str, gone: DataFrame) -> DataFrame:
    """The same for any number of templates: only hashes of subtrees meet them, and a page's own come back to it."""

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            around = pa.array([[*parsed(x).around()] for x in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), b.column(1), around], ["row", "host", "around"])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = [parsed(x).without(set(gone or ())) for x, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    # Pages of one host and text share a row number; so do what they lose.
    rows = source.withColumns({"_host": host_of(F.col("url")), "_row": F.xxhash64(host_of(F.col("url")), "html")})
    around = arrow_map(rows.select("_row", "_host", "html"), hashed, "row long, host string, around array<long>")
    met = around.select("row", "host", F.explode("around").alias("subtree")).distinct().join(gone, ["host", "subtree"])
    found = written(met.groupBy(F.col("row").alias("_row")).agg(F.collect_set("subtree").alias("gone")), "found")
    chosen = rows.join(hash_side(found, F.size("gone") + 4, 5_000_000), "_row", "left").select("page_id", "url", "html", "gone")
    return arrow_map(chosen, read, f"page_id {kind}, url string, text string")


def op6_html_extraction(spark, sf_dir):
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
