"""Main text of web pages, with a site's template taken out.

Each page is parsed once, in linear time, to its text blocks and a hash of every element's
subtree (tag, class, id, and all it holds).  Spark counts, by host, in how many different
pages each subtree occurs; a page and its exact copies are one.  Subtrees that recur
are the site's template, and their blocks go, inside the element that a page calls its
main content and outside it.  Mark-up alone rules out only what HTML itself defines as no
content (menus, footers, asides, forms, scripts, hidden elements, articles in an article,
which are its comments).  Outside the main content, where a host has too few pages to
tell, a word of a class or id (advert, cookie, sidebar ...) rules an element out too, but
never what holds the main content or most of the text.  Last, where the main content
holds half of the text that is left, or more, the rest goes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, durable, fields, scratch, table, wider

#: Different pages from which on a subtree is a template of its host; tags with a quote that
#: never closes from which on quotes shield no > in the rest of a page.
RECURS, BROKEN = 8, 16

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*>?|<![^>]*>?"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
#: The same where quotes shield nothing, and what swallows the rest of a page behind its last >.
_UNQUOTED = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*>?|<![^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|(?!)()()()""", re.S)
_REST = re.compile(r"<(?:[!?]|/(?![a-zA-Z]))")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[^a-z0-9]+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_GONE = frozenset("script style head title nav footer aside form noscript template svg math canvas object iframe button select textarea dialog menu audio video datalist noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup popup modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead toolbar "
    "comment comments respond disqus share sharing social related recommended widget skip login header".split()
)
#: Whole names of a class or id that say reader comments or adverts, whatever their share of a page.
_STRONG = frozenset(
    "comment comments comment-list comments-list commentlist comments-area comments-section comment-section user-comments reader-comments respond disqus_thread "
    "advert adverts advertisement advertisements ad-container ad-slot adsbygoogle".split()
)
#: An open element that a start tag closes, and the elements that stop the search for it.
_CLOSES = {t: frozenset([t]) for t in ("li", "option", "tr")} | {t: frozenset(["dt", "dd"]) for t in ("dt", "dd")} | {t: frozenset(["td", "th"]) for t in ("td", "th")}
_CLOSES |= {t: frozenset(["tr", "td", "th"]) for t in ("tr", "tbody", "thead", "tfoot")}
_BOUND = frozenset("html body article main section div table ul ol dl nav aside footer header form td th".split())
_ENDS_P = _BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd td th tr tbody table b i em strong a span br".split())


class _Node:
    __slots__ = ("article", "first", "gone", "hashed", "holds", "last", "live", "main", "marked", "mute", "named", "nested", "parent", "parts", "region", "size", "strong", "tag", "within")

    def __init__(self, tag: str, parent: "_Node | None", gone: bool, main: int, named: str, marked: bool, mute: bool) -> None:
        self.tag, self.parent, self.gone, self.main, self.named, self.marked, self.mute = tag, parent, gone, main, named, marked, mute
        self.parts, self.size, self.hashed = [tag, named], 0, 0
        self.live, self.holds, self.region = 0, False, self  # text that is not gone; holds the main region
        self.article = self if tag == "article" else parent.article if parent else None
        self.nested = 0  # text of the articles in an article
        self.strong = self.within = False  # named as comments or an advert; it, or what it is in
        self.first, self.last = 1 << 30, -1  # blocks that are left


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def parse(html: str, names: bool = True) -> list[tuple[str, bool]]:
    """(text, ruled out) of the blocks as mark-up alone has them, with no other page of the
    host to ask; a block is ruled out also for lying outside the main content."""
    blocks, *_ = weighed(html, names)
    best = max((level for _, level in blocks), default=0)
    return [(t, level < best) for t, level in blocks]


def weighed(html: str, names: bool = True) -> tuple[list[tuple[str, int]], list[tuple[int, int, int]], int]:
    """(blocks, subtrees, page): a block that no mark-up rules out is its text and its level,
    2 in <main>, 1 in <article>, 0 elsewhere; a subtree that may be template is its hash, its
    first block and the one behind its last; page is a hash of the whole page.

    In <article> and <main>, paragraphs, headings, items, cells and inline elements
    are no template however often they recur, for near copies and quoted passages
    recur too; nor is an element with more than half of its region's text.  The
    largest region of the highest level, and what holds it, is none either.

    names: whether a word of a class or id outside <article> and <main> rules an element
    out.  It does not rule out what holds <main> or the only <article>, nor, on a page
    without these, what has more than half of the text.  A name that says comments or
    advert rules out any share of such a page, and up to half of an <article> or <main>.
    Articles in an article are ruled out where they hold at most three quarters of its text."""
    root = _Node("", None, False, 0, "", False, False)
    stack, nodes, blocks, text, opened = [root], [], [], [], Counter()

    def flush() -> None:
        if text:
            words = unescape("".join(text)).split()
            text.clear()
            if words:
                block, node = " ".join(words), stack[-1]
                while (node.gone or node.mute) and node.tag not in _BLOCK and node.parent is not None:
                    node = node.parent  # what an inline element hides was never kept
                blocks.append((block, node))
                node.parts.append(block)
                node.size += len(block)

    def pop() -> None:
        node = stack.pop()
        opened[node.tag] -= 1
        node.hashed = xxhash.xxh64_intdigest("\x1f".join(node.parts)) - (1 << 63)
        if node.size:
            node.parent.parts.append(str(node.hashed))
            node.parent.size += node.size

    def close(tags: frozenset[str], bound: frozenset[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in bound:
                return

    at, n, end, broken = 0, len(html), html.rfind(">") + 1, 0
    while at < n:
        m = (_TOKEN if broken < BROKEN else _UNQUOTED).search(html, at, end) if at < end else _REST.search(html, at)
        shown = stack[-1].tag in _BLOCK or not (stack[-1].gone or stack[-1].mute)
        upto = m.start() if m else max(end, at) if at < end else n
        if shown and upto > at:
            text.append(html[at:upto])
        if not m:
            at = upto
            continue
        if at >= end:
            break
        at = m.end()
        if m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "]]>")):
            break
        close_, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        broken += bool(m[5])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if close_:
            if opened[tag]:
                inline = tag not in _BLOCK
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        if any(x.tag in _BLOCK for x in stack[k + 1 :]) or not inline:
                            flush()
                        if inline and any(x.tag in _BLOCK for x in stack[k + 1 :]):
                            break  # misnested formatting; it ends with its block
                        if text:
                            held = text[:]
                            text.clear()
                        else:
                            held = []
                        while len(stack) > k:
                            pop()
                        text.extend(held)
                        break
                    if inline and stack[k].tag in _BLOCK and stack[k].tag in _BOUND:
                        break
            continue
        if tag in _ENDS_P:
            close(frozenset(["p"]), _BOUND)
        if tag in _CLOSES:
            close(_CLOSES[tag], _BOUND - _CLOSES[tag])
        if tag in _VOID:
            continue
        got = _attributes(raw)
        parent = stack[-1]
        named = f"{got.get('class', '')} {got.get('id', '')}".strip().lower()
        main = parent.main
        if not main:
            main = 2 if tag == "main" or got.get("role") == "main" else 1 if tag == "article" else 0
        elif main == 1 and (tag == "main" or got.get("role") == "main"):
            main = 2
        gone = parent.gone or tag in _GONE or got.get("role", "") in _ROLES or "hidden" in got or got.get("aria-hidden") == "true"
        gone = gone or "display:none" in got.get("style", "").replace(" ", "").lower() or (tag == "header" and not main)
        marked = names and bool(named) and not main and tag not in ("html", "body") and not _MARKS.isdisjoint(_WORDS.split(named))
        node = _Node(tag, parent, gone, main, named, marked, tag not in _BLOCK and (parent.mute or marked))
        node.strong = names and tag not in ("html", "body", "main", "article") and not _STRONG.isdisjoint(named.split())
        node.within = node.strong or parent.within
        stack.append(node)
        opened[tag] += 1
        nodes.append(node)
        if tag in _RAW:
            e = _RAW[tag].search(html, at)
            at = e.end() if e else n
            stack.pop()
            opened[tag] -= 1
        elif raw.endswith("/") and tag in ("svg", "math"):
            stack.pop()
            opened[tag] -= 1
    flush()
    while len(stack) > 1:
        pop()
    root.hashed = xxhash.xxh64_intdigest("\x1f".join(root.parts)) - (1 << 63)

    for t, node in blocks:
        if not node.gone:
            node.live += len(t)
    for x in reversed(nodes):
        x.parent.live += x.live
    inner = [x for x in nodes if x.tag == "article" and x.parent.article is not None]
    for x in inner:
        x.parent.article.nested += x.live
    for x in inner:
        x.gone = x.gone or 4 * x.parent.article.nested <= 3 * x.parent.article.live
    regions = [x for x in nodes if x.live and x.main > x.parent.main and not x.within]
    x = max(regions, key=lambda x: (x.main, x.live), default=root)
    alone = x.main == 2 or sum(y.main == x.main for y in regions) == 1  # else there is none, or a list
    spared = set()
    while x is not root:
        x.holds = True
        if alone:
            spared.add(x)
        x = x.parent
    for x in nodes:
        x.region = x if x.main > x.parent.main else x.parent.region
        x.gone = x.gone or x.parent.gone or (x.marked and x not in spared and (alone or 2 * x.live <= root.live))
        x.gone = x.gone or (x.strong and not x.holds and (2 * x.live <= x.region.live if x.main else x.live < root.live))
    left = [(t, x) for t, x in blocks if not x.gone]
    for k, (_, x) in enumerate(left):
        x.first, x.last = min(x.first, k), k
    for x in reversed(nodes):
        x.parent.first, x.parent.last = min(x.parent.first, x.first), max(x.parent.last, x.last)
    may = []
    for x in nodes:
        if x.last >= 0 and not x.gone and not x.holds and x.tag not in ("html", "body"):
            if not x.main or x is x.region or (x.tag not in _PLAIN and 2 * x.live <= x.region.live):
                may.append((x.hashed, x.first, x.last + 1))
    return [(t, x.main) for t, x in left], may, root.hashed


_PARSED = "blocks array<struct<text:string,level:int>>, subtrees array<struct<h:bigint,lo:int,hi:int>>, page bigint"


def _parsed(pages: DataFrame, names: bool) -> DataFrame:
    """pages, whose last column is the html, with what weighed() gives in its place."""
    keep = pages.columns[:-1]
    kinds = [pa.list_(pa.struct([("text", pa.string()), ("level", pa.int32())])), pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                got = [weighed(h.as_py() or "", names) for h in b.column(len(keep))]
                blocks = pa.array([[{"text": t, "level": v} for t, v in x] for x, *_ in got], kinds[0])
                subtrees = pa.array([[{"h": h, "lo": lo, "hi": hi} for h, lo, hi in x] for _, x, _ in got], kinds[1])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], blocks, subtrees, pa.array([x for *_, x in got], pa.int64())], [*keep, "blocks", "subtrees", "page"])

    return pages.mapInArrow(run, wider(pages.select(keep).schema, _PARSED))


def _main(blocks: Column) -> Column:
    """The blocks of <main> if they hold half of the text or more, else those of <main>
    and <article> if they do, else all."""
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda n, b: n + F.length(b.text))
    level = lambda n: F.filter(blocks, lambda b: b.level >= n)
    half = lambda n: 2 * chars(level(n)) >= chars(blocks)
    return F.when(half(2), level(2)).when(half(1), level(1)).otherwise(blocks)


#: From the subtrees of a page that are template (nested or apart, as runs of blocks): the outermost ones, and the blocks they leave.
_OUTER = "aggregate(sort_array(_gone), named_struct('end', 0, 'runs', CAST(array() AS ARRAY<STRUCT<lo: INT, hi: INT>>)), (a, g) -> IF(-g.less <= a.end, a, named_struct('end', -g.less, 'runs', concat(a.runs, array(named_struct('lo', g.lo, 'hi', -g.less)))))).runs"
_LEFT = f"transform(array_except(sequence(0, size(blocks) - 1), flatten(transform({_OUTER}, g -> sequence(g.lo, g.hi - 1)))), i -> blocks[i])"


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", recurs: int = RECURS, names: bool = True) -> DataFrame:
    """pages without html_col, with text (empty if none) and n_chars.

    Columns of pages named text or n_chars, whatever their case, give way, and so do columns
    that differ from another in case only.  A null html is empty.  Pages without a host, or
    with a null url, are one host.  Pages of any length are parsed whole, in time in
    proportion to their length.  Every row stays, also repeated ones; exact copies of a
    page count as one.  No rows give no rows.  A host may have most of the pages: its
    subtrees are counted by (host, subtree, page) first, and the join back is an inner join
    that adaptive execution can split.  names: see weighed().
    """
    given, rest = apart(pages, (url_col, html_col), ("text", "n_chars"), whole=True)
    rest = [c for c in rest if c != html_col]
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")).alias("_host")
    more = given.select(F.struct(*fields(rest)).alias("_row_") if rest else F.struct(F.lit(True).alias("_")).alias("_row_"), host, F.monotonically_increasing_id().alias("_row"), html_col)
    with scratch() as keep:
        parsed = keep(durable(_parsed(more, names), "pages"))
        found = parsed.select("_row", "_host", "page", F.explode("subtrees").alias("s")).select("_row", "_host", "page", "s.h", "s.lo", "s.hi")
        template = found.select("_host", "h", "page").distinct().groupBy("_host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= recurs)
        gone = found.join(template.select("_host", "h"), ["_host", "h"]).groupBy("_row").agg(F.collect_list(F.struct("lo", (-F.col("hi")).alias("less"))).alias("_gone"))
        gone = keep(durable(gone, "gone"))
    # a page in which nothing recurs needs no join
    blocks = F.when(F.col("_gone").isNull() | (F.size("blocks") == 0), F.col("blocks")).otherwise(F.expr(_LEFT))
    both = parsed.join(gone, "_row", "left").select("_row_", blocks.alias("blocks"))
    kept = F.transform(F.array("blocks"), _main)[0]
    text = F.array_join(F.transform(kept, lambda b: b.text), "\n")
    return both.select(*fields(rest, "_row_"), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
