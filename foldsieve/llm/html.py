"""Main text of web pages with a site style tree.

Pages of one host share a tree of styles: element paths (tags with classes),
and for every path the child sequences (presentation) and texts (content) seen
on the host's pages. A path's importance joins the entropy of its presentations
and of its contents, each over the logarithm of the pages that have the path,
so that 0 means alike everywhere and 1 means different everywhere (Yi, Liu, Li,
KDD 2003). Branches of low importance, and single texts that most pages of a
host hold at the same path, are removed.

What a page's markup says itself comes first: scripts, styles, forms, menus,
headers, footers, sidebars, notices, adverts and comments go by tag, role or
class. The tree prunes what is left, inside article and main too. Of the rest,
the article's blocks are taken if they hold half of the text or more, else
those of article and main, else all. Where the tree leaves nothing of an article
that held half of the page (a page seen many times), the article stays whole.

The tree is aggregated in Spark by (host, path, content) with partial sums, so a
host with a third of all pages is as many small groups as it has texts. Only
low-importance entries go back to the pages: a host has at most 1 / SHARE times
the texts of a page as common texts per path.

Defined cases: null or empty html gives an empty text; a null url is a host of
its own kind, and pages of hosts seen on fewer than LEAST_PAGES pages have no
low branches; repeated pages are all returned; an empty table gives an empty
result; other columns are not looked at. Broken markup is read as browsers do:
open elements end with their parents, an unended comment ends with the page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsieve.session import work_table

LEAST_PAGES = 4
LOW_IMPORTANCE = 0.3
SHARE = 0.5
DECAY = 0.9

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
SKIPPED = set(
    "script style noscript template head title nav footer aside form button select option textarea label input svg math canvas "
    "video audio object iframe embed map dialog menu datalist".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element of the key's kind ends at the start of one of these.
CLOSED_BY = {
    "p": BLOCKS - {"body", "html"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}
#: Words in class, id or role that mark an element as not part of an article.
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice popup modal overlay comment comments reply replies "
    "respond disqus share sharing social related recommended newsletter subscribe signup login search pagination pager widget "
    "masthead toolbar skip contentinfo complementary".split()
)
#: Of these, the words that also hold for an article element.
NOT_ARTICLE = {"comment", "comments", "reply", "ad", "advert", "advertisement", "promo", "sponsored", "related", "teaser"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S
)
MARKS = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """A page's blocks: (path key, rank, text); rank 2 in an article, 1 in main, 0 elsewhere. styles: by path, its child sequence."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, int, str]] = []
        self.styles: dict[str, list[str]] = {}
        self.stack: list[tuple[str, str, bool, int]] = []  # tag, path, skipped, rank
        self.open: list[str] = []
        at, n = 0, len(source)
        for found in iter(lambda: TOKEN.search(source, at), None):
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
                continue
            self._start(tag, found[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                self._end(tag)
        if at < n:
            self._text(source[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self.open.append(html.unescape(raw))

    def _flush(self) -> None:
        if self.open:
            text = " ".join("".join(self.open).split())
            self.open.clear()
            if text:
                path, rank = (self.stack[-1][1], self.stack[-1][3]) if self.stack else ("", 0)
                self.blocks.append((_key(path), rank, text))

    def _pop(self, to: int) -> None:
        """Close the open elements from the given place on."""
        if any(tag in BLOCKS for tag, *_ in self.stack[to:]):
            self._flush()
        del self.stack[to:]

    def _end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return

    def _start(self, tag: str, attributes: str) -> None:
        while self.stack and tag in CLOSED_BY.get(self.stack[-1][0], ()):
            self._pop(len(self.stack) - 1)
        if tag in BLOCKS:
            for i in range(len(self.stack) - 1, -1, -1):  # a paragraph also ends inside open inline elements
                if self.stack[i][0] == "p" and tag in CLOSED_BY["p"]:
                    self._pop(i)
                    break
                if self.stack[i][0] in BLOCKS:
                    break
            self._flush()
        if tag == "br":
            self.open.append(" ")
        marks, hidden = set(), False
        if attributes:
            for name, *values in MARKS.findall(attributes):
                name, value = name.lower(), "".join(values).lower()
                if name in ("class", "id", "role"):
                    marks |= set(re.split(r"[^a-z]+", value))
                hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
        if tag in ("article", "main") and not marks & NOT_ARTICLE:
            # an article never stands in a menu or the like: an element left open before it ends here
            for i, (other, _, skipped, _) in enumerate(self.stack):
                if skipped and other in ("nav", "aside", "header", "footer", "form", "head", "div", "ul", "section"):
                    self._pop(i)
                    break
        above = self.stack[-1] if self.stack else ("", "", False, 0)
        rank = above[3]
        if tag == "article":
            rank = 2
        elif tag == "main" or "main" in marks and tag in ("div", "section"):
            rank = max(rank, 1)
        if tag in ("html", "body"):
            noise = False
        elif tag in ("article", "main"):
            noise = bool(marks & NOT_ARTICLE)
        else:
            noise = bool(marks & NOISE) and not marks & {"with", "has", "no"} or tag == "header" and rank < 2
        path = above[1] + "/" + tag + ("." + ".".join(sorted(marks - {""})) if marks else "")
        skipped = above[2] or hidden or noise or tag in SKIPPED
        if not skipped and tag in BLOCKS:
            children = self.styles.setdefault(above[1], [])
            if not children or children[-1] != tag:
                children.append(tag)
        if tag not in VOID:
            self.stack.append((tag, path, skipped, rank))

    def main_text(self, low: frozenset[int] = frozenset(), common: frozenset[tuple[int, int]] = frozenset()) -> str:
        """The blocks without low paths and common texts: of the article or of main where these hold most, else of the page."""
        pruned = [b for b in self.blocks if b[0] not in low and (b[0], _key(b[2])) not in common]

        def marked(blocks: list[tuple[int, int, str]], least: int) -> list[str]:
            """The blocks of the rank or above, if they hold half of the text or more."""
            found = [text for _, rank, text in blocks if rank >= least]
            return found if 2 * sum(map(len, found)) >= sum(len(text) for *_, text in blocks) else []

        for least in (2, 1):
            left = any(rank >= least for _, rank, _ in pruned)
            kept = marked(pruned if left else self.blocks, least)
            if kept:
                return "\n".join(kept)
        return "\n".join(text for *_, text in pruned)


NODE = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.LongType())]
)


def host_of(url):
    """The url's host in lower case; null for none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, path, kind, value: of each page, every path's child sequence (kind 0), distinct texts (kind 1), and that it has any (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, kinds, values = [], [], [], []
            for host, source in zip(batch.column(0), batch.column(1)):
                page = Page(source.as_py() or "")
                nodes = {(_key(path), 0, _key(" ".join(children))) for path, children in page.styles.items()}
                nodes |= {(path, 1, _key(text)) for path, _, text in page.blocks}
                nodes |= {(path, 2, 0) for path, _, _ in page.blocks}
                for path, kind, value in nodes:
                    paths.append(path)
                    kinds.append(kind)
                    values.append(value)
                hosts += [host.as_py()] * len(nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.int64())],
                names=["host", "path", "kind", "value"],
            )

    return pages.select("host", F.col("html")).mapInArrow(run, NODE)


def low_branches(nodes: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW_IMPORTANCE, share: float = SHARE) -> DataFrame:
    """host, low (paths), common (path and text keys): the site style trees' unimportant entries.

    Nodes without kind 2 count as one text per page and path.
    """
    counts = nodes.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    sums = counts.groupBy("host", "path", "kind").agg(
        F.sum(n).alias("total"), F.sum(n * F.log(n)).alias("n_log_n"), F.count("*").alias("values")
    )
    # entropy over its largest value: log of the total, as if all were different
    entropy = F.when(F.col("total") > 1, 1 - F.col("n_log_n") / (F.col("total") * F.log("total"))).otherwise(1.0)
    styles = F.max(F.when(F.col("kind") == 0, F.col("values")))
    weight = F.pow(F.lit(DECAY), F.coalesce(styles, F.lit(1)))
    shape = F.coalesce(F.max(F.when(F.col("kind") == 0, entropy)), F.lit(0.0))
    words = F.max(F.when(F.col("kind") == 1, entropy))
    having = [F.max(F.when(F.col("kind") == kind, F.col("total"))) for kind in (2, 1)]
    trees = sums.groupBy("host", "path").agg(((1 - weight) * shape + weight * words).alias("importance"), F.coalesce(*having).alias("pages"))
    lows = trees.where((F.col("importance") < low) & (F.col("pages") >= least_pages)).select(
        "host", F.struct("path", F.lit(None).cast("long").alias("value")).alias("entry")
    )
    texts = counts.where("kind = 1").join(trees.select("host", "path", "pages"), ["host", "path"])
    common = texts.where((F.col("pages") >= least_pages) & (F.col("n") > share * F.col("pages"))).select(
        "host", F.struct("path", "value").alias("entry")
    )
    return lows.unionByName(common).groupBy("host").agg(F.collect_list("entry").alias("entries"))


def extract_main_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page: key, url, text, n_chars."""
    rows = pages.select(key, "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    # a table with one row per host: Spark can then split the pages of a hot host over many tasks
    trees = work_table(low_branches(style_nodes(rows)), "style-trees")
    joined = rows.join(trees, "host", "left").select(key, "url", "html", F.col("entries.path").alias("paths"), F.col("entries.value").alias("texts"))
    schema = rows.select(key, "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            known: tuple = (None, None)
            low = common = frozenset()
            for source, paths, texts in zip(*(batch.column(i) for i in (2, 3, 4))):
                paths, texts = paths.as_py() or [], texts.as_py() or []
                if (paths, texts) != known:
                    low = frozenset(p for p, t in zip(paths, texts) if t is None)
                    common = frozenset((p, t) for p, t in zip(paths, texts) if t is not None)
                    known = (paths, texts)
                out.append(Page(source.as_py() or "").main_text(low, common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=schema.names
            )

    return joined.mapInArrow(run, schema)
