"""Main text of web pages: site templates are found by counting element subtrees per host."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baroflow.plans.staging import stage

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe template svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var br wbr img".split()
)
#: Elements that are no article text wherever they stand.
DROPPED_TAGS = frozenset(
    "head nav header footer aside form script style textarea title xmp noscript iframe template svg button select "
    "option input menu dialog canvas object audio video".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Class tokens and ids that mark such elements, whole or joined from these alone ("cookie-banner").
DROPPED_NAMES = frozenset(
    "ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "alert sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments "
    "disqus respond share sharing social related recommended newsletter subscribe subscription popup modal overlay "
    "pagination pager toolbar login signup search".split()
)
MAIN = frozenset(("article", "main"))
#: Characters below which a marked element beside an article is no main text, however short the article.
SHORT = 250
#: Where a subtree stands on a page; both at once is their sum.
OUTSIDE, INSIDE = 1, 2
#: Containers; inside an article only these can be part of a template, never its text blocks.
CONTAINERS = frozenset("div section ul ol dl figure details".split())
#: Start tags that end an open element of the same family.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Open elements beyond which such a start tag ends nothing.
FENCES = ("ul", "ol", "dl", "table", "select", "article", "div", "section")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[/a-zA-Z!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[/a-zA-Z!?][^>]*(?:>|\Z)", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME_PARTS = re.compile(r"[^\W\d_]+")


@lru_cache(4096)
def marks(value: str) -> bool:
    """Whether a class or id value has a token made of ``DROPPED_NAMES`` alone."""
    return any(parts and DROPPED_NAMES.issuperset(parts) for parts in map(_NAME_PARTS.findall, value.split()))


class Page:
    """Elements and texts of one page in document order.

    ``boiler`` (by tag or role, inherited), ``named`` (by class or id, its own), ``main``,
    ``own`` (its text's length) and ``digest`` hold one entry an element; a digest covers the
    element's name, class, and all that is below. ``runs`` alternates texts (element, string)
    and block breaks (None).
    """

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.boiler: list[bool] = [False]
        self.named: list[bool] = [False]
        self.own: list[int] = [0]
        self.main: list[bool] = [False]
        self.digest: list[int] = [0]
        self.runs: list[tuple[int, str] | None] = []
        self._parts: list[list[bytes]] = [[]]
        self._open = [0]
        self._depths: dict[str, list[int]] = {}  # where in the stack each tag stands
        self._blocks = [0]  # where in it elements stand that are not inline
        self._read(source)
        while self._open:
            self._close()

    def _close(self) -> None:
        node = self._open.pop()
        if node:
            self._depths[self.tag[node]].pop()
            if self.tag[node] not in INLINE:
                self._blocks.pop()
        digest = blake2b(b"\x1f".join(self._parts[node]), digest_size=8).digest()
        self.digest[node] = int.from_bytes(digest, "big", signed=True)
        self._parts[node] = []
        if self.parent[node] >= 0:
            self._parts[self.parent[node]].append(digest)

    def _last(self, tags) -> int:
        """Depth of the innermost open element named so, 0 if none."""
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=0)

    def _close_through(self, tags, fence: int = 0) -> None:
        """Close up to the innermost open element named so, unless it stands outside ``fence``."""
        depth = self._last(tags)
        if depth and depth >= fence:
            while len(self._open) > depth:
                self._close()

    def _start(self, tag: str, markup: str) -> None:
        if tag not in INLINE:
            self.runs.append(None)
            self._close_through(("p",), self._blocks[-1])
            if tag in CLOSES:
                self._close_through(CLOSES[tag], self._last(FENCES))
        elif tag == "br":
            self.runs.append((self._open[-1], " "))
        if tag in VOID:
            return
        up = self._open[-1]
        boiler, main, named, names = self.boiler[up] or tag in DROPPED_TAGS, self.main[up] or tag in MAIN, False, ""
        if "=" in markup:
            for key, a, b, c in _ATTRIBUTE.findall(markup):
                value = (a or b or c).lower()
                names += " " + value
                if key.lower() == "role":
                    boiler |= value in DROPPED_ROLES
                    main |= value == "main"
                elif tag not in ("body", "html"):
                    named |= marks(value)
        self._depths.setdefault(tag, []).append(len(self._open))
        if tag not in INLINE:
            self._blocks.append(len(self._open))
        self._open.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(up)
        self.boiler.append(boiler)
        self.named.append(named)
        self.own.append(0)
        self.main.append(main)
        self.digest.append(0)
        self._parts.append([(tag + names).encode("utf-8", "replace")])

    def _text(self, text: str) -> None:
        if text:
            node = self._open[-1]
            if "&" in text:
                text = html.unescape(text)
            self.runs.append((node, text))
            plain = " ".join(text.split())
            self.own[node] += len(plain)
            self._parts[node].append(plain.encode("utf-8", "replace"))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            found = _TAG.search(source, at)
            if not found:
                self._text(source[at:])
                return
            self._text(source[at : found.start()])
            at = found.end()
            markup = found.group()
            name = _NAME.match(markup)
            if not name:
                continue  # comment, doctype, processing instruction
            tag = name.group(1).lower()
            if markup[1] == "/":
                if tag not in INLINE:
                    self.runs.append(None)
                    self._close_through((tag,))
                else:
                    self._close_through((tag,), self._blocks[-1])
                continue
            self._start(tag, markup)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = end.start() if end else n
                if not end:
                    self._close()

    def _holds_main(self) -> list[bool]:
        out = [False] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            if self.tag[k] in MAIN or self.main[k] and not self.main[self.parent[k]] or out[k]:
                out[self.parent[k]] = True
        return out

    def _drop_named(self, gone: list[bool]) -> list[bool]:
        """``gone`` and what names mark, but no element by its name that holds an article, main or
        most of the text left, and none at all where names together would take most of it. Beside
        an article, less than ``SHORT`` counts as an advert or notice longer than the article."""
        holds_main = self._holds_main()
        held = [0 if g else n for g, n in zip(gone, self.own)]
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        marked = [n and not h for n, h in zip(self.named, holds_main)]
        under = marked[:]
        for k in range(1, len(under)):
            under[k] = under[k] or under[self.parent[k]]
        article = any(n and m and not g and not u for n, m, g, u in zip(self.own, self.main, gone, under))
        most = max(held[0] // 2, SHORT - 1 if article else 0)
        out, taken = gone[:], 0
        for k in range(1, len(out)):
            if not out[k]:
                up = out[self.parent[k]]
                out[k] = up or marked[k] and held[k] <= most
                taken += held[k] if out[k] and not up else 0
        return out if taken <= most else gone

    def _candidates(self) -> list[int]:
        """Elements that a template can consist of."""
        holds_main = self._holds_main()
        return [
            k
            for k in range(1, len(self.tag))
            if self.tag[k] not in INLINE
            and (self.tag[k] in CONTAINERS if self.main[k] else not holds_main[k] and self.tag[k] not in ("html", "body", "head"))
        ]

    def subtrees(self) -> dict[int, int]:
        """Digest of each such element, and where it stands: ``OUTSIDE`` articles, ``INSIDE`` one, or both."""
        out: dict[int, int] = {}
        for k in self._candidates():
            out[self.digest[k]] = out.get(self.digest[k], 0) | (INSIDE if self.main[k] else OUTSIDE)
        return out

    def text(self, outside: set[int], inside: set[int] = frozenset()) -> str:
        """Blocks outside dropped and template elements; only those inside articles, if these hold
        half or more of what is left."""
        gone = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            gone[k] = gone[self.parent[k]] or self.boiler[k] or self.digest[k] in (inside if self.main[k] else outside)
        if any(self.named):
            gone = self._drop_named(gone)
        left = [0 if g else n for g, n in zip(gone, self.own)]
        only_main = 2 * sum(n for n, m in zip(left, self.main) if m) >= sum(left)
        blocks: list[str] = []
        held: list[str] = []
        for run in [*self.runs, None]:
            if run is not None:
                node, text = run
                if not gone[node] and (self.main[node] or not only_main):
                    held.append(text)
            elif held:
                block = " ".join("".join(held).split())
                if block:
                    blocks.append(block)
                held = []
        return "\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:/?#]*:?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _emit(batches):
    for batch in batches:
        keys, hosts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = [
            (k, h, digest, place)
            for k, h, source in zip(keys, hosts, batch.column(2).to_pylist())
            for digest, place in Page(source or "").subtrees().items()
        ]
        k, h, d, p = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.int64()), pa.array(p, pa.int8())],
            names=["key", "host", "digest", "place"],
        )


def template_subtrees(
    subtrees: DataFrame, pages: DataFrame, min_pages: int, share: float, article_share: float, host_pages: int
) -> DataFrame:
    """``host, digest, places``: subtrees that recur on many pages of their host, and where they are template."""
    size = pages.groupBy("host").agg(F.least(F.count("*"), F.lit(host_pages)).alias("pages"))
    counted = subtrees.groupBy("host", "digest").agg(
        F.count("*").alias("n"), F.count_if(F.col("place") != INSIDE).alias("outside")
    )
    recurs = lambda n, least: (n >= min_pages) & (n >= F.col("pages") * F.lit(least))
    everywhere = recurs(F.col("n"), article_share)
    places = F.when(everywhere, OUTSIDE + INSIDE).when(recurs(F.col("outside"), share), OUTSIDE)
    return (
        counted.where(F.col("n") >= min_pages)
        .join(size, "host")
        .select("host", "digest", places.alias("places"))
        .where(F.col("places").isNotNull())
    )


def main_text(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 5,
    share: float = 0.1,
    article_share: float = 0.5,
    host_pages: int = 1000,
) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points.

    Every element subtree is hashed (name, class, id, role and all below) and counted once a
    page per host; subtrees that stand outside articles on at least ``min_pages`` pages and
    ``share`` of the host's pages are that site's template and are deleted there. Inside an
    article only subtrees on ``article_share`` of the host's pages, wherever they stand, are
    deleted, and text blocks (paragraphs, headings, ...) never, as copies and quotations recur
    there too. A host counts as ``host_pages`` pages at most, so that beyond these the numbers
    asked for (100 and 500 pages) grow no more.
    Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and comments that are marked as such are dropped also where the host has few pages;
    a class or id alone never drops an element that holds an article, main or most of the
    page's text (``SHORT`` characters at least, beside an article), and names together never
    drop most of it. If article and main elements hold
    half or more of the text that is then left, only text inside counts.

    White space inside a block becomes one space, blocks are joined by a line break, nothing
    else is dropped. Null and empty html give an empty text, a null url counts as host "",
    repeated rows are extracted each (and counted each), an empty table gives no rows. Columns
    named ``text`` or ``n_chars`` are replaced; names are matched as given.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    source = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.xxhash64(*[F.col(f"`{c}`") for c in keep if c != html_col], source).alias("key"),
        host(F.col(url_col)).alias("host"),
        source.alias("source"),
    )
    small = rows.select("key", "host", "source")
    subtrees = stage(small.mapInArrow(_emit, "key long, host string, digest long, place byte"), "subtrees")
    template = template_subtrees(subtrees, rows.select("host"), min_pages, share, article_share, host_pages)
    found = (
        subtrees.join(template, ["host", "digest"])
        .groupBy("key")
        .agg(
            F.collect_set("digest").alias("outside"),
            F.collect_set(F.when(F.col("places") > OUTSIDE, F.col("digest"))).alias("inside"),
        )
    )

    def extract(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (1, 2, 3)]
            texts = [Page(s).text(set(o or ()), set(i or ())) for s, o, i in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    # The html is taken from the row after the shuffle, so that it moves once.
    again = F.coalesce(F.col("row").getField(html_col), F.lit("")).alias("source") if html_col in keep else "source"
    joined = rows.join(found, "key", "left").select("row", again, "outside", "inside")
    out = joined.mapInArrow(extract, joined.select("row", F.lit("").alias("text")).schema)
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in keep], "text", F.length("text").cast("long").alias("n_chars")
    )
