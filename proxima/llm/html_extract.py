"""Main text of web pages by site template removal.

Every element subtree is hashed (tag, text and children, no attributes).  Spark counts on
how many different pages of a host each subtree stands; subtrees that recur across many of
them are the site's template and are deleted, but for the exemption below.  Elements that are
boilerplate by their tag, role, class or id (menus, page headers and footers, sidebars,
notices, adverts, forms, reader comments) go as well, and where a page marks its article or
main part, only that is read.

A name that counts by its last part only (post-header, left-sidebar) is weak: it deletes nothing
by itself, but inside an article what bears it goes if the element or its name recurs on the
host.  No name deletes the element that holds the page's article or the article's headline.

Plain prose inside a marked article (paragraphs, headings, quotes, list items, table cells)
is never taken for template: articles of one host may well quote the same passage.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import arrow_column, write_table

MIN_PAGES = 5  # different pages of a host that a template stands on, at least
MIN_SHARE = 0.05  # and this share of them on a host of SHARE_PAGES, falling with the root of the pages of larger ones
SHARE_PAGES = 100

_START = re.compile(r"<!--|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
_ASIDE = re.compile(r"<!--|<!\[CDATA\[")
_MARK = re.compile(r"""[>"']""")
_NAMED = re.compile(r"""(?:\s|^)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
PROSE = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption hr br header hgroup".split())
DROPPED = frozenset("head script style noscript template iframe object embed nav footer aside form button select option input textarea menu dialog svg "
                    "canvas map audio video datalist xmp noembed noframes title".split())
ROOTS = frozenset(("article", "main"))
KEPT_NAMES = frozenset(("html", "body", "article", "main"))
#: an open element that a new one of these tags ends
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
                   "ol p pre section table ul".split())

_WORDS = ("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
          "header masthead footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
          "subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond search toolbar "
          "widget pagination pager copyright disclaimer complementary contentinfo search")
BOILERPLATE = frozenset(_WORDS.split())
NOT_NAMES = frozenset("has no with without not js is".split())


STRONG, WEAK = 2, 1
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def boilerplate(attributes: str) -> tuple[int, str]:
    """How a class, id or role names the element as boilerplate (STRONG, WEAK or 0), and the
    name.  A hyphenated name counts by its first part (cookie-bar), or weakly by its last
    (site-header), unless it starts like has-sidebar."""
    weak = ""
    for m in _NAMED.finditer(attributes):
        kind = m[1].lower()
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if kind == "role" and name == "banner" or name in BOILERPLATE:
                return STRONG, name
            parts = re.split(r"[-_]+", name)
            if len(parts) > 1 and parts[0] not in NOT_NAMES:
                if parts[0] in BOILERPLATE:
                    return STRONG, name
                if parts[-1] in BOILERPLATE:
                    weak = weak or name
    return (WEAK, weak) if weak else (0, "")


class Ends:
    """Where the markup of one page ends, in time linear in the page however it is built: what a
    search ran over to no avail is remembered, so that no later one runs over it again."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self._mark = (0, -1)  # the first mark at or after [0] stands at [1]
        self._without = {}    # character -> place from which there is none
        self._open: set[int] = set()  # marks outside quotes from which no tag ends

    def find(self, what: str, at: int) -> int:
        if at >= self._without.get(what, len(self.html) + 1):
            return -1
        i = self.html.find(what, at)
        if i < 0:
            self._without[what] = at
        return i

    def _next_mark(self, at: int) -> int:
        start, found = self._mark
        if not start <= at <= found:
            m = _MARK.search(self.html, at)
            found = m.start() if m else len(self.html)
            self._mark = (at, found)
        return found

    def tag(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at ``at``: the first one outside
        quotes, or the first one at all if a quote stays open; -1 if there is none."""
        first = self.html.find(">", at) if at <= self.last else -1  # what is run over is used up by the tag
        if first < 0:
            return -1
        inside = self.html[at:first]
        if '"' not in inside and "'" not in inside:
            return first
        met, i = [], self._next_mark(at)
        while i < len(self.html) and i not in self._open:
            met.append(i)
            if self.html[i] == ">":
                return i
            close = self.find(self.html[i], i + 1)
            if close < 0:
                break
            i = self._next_mark(close + 1)
        self._open.update(met)
        return first

    def raw(self, tag: str, at: int) -> tuple[int, int]:
        """Where the text of a raw element ends and where what follows starts."""
        m = RAW[tag].search(self.html, at)
        end = self.find(">", m.end()) if m else -1
        return (m.start(), end + 1) if end >= 0 else (len(self.html), len(self.html))


class Page:
    """The elements of a page in opening order, with text pieces and subtree hashes."""

    def __init__(self, html: str):
        self.tag, self.parent, self.own_drop, self.hash = ["#page"], [-1], [False], [0]
        self.named: dict[int, tuple[int, str]] = {}  # elements that only their name makes boilerplate
        self.pieces: list[tuple[str, int]] = []  # text and the element it stands in
        self._content: list[list[str]] = [[]]
        self._stack = [0]
        self._depths: dict[str, list[int]] = {}  # of the open elements of each tag
        self._read(html)
        while self._stack:
            self._close()

    def _open(self, tag: str, attributes: str) -> None:
        up = self._stack[-1]
        in_article = any(self._depths.get(t) for t in ROOTS)
        drop = tag in DROPPED or (tag == "header" and not in_article)
        if not drop and attributes and tag not in KEPT_NAMES - {"article"}:
            how = boilerplate(attributes)
            if how[0] and not (tag == "header" and in_article):
                self.named[len(self.tag)] = how
        self.tag.append(tag)
        self.parent.append(up)
        self.own_drop.append(drop)
        self.hash.append(0)
        self._content.append([])
        self._depths.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        if tag not in INLINE:
            self.pieces.append((" ", up))

    def _close(self) -> None:
        i = self._stack.pop()
        body = "\0".join([self.tag[i], *self._content[i]])
        self.hash[i] = h = xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass"))
        self._content[i] = []
        if self._stack:
            self._depths[self.tag[i]].pop()
            up = self._stack[-1]
            self._content[up].append(f"{h:x}")
            if self.tag[i] not in INLINE:
                self.pieces.append((" ", up))

    def _close_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._close()

    def _end(self, tags, stops) -> None:
        """Close the nearest open element of ``tags`` unless one of ``stops`` stands between."""
        d = self._deepest(tags)
        if d and d > self._deepest(stops):
            self._close_to(d)

    def _deepest(self, tags) -> int:
        get, d = self._depths.get, 0
        for t in tags:
            at = get(t)
            if at and at[-1] > d:
                d = at[-1]
        return d

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        plain = " ".join(text.split())
        if plain:
            self._content[self._stack[-1]].append(plain)
        self.pieces.append((text, self._stack[-1]))

    def _read(self, html: str) -> None:
        at, n, ends = 0, len(html), Ends(html)
        while at < n:
            m = _START.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            start, name = m.start(), m[2]
            if m[0] in ("<!--", "<![CDATA["):
                close = "-->" if m[0] == "<!--" else "]]>"
                end = ends.find(close, m.end())
                stop, after = (end, end + 3) if end >= 0 else (n, n)
            else:
                end = ends.tag(m.end()) if name else ends.find(">", m.end())
                stop, after = end, end + 1
            if end < 0 and stop < 0:  # no tag ends any more: text up to the next comment
                m = _ASIDE.search(html, start)
                self._text(html[at:m.start() if m else n])
                at = m.start() if m else n
                continue
            if start > at:
                self._text(html[at:start])
            at = after
            if not name:
                if m[0] == "<![CDATA[":
                    self._text(html[m.end():stop].replace("&", "&amp;"))
                continue
            tag, attributes = name.lower(), html[m.end():stop]
            if m[1]:
                if tag in VOID:
                    if tag == "br":
                        self.pieces.append((" ", self._stack[-1]))
                    continue
                stops = () if tag not in INLINE else {"td", "th", "article", "main", "body"}
                self._end({tag}, stops)
                continue
            if tag in ENDS_P:
                self._end({"p"}, {"td", "th", "li", "button", "table", "article", "main", "section", "div", "blockquote", "aside", "form"})
            if tag in ENDS:
                self._end(ENDS[tag], STOPS[tag])
            if tag in VOID:
                if tag not in INLINE:
                    self.pieces.append((" ", self._stack[-1]))
                continue
            self._open(tag, attributes)
            if attributes.endswith("/") and tag in ("svg", "path", "rect", "circle", "use"):
                self._close()
            elif tag in RAW:
                stop, after = ends.raw(tag, at)
                raw = html[at:stop]
                if tag in ("title", "textarea"):
                    self._text(raw)
                else:
                    self._content[self._stack[-1]].append(raw)
                at = after
                self._close()

    def _below(self, mark) -> list[bool]:
        """For each element whether ``mark`` holds for one above it."""
        out = [False] * len(self.tag)
        for i in range(1, len(out)):
            up = self.parent[i]
            out[i] = out[up] or (up > 0 and mark(up))
        return out

    def _holding(self, marked) -> set[int]:
        """The elements above a marked one."""
        out: set[int] = set()
        marked = set(marked)
        for i in range(len(self.tag) - 1, 0, -1):  # children stand after their parents
            if (i in marked or i in out) and self.parent[i] > 0:
                out.add(self.parent[i])
        return out

    def _headlines(self) -> set[int]:
        """Of each outermost article or main: its first heading of the highest level."""
        best: dict[int, int] = {}
        dropped = self._below(self.own_drop.__getitem__)
        outer = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            outer[i] = outer[up] or (up if self.tag[up] in ROOTS else 0)
            if self.tag[i] in HEADINGS and not dropped[i] and outer[i] and (outer[i] not in best or self.tag[i] < self.tag[best[outer[i]]]):
                best[outer[i]] = i
        return set(best.values())

    def _holders(self) -> tuple[set[int], set[int], set[int]]:
        """Elements that hold an article or main; that hold the headline of one; of the latter
        those that hold an h1."""
        heads = self._headlines()
        return (self._holding(i for i, t in enumerate(self.tag) if t in ROOTS), self._holding(heads),
                self._holding(i for i in heads if self.tag[i] == "h1"))

    def _named_drops(self) -> set[int]:
        """Elements that a strong name deletes: not one that holds an article's h1 or a main,
        nor one that holds an article while no article would be left outside such elements."""
        strong = {i for i, (how, _) in self.named.items() if how == STRONG}
        if not strong:
            return strong
        _, _, first = self._holders()
        mains = self._holding(i for i, t in enumerate(self.tag) if t == "main")
        in_root = self._below(lambda a: self.tag[a] in ROOTS)
        # reader comments and teasers are often articles too, so only the article itself counts
        strong = {i for i in strong if i not in mains and not (i in first and (in_root[i] or self.tag[i] in ROOTS))}
        roots = [i for i, t in enumerate(self.tag) if t in ROOTS]
        drops = lambda a: a in strong or self.own_drop[a]
        below = self._below(drops)
        if roots and all(below[i] or drops(i) for i in roots):
            strong -= self._holding(i for i in roots if i not in strong)
        return strong

    def _weak(self, gone, inside) -> dict[int, int]:
        """Elements inside an article with a weak name, and the hash of that name; not those
        that hold an article, a main or a headline."""
        weak = {i: name for i, (how, name) in self.named.items() if how == WEAK and inside[i] and not gone[i]}
        if not weak:
            return {}
        roots, heads, _ = self._holders()
        return {i: xxhash.xxh64_intdigest(f"\0name\0{self.tag[i]}\0{name}".encode("utf-8", "surrogatepass"))
                for i, name in weak.items() if i not in roots and i not in heads and self.tag[i] != "main"}

    def _marks(self):
        """(removed by name, inside a marked article, whether the page marks one)."""
        n = len(self.tag)
        gone, inside = [False] * n, [False] * n
        dropped = self._named_drops() if self.named else ()
        for i in range(1, n):
            up = self.parent[i]
            gone[i] = gone[up] or self.own_drop[i] or i in dropped
            inside[i] = inside[up] or (self.tag[i] in ROOTS and not gone[i])
        has_text = any(inside[i] and not gone[i] and t.strip() for t, i in self.pieces)
        return gone, inside, has_text

    def subtrees(self) -> list[tuple[int, bool]]:
        """Hash of each element subtree that could be template, and whether the text would
        otherwise be kept."""
        gone, inside, marked = self._marks()
        out: dict[int, bool] = {}
        for i in range(1, len(self.tag)):
            if self.tag[i] in ("html", "body") or self.tag[i] in ROOTS or (inside[i] and self.tag[i] in PROSE):
                continue
            matters = not gone[i] and (inside[i] or not marked)
            out[self.hash[i]] = out.get(self.hash[i], False) or matters
        for i, name in self._weak(gone, inside).items():
            out[self.hash[i]] = out[name] = True
        return list(out.items())

    def text(self, templates=frozenset()) -> str:
        gone, inside, marked = self._marks()
        if templates:
            weak = self._weak(gone, inside)
            for i in range(1, len(self.tag)):
                gone[i] = gone[i] or gone[self.parent[i]] or (
                    self.hash[i] in templates and self.tag[i] not in ("html", "body") and self.tag[i] not in ROOTS
                    and not (inside[i] and self.tag[i] in PROSE)) or (i in weak and (weak[i] in templates or self.hash[i] in templates))
        return " ".join("".join(t for t, i in self.pieces if not gone[i] and (inside[i] or not marked)).split())


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _subtree_column(spark):
    kind = pa.list_(pa.struct([("h", pa.int64()), ("matters", pa.bool_())]))

    def batches(it):
        for pages in it:
            yield pa.array([[{"h": _signed(h), "matters": m} for h, m in Page(p.as_py() or "").subtrees()] for p in pages], kind)

    return arrow_column(spark, batches, "array<struct<h: bigint, matters: boolean>>")


def _text_column(spark):
    def batches(it):
        for rows in it:
            html, known = rows.field(0), rows.field(1)
            yield pa.array([Page(h.as_py() or "").text(frozenset(x % (1 << 64) for x in (k.as_py() or ()))) for h, k in zip(html, known)], pa.string())

    return arrow_column(spark, batches, "string")


def page_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, digest, templates) for the distinct pages (host, html) that hold template
    subtrees in what would otherwise be kept.  ``pages`` has host, digest, html.

    A template stands on ``min_pages`` pages at least and on ``min_share`` of them; on a host of
    more than ``SHARE_PAGES`` pages the share falls with the root of their number (5 of 100
    pages, 50 of 10,000, 500 of 1,000,000), as a section's template is on few of many pages."""
    marks = pages.select("host", "digest", F.explode_outer(_subtree_column(pages.sparkSession)(F.col("html"))).alias("s"))
    marks = write_table(marks.groupBy("host", "digest", F.col("s.h").alias("h")).agg(F.max("s.matters").alias("matters")), "subtrees")
    sizes = marks.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = marks.where("h is not null").groupBy("host", "h").agg(F.count("*").alias("n"), F.max("matters").alias("any"))
    seen = seen.where((F.col("n") >= min_pages) & F.col("any"))
    counted = F.least(F.col("pages").cast("double"), F.sqrt(F.lit(float(SHARE_PAGES)) * F.col("pages")))
    found = seen.join(sizes, "host").where(F.col("n") >= min_share * counted).select("host", "h")
    return marks.where("matters").join(found, ["host", "h"]).groupBy("host", "digest").agg(F.collect_list("h").alias("templates"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES,
            min_share: float = MIN_SHARE) -> DataFrame:
    """Per page: ``id_col``, ``url_col``, text (empty if none), n_chars (its code points).

    Null html counts as empty; a null url or one without :// belongs to the empty host.
    Copies of a page (same host, same html) count as one page, so they make no template.
    Repeated rows and null ids stay; other columns are ignored; an empty table gives none."""
    spark = pages.sparkSession
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                       F.xxhash64(F.coalesce(F.col(html_col), F.lit(""))).alias("digest"), F.col(html_col).cast("string").alias("html"))
    templates = write_table(page_templates(src.select("host", "digest", "html"), min_pages, min_share), "page-templates")
    met = src.join(templates.select(F.col("host").alias("_h"), F.col("digest").alias("_d"), "templates"),
                   (F.col("host") == F.col("_h")) & (F.col("digest") == F.col("_d")), "left")
    out = met.select("id", "url", _text_column(spark)(F.struct("html", "templates")).alias("text"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
