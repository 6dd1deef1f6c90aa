"""Operator 10: main text of pages by equivalence-class template deduction over same-host pages."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscope.llm.common import staged, utf8

# Element names of HTML and words by which sites name parts that are not the article.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY_ITSELF = {"li": {"ul", "ol", "menu"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
NOT_ARTICLE = {"nav", "header", "footer", "aside", "head", "template", "button", "select", "option", "menu", "svg", "canvas", "audio", "video", "map", "applet", "datalist"} | RAW
#: names that are only evidence: see opened
MAYBE_ARTICLE = {"form", "dialog", "object", "fieldset"}
NOT_ARTICLE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "trending", "comment", "comments", "commentlist", "reply", "replies", "disqus", "respond", "discussion", "widget", "widgets", "toolbar", "pagination", "pager", "copyright", "skip", "search"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXT_TAGS = HEADINGS | {"p", "li", "pre", "blockquote", "dt", "dd", "figcaption", "caption", "address", "tr", "summary", "legend", "hr"}
NOT_ARTICLE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

#: parts of a class name that don't say what it is, and ones that say what stands beside it
LAYOUT_WORDS = {"left", "right", "top", "bottom", "inner", "outer", "wrap", "wrapper", "container", "box", "bar", "slot", "list", "area", "section", "block", "item", "items", "links", "unit", "form", "button", "count", "icon", "icons", "body"}
BESIDE_WORDS = {"with", "without", "no", "has", "non", "not"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|(?=[\"']))|([^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _not_article_name(name: str) -> bool:
    """Whether a whole class name says that the element is not the article: by its last word that is not about layout."""
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or words[0] in BESIDE_WORDS:
        return False
    while len(words) > 1 and (words[-1] in LAYOUT_WORDS or words[-1].isdigit()):
        words.pop()
    return words[-1] in NOT_ARTICLE_WORDS


@lru_cache(1 << 16)
def _describe(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """An element's name with its class and id (digits as #), whether it is outside the article, and whether its names are evidence of that."""
    if not attrs or attrs.isspace():
        return tag, tag in NOT_ARTICLE, tag in MAYBE_ARTICLE
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = f"{values.get('class', '')} {values.get('id', '')}".strip()
    out = tag in NOT_ARTICLE or "hidden" in values or values.get("aria-hidden") == "true" or bool(_HIDDEN.search(values.get("style", "")))
    maybe = tag in MAYBE_ARTICLE or values.get("role", "").lower() in NOT_ARTICLE_ROLES
    if names and tag not in ("html", "body", "article", "main"):
        maybe = maybe or any(map(_not_article_name, names.split()))
    return (f"{tag}.{re.sub(r'[0-9]+', '#', ' '.join(sorted(names.split())))}" if names else tag), out, maybe


class Page:
    """One pass over a page: its text blocks in order, its tag paths, and its spots: elements by path and place among like siblings."""

    def __init__(self, source: str):
        #: (path, text, characters inside links, outermost article or main element around it from 1 or 0, outside the article, innermost element around it whose names are evidence of that, spot)
        self.blocks: list[tuple[int, str, int, int, bool, int, int]] = []
        #: of each outermost article or main element, and of each h1, the innermost element around it whose names are evidence
        self.articles: list[int] = []
        self.heads: list[int] = []
        #: of each such element, the next one around it (0 is none), and whether it is a form. Elements around come first
        self.around = [0]
        self.forms = [False]
        #: of each spot its token, the spot around it and its tag; spot 0 is the page
        self.spots: list[tuple[int, int, str]] = [(0, -1, "")]
        self.children: list[dict[str, int] | None] = [None]
        #: a path is known by its token, which its last name and the path before it give; counts, and the path before
        self.paths: dict[int, int] = {}
        self.before: dict[int, int] = {0: 0}
        self.stack: list[tuple[str, int, bool, int, int, int]] = []  # (tag, path of its block, outside, in the article, evidence, spot)
        self.open: Counter[str] = Counter()  # elements on the stack by tag: an end tag without one need not look for it
        self.parts: list[str] = []
        self.linked = self.links = 0
        i, n = 0, len(source)
        while i < n:
            m = _TOKEN.match(source, i)
            if m is None:  # a tag with an open quote: text up to the next one
                j = source.find("<", i + 1)
                self._text(source[i : j if j > 0 else n])
                i = j if j > 0 else n
                continue
            i = m.end()
            if m[4] is not None:
                self._text(m[4])
            elif m[2] is None:
                continue
            elif m[1]:
                self._close(m[2].lower())
            else:
                tag = m[2].lower()
                self._open(tag, m[3] or "")
                if tag in RAW:
                    end = _RAW_END[tag].search(source, i)
                    i = end.start() if end else n
        self._flush()

    def _here(self) -> tuple[int, bool, int, int, int]:
        return self.stack[-1][1:] if self.stack else (0, False, 0, 0, 0)

    def _text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.links:
            self.linked += len(raw)

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            path, outside, inside, evidence, spot = self._here()
            self.blocks.append((path, text, self.linked, inside, outside, evidence, spot))
        self.parts, self.linked = [], 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br" or tag in VOID and tag in INLINE:
            self.parts.append(" ")
            return
        name, out, maybe = _describe(tag, attrs)
        path, outside, inside, evidence, spot = self._here()
        if tag in INLINE and not out and not maybe:
            self.stack.append((tag, path, outside, inside, evidence, spot))
            self.open[tag] += 1
            self.links += tag == "a"
            return
        self._flush()
        if tag not in VOID:
            if tag in CLOSED_BY_ITSELF:
                self._close(tag, CLOSED_BY_ITSELF[tag])
            elif tag not in INLINE:
                self._close("p", set())
            path, outside, inside, evidence, spot = self._here()
            path, before = _step(path, name), path
            self.before[path] = before
            like = self.children[spot] or {}
            self.children[spot] = like
            like[name] = like.get(name, 0) + 1
            self.spots.append((_step(self.spots[spot][0], f"{name}[{like[name]}]"), spot, tag))
            self.children.append(None)
            spot = len(self.spots) - 1
            if maybe:
                self.around.append(evidence)
                self.forms.append(tag == "form")
                evidence = len(self.around) - 1
            if tag == "header" and inside:  # the heading of the article itself
                out = outside
            if tag in ("article", "main") and not inside and not outside:
                self.articles.append(evidence)
                inside = len(self.articles)
            if tag == "h1" and not outside:
                self.heads.append(evidence)
            self.stack.append((tag, path, outside or out, inside, evidence, spot))
            self.open[tag] += 1
            self.links += tag == "a"
            self.paths[path] = self.paths.get(path, 0) + 1

    def _close(self, tag: str, within: set[str] | None = None) -> None:
        """Close the nearest such element; not past one of `within`, nor, for an implied end, past another block."""
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            t = self.stack[k][0]
            if t == tag:
                if tag not in INLINE or self.stack[k][1] != (self.stack[k - 1][1] if k else ""):
                    self._flush()
                self.links -= sum(s[0] == "a" for s in self.stack[k:]) if self.links else 0
                self.open.subtract(s[0] for s in self.stack[k:])
                del self.stack[k:]
                return
            if within is not None and (t in within or not within and t not in INLINE):
                return


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _token(kind: str, *parts: str) -> int:
    t = xxhash.xxh3_64_intdigest("\x00".join((kind, *parts)).encode("utf-8", "surrogatepass"))
    return t - (1 << 64) if t >> 63 else t


@lru_cache(1 << 16)
def _step(path: int, name: str) -> int:
    """The token of a path that goes on by one element."""
    return _token("path", str(path), name)


def amounts(page: Page) -> Iterator[tuple[int, int, int, int]]:
    """Of each element that can be a slot: token, token of the element around it, and thousandths of the page's article text in it outside links, print of that text."""
    n = len(page.spots)
    chars, prints = [0] * n, [0] * n
    for b in named_blocks(page):
        chars[b[6]] += max(len(b[1]) - b[2], 0)
        prints[b[6]] ^= _token("block", b[1])
    for k in range(n - 1, 0, -1):
        up = page.spots[k][1]
        chars[up] += chars[k]
        prints[up] ^= prints[k]
    return ((t, page.spots[up][0], chars[k] * 1000 // chars[0], prints[k]) for k, (t, up, tag) in enumerate(page.spots) if k and chars[k] and tag not in TEXT_TAGS)


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, kind, page, n, chars, linked, up, print): tag paths, text blocks and spots of each page, and one row per page.

    A page is what its article can be: rows of a host with the same such texts (copies under several URLs, or with other menus or
    advertisements around them) are one page, so a template is what stands beside differing contents.
    """
    kinds = {"host": pa.string(), "token": pa.int64(), "kind": pa.string()} | dict.fromkeys(("page", "n", "chars", "linked", "up", "print"), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for h, raw in zip(b.column(0), b.column(1), strict=True):
                h, p = h.as_py(), Page(raw.as_py().decode("utf-8", "replace"))
                page = _token("page", *main_blocks(p, frozenset()))
                chars: dict[int, list[int]] = {}
                texts: dict[int, int] = {}
                for path, text, linked, *_ in p.blocks:
                    c = chars.setdefault(path, [0, 0])
                    c[0] += len(text)
                    c[1] += min(linked, len(text))
                    t = _token("text", str(path), text)
                    texts[t] = texts.get(t, 0) + 1
                out.append((h, 0, "page", page, 1, 0, 0, 0, 0))
                out += ((h, x, "path", page, n, *chars.get(x, (0, 0)), 0, 0) for x, n in p.paths.items())
                out += ((h, t, "text", page, n, 0, 0, 0, 0) for t, n in texts.items())
                out += ((h, t, "spot", page, 1, share, 0, up, prints) for t, up, share, prints in amounts(p))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))

    schema = "host string, token long, kind string, page long, n long, chars long, linked long, up long, print long"
    return pages.select("host", utf8("html").alias("raw")).mapInArrow(run, schema)


def main_slot(spots: list[tuple[int, int, int]], main: float) -> int | None:
    """The innermost spot that is reached from the page by steps into spots that hold at least `main` of the text of the spot before.

    `spots` are (token, token around it, text over all pages): nested classes of a template. None if the first step is not held by one.
    """
    inside: dict[int, list[tuple[int, int]]] = {}
    for token, up, share in spots:
        inside.setdefault(up, []).append((share, token))
    here, held, slot = 0, sum(c for c, _ in inside.get(0, ())), None
    while here in inside:
        share, token = max(inside[here])
        if share < main * held:
            break
        here, held, slot = token, share, token
    return slot


def templates(pages: DataFrame, support: float, least_pages: int, menu: float, main: float) -> DataFrame:
    """(host, drop, slot): per host the tokens of its template that are not slots for the article, and the main slot if classes tell it.

    The occurrence vector of a token (its count on every page of the host) is kept as a combined print, bit_xor over pages of
    hash(page, count), so it is summed before the shuffle and a hot host costs a task no more than its template. Tokens with one
    vector form a class. A class is valid when it stands on at least `least_pages` pages (spots: 2) and `support` of the host's. Text of a
    valid class is template. Tag paths of a valid class whose text is mostly links over all pages are menus; what is inside
    them is nested in them. Spots of valid classes nest into a tree; its main slot is where the text gathers that differs
    between pages and is outside links, each page counted alike.
    """
    keys = ("host", "token", "kind")
    once = occurrences(pages).groupBy(*keys, "page").agg(*(F.max(c).alias(c) for c in ("n", "chars", "linked", "up", "print")))
    tokens = once.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.expr("bit_xor(xxhash64(page, n))").alias("vector"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.max("up").alias("up"), (F.min("print") != F.max("print")).alias("differs")
    )
    tokens = staged(tokens.filter(F.col("pages") >= F.when(F.col("kind").isin("spot", "page"), 2).otherwise(least_pages)), "tokens")
    hosts = tokens.filter("kind = 'page'").select("host", F.col("pages").alias("all_pages"))
    classes = tokens.groupBy("host", "vector").agg(F.max("pages").alias("class_pages"), F.count(F.lit(1)).alias("class_size"))
    valid = classes.join(hosts, "host").filter(F.col("class_pages") >= F.col("all_pages") * support).select("host", "vector")
    known = tokens.join(valid, ["host", "vector"])
    drop = (F.col("kind") == "text") | ((F.col("kind") == "path") & (F.col("linked") > F.col("chars") * menu))
    spot = (F.col("kind") == "spot") & F.col("differs")
    made = known.filter(drop | spot).groupBy("host").agg(
        F.collect_list(F.when(drop, F.col("token"))).alias("drop"), F.collect_list(F.when(spot, F.struct("token", "up", "chars"))).alias("spots")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [main_slot([tuple(x.values()) for x in row], main) for row in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(slots, pa.int64())], ["host", "drop", "slot"])

    return made.mapInArrow(run, "host string, drop array<long>, slot long")


def opened(page: Page) -> list[bool]:
    """Of each element whose names are evidence against it, whether it counts all the same.

    It does if it holds all article and main elements of the page, or is a form around all its h1. If without the others no text
    is left, those around an h1 count, or, if there is none, those that are no forms; inside them this is done again.
    """
    n = len(page.around)
    own, held, articles, heads = [0] * n, [0] * n, [0] * n, [0] * n
    for b in page.blocks:
        own[b[5]] += not b[4]
    for k in page.articles:
        articles[k] += 1
    for k in page.heads:
        heads[k] += 1
    held = own[:]
    inside: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        up = page.around[k]
        held[up] += held[k]
        articles[up] += articles[k]
        heads[up] += heads[k]
        inside[up].append(k)
    counts = [True] + [False] * (n - 1)

    def enter(frontier: list[int]) -> list[int]:
        """All of `frontier` and the wrappers right inside them count."""
        new = []
        while frontier:
            k = frontier.pop()
            counts[k] = True
            new.append(k)
            frontier += (c for c in inside[k] if articles[c] and articles[c] == articles[0] or page.forms[c] and heads[c] and heads[c] == heads[0])
        return new

    new = enter([0])
    while not any(own[k] for k in new):
        rest = [c for k in new for c in inside[k] if held[c] and not counts[c]]
        new = enter([c for c in rest if heads[c]] or [c for c in rest if not page.forms[c]])
        if not new:
            break
    return counts


def named_blocks(page: Page) -> list[tuple[int, str, int, int, bool, int, int]]:
    """The blocks that names of elements leave: none that are outside, none in elements whose names are evidence and that don't count."""
    counts = opened(page)
    return [b for b in page.blocks if not b[4] and counts[b[5]]]


def main_blocks(page: Page, drop: frozenset[int] | set[int], slot: int | None = None) -> list[str]:
    """The texts of the slots that belong to the article, in page order.

    Names go first (see named_blocks). If one article or main element is left, only what is inside it counts; several are no
    sign of one article. Otherwise the host's main slot counts, and headings in the elements around it (h1 on the whole page). Template goes last.
    """
    blocks = named_blocks(page)
    marked = {b[3] for b in blocks if b[3]}
    if len(marked) == 1:
        blocks = [b for b in blocks if b[3]]
    elif slot is not None:
        spot = next((k for k, s in enumerate(page.spots) if s[0] == slot), None)
        if spot is not None:
            around, up = set(), page.spots[spot][1]
            while up > 0:
                if page.spots[up][2] not in ("html", "body"):
                    around.add(up)
                up = page.spots[up][1]
            within = [False] * len(page.spots)
            for k, (_, up, tag) in enumerate(page.spots):
                within[k] = k == spot or up >= 0 and within[up] or tag == "h1" or tag in HEADINGS and up in around
            blocks = [b for b in blocks if within[b[6]]]

    if drop:
        menus = {0: False}  # whether a path lies in a menu; the path before always came first
        for path, before in page.before.items():
            menus[path] = path in drop or menus[before]
        blocks = [b for b in blocks if not menus[b[0]] and _token("text", str(b[0]), b[1]) not in drop]
    return [b[1] for b in blocks]


def article(source: str, drop: frozenset[int] | set[int], slot: int | None = None) -> str:
    return " ".join(main_blocks(Page(source), drop, slot))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, support: float = 0.5, least_pages: int = 4, menu: float = 0.6, main: float = 0.8, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Per row: id, url, text (the article; empty if none), n_chars.

    Character references are decoded, blanks inside a block become one space, and blocks are joined in page order by one space.
    Hosts with fewer than `least_pages` pages have no template text, and with one page no slots; there, names of elements alone decide
    (class names are only evidence, see opened). `main` is the share of an element's text that leads into one inside it. Rows
    of a host whose article can be the same text count as one page of a template, and each gives its text.
    A null or empty html gives an empty text; a null or odd url is host ''; an empty table gives no rows; other columns are not
    read. Templates go by broadcast while their measured size is below broadcast_bytes, else by a join on the host.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
    made = staged(templates(rows, support, least_pages, menu, main), "templates")
    size = made.agg(F.sum(F.size("drop") * 8 + F.length("host") + 40).alias("n")).first()["n"] or 0
    kind = pages.schema[id_col].dataType.simpleString()

    def emit(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    small = size <= broadcast_bytes
    shared = pages.sparkSession.sparkContext.broadcast({r["host"]: (frozenset(r["drop"]), r["slot"]) for r in made.toLocalIterator()}) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: tuple[frozenset[int], int | None] = frozenset(), None
        for b in batches:
            if small:
                made_for = [shared.value.get(h, none) for h in b.column(3).to_pylist()]
            else:
                made_for = [(frozenset(d or ()), s) for d, s in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield emit(b, [article(v.as_py().decode("utf-8", "replace"), *t) for v, t in zip(b.column(2), made_for, strict=True)])

    source = rows.select("_id", "url", utf8("html").alias("raw"), "host")
    source = source if small else source.join(made, "host", "left").select("_id", "url", "raw", "host", "drop", "slot")
    return source.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
