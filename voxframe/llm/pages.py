"""Main text of web pages by equivalence-class template deduction (Arasu and Garcia-Molina, 2003).

Tokens are the opening tags of a page with their path (names, classes and ids from the root, numbers apart), and texts
under a path. The occurrence vector of a token over the pages of a host is kept as a linear sketch: the number of
pages, the occurrences, and the sum of occurrences times a hash of the page. Sketches add up, so they are merged from
any split of the pages; equal sketches mean equal vectors. Tokens of equal vectors form an equivalence class; a class
is valid if its tokens nest in one other class, and valid classes nest into the host's template. What lies between
template tokens is a slot.

A slot's worth is the text in it that is neither template nor link. From the template's root, the descent goes to the
class token that holds most of its parent's worth, as long as one does; where it ends, the slots below are the
page's main text. Tag names and class words only break ties: they keep the descent out of what says itself to be
chrome, end it at an article, and decide alone where a host has no such template.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, in_batches, staged

# Elements by what they do to text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CHROME = {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "svg", "canvas", "audio", "video", "object", "math"} | RAW
#: Words of classes and ids, and ARIA roles, of what isn't the article.
CHROME_WORDS = {
    "ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup",
    "promo", "promoted", "related", "recommended", "reply", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget", "complementary", "contentinfo", "search", "alert",
}
#: Closed by the opening of the key: a paragraph ends where a block begins, items end where their like begin.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A slot's text is boilerplate if it fills this share of the host's pages and at least so many of them.
REPEAT_SHARE, REPEAT_PAGES = 0.5, 5
#: Where such texts are more than this share of a host's text, its pages are near copies, and nothing is boilerplate.
REPEAT_MOST = 0.8
#: Blocks of text, which are never slots' containers.
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "ul", "ol", "dl", "br", "hr", "blockquote", "address", "figcaption", "caption", "legend", "summary", "th", "tr"}
#: The descent goes on to a token that holds this share of its parent's worth and stands once on this share of the pages.
MAIN_SHARE, PAGE_SHARE = 0.6, 0.5
#: Tokens on fewer than this share of a host's pages aren't gathered: they can't be on PAGE_SHARE of them.
LEAST_SHARE = 0.02
#: Paths that a task remembers.
PATHS = 50_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_MARKED = re.compile(r"class|id|role|hidden|style", re.I)
_DIGITS = re.compile(r"[0-9]{2,}")
_SECTIONS = {"div", "article", "section", "body", "table", "ul", "ol", "blockquote", "main", "td", "aside", "nav", "footer"}
_BLANK = re.compile(r"\s+")
_HOST = re.compile(r"^[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", re.I)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Path:
    """A place in the tree of tags; equal tags with equal marks under one place are one path."""

    __slots__ = ("name", "up", "key", "chrome", "article", "main", "link", "kids")

    def __init__(self, name: str, marks: tuple[str, ...], hidden: bool, up: Path | None) -> None:
        self.name, self.up = name, up
        own = f"{up.key if up else 0}>{name}." + ".".join(sorted(marks))
        self.key = int.from_bytes(hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        self.chrome = hidden or bool(up and up.chrome) or is_chrome(name, marks, up)
        self.article = name == "article" or bool(up and up.article)
        self.main = name == "main" or bool(up and up.main)
        self.link = name == "a" or bool(up and up.link)
        self.kids: dict[tuple, Path] = {}


def is_chrome(name: str, marks: tuple[str, ...], up: Path | None) -> bool:
    if name in CHROME:
        return True
    if name == "header":
        return not (up and up.article)
    words = {w for m in marks for w in _SPLIT.split(m) if w}
    return bool(words & CHROME_WORDS) and name not in ("article", "main", "body", "html")


class Paths:
    """The paths met so far, under one root; forgotten when they get too many, as pages can have any number."""

    def __init__(self) -> None:
        self.root = Path("", (), False, None)
        self.count = 0

    def fresh(self) -> None:
        if self.count > PATHS:
            self.__init__()

    def below(self, up: Path, name: str, attributes: str) -> Path:
        marks: tuple[str, ...] = ()
        hidden = False
        if attributes and _MARKED.search(attributes):
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(" " + attributes)}
            marks = tuple(dict.fromkeys(_DIGITS.sub("#", x) for k in ("class", "id", "role") for x in attrs.get(k, "").lower().split()))
            hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        key = (name, marks, hidden)
        path = up.kids.get(key)
        if path is None:
            path = up.kids[key] = Path(name, marks, hidden, up)
            self.count += 1
        return path


class Page:
    """A page in one pass: blocks (path, text), opened paths with their number, and worth of each path's own text."""

    def __init__(self, page: str, paths: Paths) -> None:
        paths.fresh()
        self.blocks: list[tuple[Path, str]] = []
        self.opened: dict[Path, int] = {}
        self.worth: dict[Path, int] = {}
        self._parts: list[str] = []
        self._where: Path = paths.root
        self._blank = True
        self._root = paths.root
        self._read(page, paths)
        self._flush()

    def _flush(self) -> None:
        if self._parts:
            if not self._blank and (text := clean("".join(self._parts))):
                self.blocks.append((self._where, text))
            self._parts, self._blank = [], True

    def _text(self, value: str, at: Path) -> None:
        if self._parts and at.chrome != self._where.chrome:
            self._flush()
        if self._blank:
            self._where = at
        self._parts.append(value)
        n = len(value.strip())
        if n:
            self._blank = False
            if not at.link:
                self.worth[at] = self.worth.get(at, 0) + n

    def _read(self, page: str, paths: Paths) -> None:
        """Malformed nesting is mended. How often a name is open is counted, so that no search runs in vain."""
        stack: list[Path] = [paths.root]
        is_open: Counter = Counter()
        at, end = 0, len(page)

        def pop(to: int) -> None:
            while len(stack) > to:
                path = stack.pop()
                is_open[path.name] -= 1
                if path.name in BLOCKS:
                    self._flush()

        while at < end:
            lt = page.find("<", at)
            m = _TOKEN.match(page, lt) if lt >= 0 else None
            if lt < 0 or (m is None and lt + 1 >= end):
                self._text(page[at:], stack[-1])
                return
            if m is None:  # a bare < is text
                nxt = page.find("<", lt + 1)
                nxt = end if nxt < 0 else nxt
                self._text(page[at:nxt], stack[-1])
                at = nxt
                continue
            if lt > at:
                self._text(page[at:lt], stack[-1])
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"), stack[-1])
                continue
            name = m[2].lower()
            if m[1]:
                if not is_open[name]:
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        pop(i)
                        break
                    if name not in BLOCKS and stack[i].name in ("td", "th", "article", "div", "body"):
                        break
                continue
            if name in BLOCKS:
                if name != "br":
                    closes = CLOSES.get(name, ())
                    if is_open["p"] or any(is_open[x] for x in closes):
                        for i in range(len(stack) - 1, 0, -1):
                            if stack[i].name == "p" or stack[i].name in closes:
                                pop(i)
                                break
                            if stack[i].name in _SECTIONS:
                                break
                self._flush()
            path = paths.below(stack[-1], name, m[3])
            self.opened[path] = self.opened.get(path, 0) + 1
            if name in VOID:
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
                continue
            stack.append(path)
            is_open[name] += 1

    def masses(self) -> dict[Path, int]:
        """Worth of every opened path with all below it; paths are opened after those above them."""
        out = {p: self.worth.get(p, 0) for p in self.opened}
        for p in reversed(self.opened):
            if p.up in out:
                out[p.up] += out[p]
        return out


def clean(text: str) -> str:
    return _BLANK.sub(" ", entities.unescape(text)).strip()


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def texts_of(page: Page) -> tuple[list[dict], int]:
    """The distinct texts outside chrome and articles, and a hash of all texts outside chrome."""
    blocks = [(p, t) for p, t in page.blocks if not p.chrome]
    out = {(_hash(p.key, t), p.key, len(t)) for p, t in blocks if not p.article}
    return [{"h": h, "path": k, "n": n} for h, k, n in sorted(out)], _hash("\n".join(t for _, t in blocks))


_TEXTS = pa.list_(pa.struct([("h", pa.int64()), ("path", pa.int64()), ("n", pa.int32())]))
_READ = "host string, token long, up long, holder boolean, article boolean, pages long, times long, vector long, worth long, content long, texts array<struct<h:long,path:long,n:int>>"
_WRAP = (1 << 60) - 1


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its texts, and the sketches of tokens, summed up over a task's pages: one pass over the html."""
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5, _TEXTS]
    sums: dict[tuple[str, int], list] = {}
    paths = Paths()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def flushed() -> pa.RecordBatch:
        out = table([(*key, *v, None, None) for key, v in sums.items()])
        sums.clear()
        return out

    for b in batches:
        rows = []
        for number, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            host, page = host_of(url), Page(html or "", paths)
            mark = zlib.crc32(f"{number}|{url}".encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
            texts, content = texts_of(page)
            rows.append((host, None, None, None, None, None, None, None, None, content, texts))
            worth = page.masses()
            whole = [(0, 0, False, False, 1, sum(page.worth.values()))]  # token 0 is the page itself
            for up, token, holder, article, n, w in [*((p.up.key if p.up.up else 0, p.key, p.name not in TEXT_BLOCKS and not p.chrome, p.name in ("article", "main"), n, worth[p]) for p, n in page.opened.items()), *whole]:
                v = sums.setdefault((host, token), [up, holder, article, 0, 0, 0, 0])
                v[3] += 1
                v[4] += n
                v[5] = (v[5] + n * mark) & _WRAP
                v[6] += w
            if len(sums) > 100_000:
                yield flushed()
        if rows:
            yield table(rows)
    if sums:
        yield flushed()


_TOKENS = "array<struct<token:long,up:long,holder:boolean,article:boolean,pages:long,times:long,vector:long,worth:long>>"


def nest(tokens: list[dict]) -> list[tuple[int, int, int, int]]:
    """(class, class it nests in, token, token it nests in) of the template: valid equivalence classes, outermost first.

    Tokens of equal vectors are a class; its number is the least of its tokens. A class is valid if all its tokens
    that have no ancestor in it lie under one token of a valid class (the page itself for the outermost one).
    """
    by = {t["token"]: t for t in tokens}
    vector = lambda t: (t["pages"], t["times"], t["vector"])
    classes: dict[tuple, list[int]] = {}
    for t in tokens:
        classes.setdefault(vector(t), []).append(t["token"])
    out, done = [], {0: 0}
    known = {v: min(ts) for v, ts in classes.items()}

    def above(token: int) -> int:
        """The nearest token above that isn't of the same class."""
        own, up, seen = vector(by[token]), by[token]["up"], 0
        while up in by and up and vector(by[up]) == own and seen < len(by):
            up, seen = by[up]["up"], seen + 1
        return up

    left = [v for v in classes]
    while left:
        rest = []
        for v in left:
            ups = {above(t) for t in classes[v]}
            if len(ups) == 1 and (up := next(iter(ups))) in done:
                for t in classes[v]:
                    done[t] = known[v]
                    out.append((known[v], done[up], t, by[t]["up"]))
            else:
                rest.append(v)
        if len(rest) == len(left):
            break
        left = rest
    return out


def content_slots(tokens: list[dict], texts: list[dict]) -> list[int]:
    """Template tokens whose slots hold the main text, innermost first; none where the descent ends at the page's root."""
    page = next((t for t in tokens if not t["token"]), None)
    by = {t["token"]: t for t in tokens if t["token"]}
    if page is None:
        return []
    worth = {k: t["worth"] for k, t in by.items()}
    whole = page["worth"]
    for x in texts:  # what repeats over the pages is template, not slot
        whole -= x["n"] * x["pages"]
        at, seen = x["path"], 0
        while at in by and seen < len(by):
            worth[at] -= x["n"] * x["pages"]
            at, seen = by[at]["up"], seen + 1
    valid = {t for _, _, t, _ in nest(list(by.values()))}
    fit = {k for k, t in by.items() if t["holder"] and t["times"] == t["pages"] and t["pages"] >= PAGE_SHARE * page["pages"] and (k in valid or t["article"])}
    kids: dict[int, list[int]] = {}
    for k in fit:
        up, seen = by[k]["up"], 0
        while up and up not in fit and up in by and seen < len(by):
            up, seen = by[up]["up"], seen + 1
        kids.setdefault(up, []).append(k)
    out: list[int] = []
    at, have = 0, whole
    while at in kids:
        best = max(kids[at], key=lambda k: (worth[k], -k))
        if worth[best] <= 0 or worth[best] < MAIN_SHARE * have:
            break
        out.append(best)
        at, have = best, worth[best]
        if by[best]["article"]:
            break
    return out[::-1]


def _host_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slots, boiler = [], []
        for tokens, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            whole = sum(t["worth"] for t in tokens if not t["token"])
            if sum(x["n"] * x["pages"] for x in texts or []) > REPEAT_MOST * whole:
                texts = []
            slots.append(content_slots(tokens, texts or []))
            boiler.append(sorted(x["h"] for x in texts or []))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.list_(pa.int64())), pa.array(boiler, pa.list_(pa.int64()))], names=["host", "slots", "boilerplate"])


def sketches(pages: DataFrame) -> DataFrame:
    """host, tokens, texts: the summed sketches of the tokens of every host, and its repeated texts.

    Tokens are those on at least LEAST_SHARE of the host's pages, so their number is bound by what pages hold and
    not by how many there are. Texts repeat on REPEAT_SHARE of the host's pages of different content, REPEAT_PAGES
    at least, so copies of one page don't make its text a template.
    """
    read = staged(in_batches(pages.select("page_id", "url", "html"), _read_rows, _READ), "page-sketches")
    sums = read.filter("token is not null").groupBy("host", "token").agg(
        F.min("up").alias("up"), F.max("holder").alias("holder"), F.max("article").alias("article"), F.sum("pages").alias("pages"), F.sum("times").alias("times"),
        F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), F.lit(_WRAP + 1)).cast("long").alias("vector"), F.sum("worth").alias("worth"),
    )
    sums = staged(sums, "page-tokens")
    size = sums.filter("token = 0").select(F.col("host").alias("_host"), F.col("pages").alias("_pages"))
    often = sums.join(size, F.col("host") == F.col("_host")).filter(F.col("pages") >= LEAST_SHARE * F.col("_pages"))
    tokens = often.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "up", "holder", "article", "pages", "times", "vector", "worth"))).alias("tokens"))
    apart = read.filter("content is not null").groupBy("host", "content").agg(F.max("texts").alias("texts"), F.count("*").alias("copies"))
    apart = staged(apart, "page-contents")
    every = apart.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("_pages"))
    met = apart.select("host", "copies", F.explode("texts").alias("x")).groupBy("host", "x").agg(F.count("*").alias("apart"), F.sum("copies").alias("pages")).filter(F.col("apart") >= REPEAT_PAGES)
    repeated = met.join(every, F.col("host") == F.col("_host")).filter(F.col("apart") >= REPEAT_SHARE * F.col("_pages"))
    texts = repeated.groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_list(F.struct("x.h", "x.path", "x.n", "pages"))).alias("texts"))
    return tokens.join(texts, F.col("host") == F.col("_host"), "left").select("host", "tokens", "texts")


def templates(pages: DataFrame) -> DataFrame:
    """host, slots, boilerplate: the template tokens whose slots hold the main text, innermost first, and hashes of repeated texts.

    Null urls have the host "", null html no tokens; a host of one page has a template of its own; no pages give no rows.
    """
    return in_batches(sketches(pages), _host_rows, "host string, slots array<long>, boilerplate array<long>")


def main_text(html: str | None, slots: list[int] | None = None, boilerplate: list[int] | None = None, paths: Paths | None = None) -> str:
    """Blocks of the page's content slots, outside chrome.

    They lie below the innermost token of `slots` that the page has. Where there is none but the body, tags decide:
    below an article, else below a main element, else everywhere. Texts that repeat over the host are no content
    there, unless nothing else is.
    """
    page = Page(html or "", paths or Paths())
    blocks = [(p, t) for p, t in page.blocks if not p.chrome]
    there = {p.key: p for p in page.opened}
    top = next((there[k] for k in slots or () if k in there), None)
    if top is not None and top.name not in ("html", "body"):
        below: dict[Path, bool] = {}

        def inside(path: Path) -> bool:
            walk = []
            at: Path | None = path
            while at is not None and at not in below and at is not top:
                walk.append(at)
                at = at.up
            found = at is top if at is None or at is top else below[at]
            below.update(dict.fromkeys(walk, found))
            return found

        kept = [(p, t) for p, t in blocks if inside(p)]
        if top.name in ("article", "main"):
            return "\n".join(t for _, t in kept)
    else:
        for mark in ("article", "main"):
            if kept := [(p, t) for p, t in blocks if getattr(p, mark)]:
                return "\n".join(t for _, t in kept)
        kept = blocks
    drop = set(boilerplate or ())
    left = [(p, t) for p, t in kept if _hash(p.key, t) not in drop] if drop else kept
    return "\n".join(t for _, t in left or kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths = Paths()
    for b in batches:
        texts = [main_text(*x, paths) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


SALTS = 16


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages.

    Null html gives an empty text; pages without a host share the host ""; repeated pages each get their text; a
    host of few pages has a template of what they share; an empty table gives an empty result; other columns are
    not looked at. The template table is broadcast if its rows and bytes are counted to be few, else pages are
    joined over hosts that are salted, so that a host with a third of all pages is many tasks.
    """
    own = pages.select("page_id", "url", "html")
    found = staged(templates(own), "page-templates").withColumnRenamed("host", "_host")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    own = own.select("*", host.alias("host"))
    size = found.agg(F.count("*").alias("n"), F.sum(64 + F.octet_length("_host") + 8 * F.size("slots") + 8 * F.size("boilerplate")).alias("b")).first()
    if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES:
        got = own.join(F.broadcast(found), F.col("host") == F.col("_host"), "left")
    else:
        salted = found.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
        got = own.select("*", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
        got = got.join(salted, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")
    return in_batches(got.select("page_id", "url", "html", "slots", "boilerplate"), _extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
