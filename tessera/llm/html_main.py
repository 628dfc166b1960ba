"""HTML extraction: structure first, then a host suffix array over whatever structure leaves open.

A page is read into blocks. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments go by their markup. Where a page marks its article (``article``, ``main`` or the like), those
blocks are its text, repeated or not: passages that several articles share are no boilerplate. Two things stay open:
blocks of pages that mark no article, and blocks in an article whose class or id only hints at furniture
("share-price", "related-work"). They are held against the token streams of their host: all suffixes outside articles
are ordered by their first RUN tokens (by a hash of them; a hinted block of fewer tokens is one suffix), and
neighbours that agree on all of these and come from different pages are a repeated substring. Tokens under one are
removed and the unique runs stay. A longer common prefix of two neighbours is a chain of such runs, so the tokens that
go are those under any substring of RUN tokens or more that a suffix array with its longest common prefixes finds.

The suffixes are ordered by a shuffle on (host, hash) in which each task sends one row for a key, so a host with a
third of all pages is spread like any other. Null html counts as empty and gives an empty text; a null or odd url
has the host ''; pages of equal html count as one page and get the same text, ties don't arise; an empty table gives an
empty one; very long pages are read whole, one at a time, in time linear in their length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, written

RUN = 8

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section select summary table tbody template tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
CHROME_TAGS = frozenset("head nav header footer aside form dialog menu select option optgroup datalist button template".split())
#: Words of class and id that name furniture, alone or with OBJECTS or PARTS; with other words they only hint at it, in an article.
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter subscribe signup comment comments disqus replies".split())
#: Words that name it alone, or with one of OBJECTS; with other words they only hint at it, in an article.
WEAK = frozenset("banner notice notices overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead reply share sharing social related widget toolbar login search form pagination pager copyright".split())
PARTS = frozenset("slot unit zone body content text author meta thread form count header footer title inner label top bottom left right main page user reader site sticky inline mobile desktop overlay dialog bg close message policy notice placeholder container".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENTS = frozenset("comment comments disqus replies".split())
OBJECTS = frozenset("posts articles stories links link buttons button bar icons box list items widget block wrapper container inner area section".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Furniture in which an article can stand nevertheless.
HOLDS = frozenset("nav header ul li a div span".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
HINTED, ARTICLE, OPEN, CHROME = 3, 2, 1, 0
NAMES, HINT, NONE = 2, 1, 0


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _named(value: str) -> int:
    """Whether a class or id names furniture, hints at it, or neither."""
    most = NONE
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        strong, weak = STRONG.intersection(words), WEAK.intersection(words)
        rest = [w for w in words if w not in strong and w not in weak and w not in OBJECTS and not w.isdigit()]
        if strong and PARTS.issuperset(rest) or weak and not rest:
            return NAMES
        if strong or weak:
            most = HINT
    return most


def _marks(attributes: str) -> tuple[int, bool, bool, bool]:
    """What class, id and role name; whether they name the article; reader comments; whether the element is hidden."""
    named, article, comments, hidden = NONE, False, False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            named = max(named, _named(value))
            comments |= any(_named(n) == NAMES and not COMMENTS.isdisjoint(w.lower() for w in _WORD.findall(n)) for n in value.split())
        elif name == "role":
            article |= value.lower() in ("main", "article")
            if value.lower() in CHROME_ROLES:
                named = NAMES
        elif name == "itemprop":
            article |= value.lower() == "articlebody"
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    return named, article, comments, hidden


class _Open:
    """The open elements. Which are open, in the block at hand and at all, is counted, so a tag that closes none costs nothing."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = []  # tag, kind of what it holds, whether furniture that can't hold an article is around
        self.blocks: list[int] = []
        self.counts = Counter()
        self.inline: list[Counter] = [Counter()]
        self.push("", OPEN)

    def push(self, tag: str, kind: int) -> None:
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        self.counts[tag] += 1
        hard = bool(self.stack) and self.stack[-1][2] or (kind == CHROME and tag not in HOLDS)
        self.stack.append((tag, kind, hard))

    def cut(self, at: int) -> None:
        """Close all elements from number ``at`` on."""
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.counts[tag] -= 1
            if tag in BLOCK:
                self.blocks.pop()
                self.inline.pop()
            else:
                self.inline[-1][tag] -= 1

    def find(self, tag: str) -> int:
        """The number of the innermost open element that a closing tag closes; -1 if it closes none."""
        if not (self.counts if tag in BLOCK else self.inline[-1])[tag]:
            return -1
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            at -= 1
        return at

    def changes(self, at: int) -> bool:
        """Whether the kind changes at or inside element ``at``."""
        return any(self.stack[i][1] != self.stack[i - 1][1] for i in range(at, len(self.stack)))


ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(ARTICLE, HINTED, OPEN or CHROME, text) of every block with text, in page order; HINTED ones stand in an article."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    html, open_ = html or "", _Open()

    def flush() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((open_.stack[-1][1], text))
            parts.clear()

    at, last = 0, html.rfind(">")
    ends: dict[str, int] = {}  # where a raw element's next closing tag ends; the page's end if there is none
    while at < len(html):
        m = _TOKEN.search(html, at) if at <= last else None
        if not m:
            # no tag ends from here on; a comment would run to the page's end
            comment = html.find("<!--", at)
            parts.append(html[at : comment if comment >= 0 else len(html)])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closes, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closes:
            if tag in BLOCK:
                flush()
            if (found := open_.find(tag)) > 0:
                if open_.changes(found):
                    flush()
                open_.cut(found)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                if ends.get(tag, 0) < at:
                    close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    ends[tag] = close.end() if close else len(html)
                at = ends[tag]
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in ("td", "th"):
            parts.append(" ")
        if tag == "option" and (found := open_.find("option")) > 0:
            flush()
            open_.cut(found)
        if tag in BLOCK:
            flush()
            if open_.blocks and open_.stack[open_.blocks[-1]][0] in (*ALIKE.get(tag, ()), "p"):
                open_.cut(open_.blocks[-1])
        named, article, comments, hidden = _marks(attributes) if attributes else (NONE, False, False, False)
        above, hard = open_.stack[-1][1], open_.stack[-1][2]
        article |= tag in ("article", "main")
        kind = above
        if hidden or comments:
            kind = CHROME
        elif article:
            kind = ARTICLE if above or not hard else CHROME
        elif tag in CHROME_TAGS and not (tag == "header" and above == ARTICLE):
            kind = CHROME
        elif named == NAMES and tag not in ("html", "body"):
            kind = CHROME
        elif named == HINT and tag not in ("html", "body") and not (tag in HEADINGS and above == ARTICLE):
            kind = HINTED if above == ARTICLE else above if above == HINTED else CHROME
        if tag == "body":
            open_, kind = _Open(), OPEN
        if kind != above and parts:
            flush()
        if not attributes.endswith("/"):
            open_.push(tag, kind)
    flush()
    return out


def _hash(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def windows(tokens: list[str], run: int = RUN) -> list[int]:
    """Hash of the first ``run`` tokens of each suffix that has as many."""
    return [_hash("\0".join(tokens[i : i + run])) for i in range(len(tokens) - run + 1)]


def decided(parsed: list[tuple[int, str]]) -> str | None:
    """The text of a page whose markup decides it; None of one with open blocks."""
    kinds = {kind for kind, _ in parsed}
    if HINTED in kinds or (OPEN in kinds and ARTICLE not in kinds):
        return None
    return "\n\n".join(text for kind, text in parsed if kind == ARTICLE)


def keys(kind: int, texts: list[str], run: int = RUN) -> list[int]:
    """The hash of each suffix of a stream; a hinted stream of fewer tokens than a run is one suffix."""
    tokens = [w for t in texts for w in t.split(" ")]
    if kind == HINTED and len(tokens) < run:
        return [_hash("\0".join([*tokens, "\0"]))]
    return windows(tokens, run)


def streams(parsed: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """The token streams of a page outside its article: what is open as one, each other block as one."""
    loose = [text for kind, text in parsed if kind == OPEN]
    rest = [(HINTED, [text]) for kind, text in parsed if kind in (HINTED, CHROME)]
    return [(OPEN, loose), *rest] if loose else rest


def candidates(parsed: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks of an undecided page that may be its text."""
    marked = any(kind == ARTICLE for kind, _ in parsed)
    return [(kind, text) for kind, text in parsed if kind == HINTED or kind == (ARTICLE if marked else OPEN)]


def unique_runs(blocks_: list[tuple[int, str]], known: set[int], run: int = RUN) -> str:
    """The blocks without the tokens under the suffixes in ``known``; those of the article stay whole."""
    loose = [text for kind, text in blocks_ if kind == OPEN]
    gone = _covered(OPEN, loose, known, run)
    out, at = [], 0
    for kind, text in blocks_:
        words = text.split(" ")
        if kind == OPEN:
            words, at = [w for i, w in enumerate(words, at) if not gone[i]], at + len(words)
        elif kind == HINTED:
            under = _covered(HINTED, [text], known, run)
            words = [w for i, w in enumerate(words) if not under[i]]
        if words:
            out.append(" ".join(words))
    return "\n\n".join(out)


def _covered(kind: int, texts: list[str], known: set[int], run: int) -> np.ndarray:
    """Which tokens of a stream stand under a known suffix."""
    total = sum(t.count(" ") + 1 for t in texts)
    under = np.zeros(total + 1, np.int32)
    for i, h in enumerate(keys(kind, texts, run)):
        if h in known:
            under[i] += 1
            under[min(total, i + run)] -= 1
    return np.cumsum(under) > 0


def _rows(batches: Iterator[pa.RecordBatch]):
    let_go()
    for b in batches:
        yield b, [blocks(h.as_py()) for h in b.column(2)]


FOUND = "host string, suffix long, low long, high long, page_id long, url string, mark binary, kinds array<int>, texts array<string>"


def read(pages: DataFrame, run: int = RUN) -> DataFrame:
    """One table of two things: the suffixes of all pages outside articles, by task and key with the least and the greatest
    hash of the pages that hold them; and the undecided pages with their blocks."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())]

    def table(columns: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in zip(names, kinds)], names)

    def find(batches):
        found: dict[tuple[str, int], list[int]] = {}

        def rows() -> pa.RecordBatch:
            hosts, hashes = zip(*found)
            ends = list(found.values())
            out = table({"host": hosts, "suffix": hashes, "low": [x[0] for x in ends], "high": [x[1] for x in ends]}, len(ends))
            found.clear()
            return out

        for b, parsed in _rows(batches):
            open_: dict[str, list] = {name: [] for name in ("host", "page_id", "url", "mark", "kinds", "texts")}
            for page_id, url, html, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), parsed):
                host, own = host_of(url), streams(page)
                mark = _hash(html.as_py() or "")
                for kind, texts in own:
                    for h in keys(kind, texts, run):
                        ends = found.setdefault((host, h), [mark, mark])
                        ends[0], ends[1] = min(ends[0], mark), max(ends[1], mark)
                if decided(page) is None:
                    left = candidates(page)
                    whole = hashlib.sha256("\0".join([host, *(f"{kind}{text}" for kind, text in left)]).encode("utf-8", "surrogatepass")).digest()
                    for name, value in (("host", host), ("page_id", page_id), ("url", url), ("mark", whole), ("kinds", [k for k, _ in left]), ("texts", [t for _, t in left])):
                        open_[name].append(value)
                if len(found) > 100_000:
                    yield rows()
            if open_["mark"]:
                yield table(open_, len(open_["mark"]))
        if found:
            yield rows()

    return pages.mapInArrow(find, FOUND)


def repeated(suffixes: DataFrame) -> DataFrame:
    """(host, suffix): the suffixes, as far as they are ordered, that two pages of a host with different html hold."""
    return suffixes.groupBy("host", "suffix").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("host", "suffix")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", run: int = RUN) -> DataFrame:
    """page_id, url, text, n_chars and by_markup (markup alone decides the page) of every page."""
    pages = pages.select(pages[key].cast("long").alias("page_id"), pages[url].alias("url"), pages[html].alias("html"))
    out = "page_id long, url string, text string"

    def by_markup(batches):
        for b, parsed in _rows(batches):
            texts = [decided(p) for p in parsed]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]).filter(pa.array([t is not None for t in texts], pa.bool_()))

    def suffixes(batches):
        for b in batches:
            rows = [sorted({h for kind, texts in streams(list(zip(k, t))) for h in keys(kind, texts, run)}) for k, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int64()))], ["mark", "host", "suffixes"])

    def cut(batches):
        for b in batches:
            texts = [unique_runs(list(zip(k, t)), set(c or ()), run) for k, t, c in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = written(read(pages, run), "suffixes")
    known = repeated(found.where("mark is null"))
    open_pages = found.where("mark is not null").select("page_id", "url", "host", "mark", "kinds", "texts")
    own = open_pages.dropDuplicates(["mark"]).select("mark", "host", "kinds", "texts").mapInArrow(suffixes, "mark binary, host string, suffixes array<long>")
    held = own.select("mark", "host", F.explode("suffixes").alias("suffix")).join(known, ["host", "suffix"]).groupBy("mark").agg(F.collect_list("suffix").alias("known"))  # of one page
    rest = open_pages.join(held, "mark", "left").select("page_id", "url", "kinds", "texts", "known").mapInArrow(cut, out)
    both = pages.mapInArrow(by_markup, out).withColumn("by_markup", F.lit(True)).unionByName(rest.withColumn("by_markup", F.lit(False)))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_markup")
